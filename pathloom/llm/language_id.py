"""Language of texts by a small convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pathloom.llm.common import HOLD_OUT, held_out, lean, table, text_parts, texts

WINDOW = 512        # bytes of a window; the last one of a text is filled up with zeros
WIDTHS = (2, 3, 4)  # bytes a filter sees
FILTERS = 16        # of each width
SAMPLE = 600        # documents of each language that the network is fitted on, at most
SAMPLE_WINDOWS = 4  # windows of each of them
EPOCHS, BATCH, RATE = 10, 64, 0.02
AT_ONCE = 64        # windows scored together; a filter's responses to them are 2 MB
UNDETERMINED = "und"
LEAST_SCORE = 0.5   # of a document that the pipeline keeps
LETTER = regex.compile(r"\p{L}")


def windows(raw: bytes) -> np.ndarray:
    """All of ``raw`` as rows of ``WINDOW`` bytes."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class ByteNetwork:
    """Filters of several widths over bytes, the largest response of each in a window, softmax.

    As bytes are symbols, a filter is one weight per place and byte value.
    """

    languages: list[str]
    filters: dict[int, np.ndarray]  # width: (width, 256, FILTERS)
    out: np.ndarray                 # (all filters + 1, languages)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> "ByteNetwork":
        rng = np.random.default_rng(seed)
        return cls(languages, {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
                   rng.normal(0, 0.1, (FILTERS * len(WIDTHS) + 1, len(languages))).astype(np.float32))

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """(windows, places, filters) of one width."""
        f, places = self.filters[width], x.shape[1] - width + 1
        total = f[0][x[:, :places]]
        for k in range(1, width):
            total += f[k][x[:, k:k + places]]
        return total

    def step(self, x: np.ndarray, y: np.ndarray, adam: "Adam") -> float:
        """One gradient step; pooling passes the gradient to the place of each maximum only."""
        pooled, places = [], {}
        for w in WIDTHS:
            r = self.responses(x, w)
            places[w] = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, places[w][:, None], axis=1)[:, 0])
        h = np.maximum(np.concatenate(pooled + [np.ones((len(x), 1), np.float32)], axis=1), 0)
        p = softmax(h @ self.out)
        loss = -np.log(p[np.arange(len(y)), y] + 1e-9).mean()
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T)[:, :-1] * (h[:, :-1] > 0)
        adam.move("out", self.out, h.T @ p)
        rows, cols = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for i, w in enumerate(WIDTHS):
            grad = np.zeros_like(self.filters[w])
            own = back[:, i * FILTERS:(i + 1) * FILTERS]
            for k in range(w):
                np.add.at(grad, (k, x[rows, places[w] + k], cols), own)
            adam.move(w, self.filters[w], grad)
        return float(loss)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rng, adam = np.random.default_rng(seed), Adam()
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                adam.tick()
                self.step(x[order[at:at + BATCH]], y[order[at:at + BATCH]], adam)

    def scorer(self):
        """Softmax of windows; the filters' places are joined two by two, a table per byte pair."""
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, -1)
        tables = {w: [pair(f[k], f[k + 1]) if k + 1 < w else f[k] for k in range(0, w, 2)]
                  for w, f in self.filters.items()}

        def score(x: np.ndarray) -> np.ndarray:
            pairs = x[:, :-1].astype(np.uint16) * np.uint16(256) + x[:, 1:]
            h = [np.ones((len(x), 1), np.float32)]
            for w in reversed(WIDTHS):
                places, total = x.shape[1] - w + 1, None
                for k, t in zip(range(0, w, 2), tables[w]):
                    seen = t[(pairs if k + 1 < w else x)[:, k:k + places]]
                    total = seen if total is None else np.add(total, seen, out=total)
                h.insert(0, total.max(axis=1))
            return softmax(np.maximum(np.concatenate(h, axis=1), 0) @ self.out)
        return score


class Adam:
    """Step sizes by running moments."""

    def __init__(self):
        self.t, self.moments = 0, {}

    def tick(self) -> None:
        self.t += 1

    def move(self, name, weights: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.moments.setdefault(name, (np.zeros_like(weights), np.zeros_like(weights)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        rate = RATE * np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        weights -= rate * m / (np.sqrt(v) + 1e-8)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame) -> ByteNetwork | None:
    """A network fitted on documents with a language, outside the held-out quarter; None
    without any.

    The sample is bounded: of each language the ``SAMPLE`` documents with the least hash of
    their id, ``SAMPLE_WINDOWS`` evenly spread windows of each.
    """
    own = docs.where(f"doc_id is not null and lang is not null and text is not null and not ({HOLD_OUT})")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    own = own.select("doc_id", "lang", place.alias("place"))
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # an output of the network each
    if not sizes:
        return None
    # the least hashes lie below a bound that some 4 * SAMPLE documents of a language reach, so
    # that the ranking never gathers a whole language
    bound = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], (1 << 30) * 4 * SAMPLE // r["n"] + 1)])
    rank = Window.partitionBy("lang").orderBy("place", "doc_id")
    picked = own.where(F.col("place") <= F.element_at(bound, F.col("lang"))).withColumn(
        "rank", F.row_number().over(rank)).where(F.col("rank") <= SAMPLE)
    picked = picked.select("doc_id", "lang").distinct()
    if picked.count() <= 200_000:
        picked = F.broadcast(picked)
    near = texts(docs).join(picked, "doc_id").select("doc_id", "lang", F.length("text").alias("n"), "text")
    span = F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLE_WINDOWS)).cast("int")
    rows = near.select("doc_id", "lang", F.transform(
        F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda k: F.substring("text", k * span + 1, WINDOW)).alias("parts")).collect()
    rows = sorted((r["doc_id"], r["lang"], tuple(r["parts"])) for r in rows)
    parts = [(lang, p.encode()[:WINDOW]) for _, lang, ps in rows for p in dict.fromkeys(ps) if LETTER.search(p)]
    if not parts:
        return None
    languages = sorted({lang for lang, _ in parts})
    net = ByteNetwork.fresh(languages)
    if len(languages) > 1:
        net.fit(np.concatenate([windows(p) for _, p in parts]), np.array([languages.index(lang) for lang, _ in parts]))
    return net


def predict(texts_: list[str], net: ByteNetwork, score) -> tuple[list[str], list[float]]:
    """Language and score of whole texts: the windows' probabilities by the bytes they hold."""
    raw = [t.encode() if LETTER.search(t) else None for t in texts_]
    rows = [windows(r) for r in raw if r is not None]
    owner = np.repeat(np.arange(len(rows)), [len(w) for w in rows])
    total = np.zeros((len(rows), len(net.languages)))
    held, n, at = [], 0, 0

    def flush():
        nonlocal held, n, at
        if n:
            x = np.concatenate(held)
            np.add.at(total, owner[at:at + n], score(x) * (x != 0).sum(axis=1)[:, None])
            held, n, at = [], 0, at + n

    for w in rows:
        for k in range(0, len(w), AT_ONCE):
            held.append(w[k:k + AT_ONCE])
            n += len(held[-1])
            if n >= AT_ONCE:
                flush()
    flush()
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
    found = iter(total)
    out = []
    for r in raw:
        if r is None:
            out.append((UNDETERMINED, 1.0))
        else:
            p = next(found)
            out.append((net.languages[int(p.argmax())], float(p.max())))
    return [o[0] for o in out], [o[1] for o in out]


def with_language(docs: DataFrame, net: ByteNetwork | None) -> DataFrame:
    """``docs`` with lang_pred and score; any other columns stay as they are."""
    def run(batches):
        score = net.scorer() if net else None
        for batch in text_parts(batches):
            texts_ = [t or "" for t in batch.column("text").to_pylist()]
            lang, p = predict(texts_, net, score) if net else ([UNDETERMINED] * len(texts_), [0.0] * len(texts_))
            yield batch.append_column("lang_pred", pa.array(lang, pa.string())).append_column(
                "score", pa.array(p, pa.float64()))
    rest = docs.drop("lang_pred", "score")
    return rest.mapInArrow(lean(run), StructType(rest.schema.fields + [
        StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    All windows of the whole text are scored and averaged by the bytes they hold; the score is
    the share of the language that wins (the first by name of equals).  A text that is missing
    or has no letter is ``und`` with score 1; without any training text all are ``und`` with
    score 0.  Repeated rows are judged each, a missing doc_id is not held out, an empty table
    gives no rows, other columns go.
    """
    return held_out(with_language(docs.select("doc_id", "text"), train(docs))).select(
        "doc_id", "held_out", "lang_pred", "score")


def op7_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op7_language_id": op7_language_id}
