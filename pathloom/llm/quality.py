"""Quality scores from compressed sizes under two dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pathloom.llm.common import HOLD_OUT, held_out, lean, table, text_parts, texts

SAMPLE = 4000          # labelled texts of each kind that the model is fitted on, at most
SAMPLE_CHARS = 80_000_000  # of all texts of a kind: beyond them, fewer whole texts
WINDOW = 2048          # bytes compressed together
DICTIONARY = 112_640   # bytes
LEVEL = 3
RIDGE = 0.1            # on the standardised features
ACCEPT = 0.7


def _windows(text: str):
    raw = text.encode()
    return [raw[i:i + WINDOW] for i in range(0, len(raw), WINDOW)]


def _dictionary(samples: list[str]) -> bytes:
    """A trained dictionary; with too few samples their plain content."""
    import zstandard

    parts = [w for t in samples for w in _windows(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY]


@dataclass
class SizeModel:
    """Dictionaries of good and bad text and a logistic calibration of the compressed sizes."""

    good: bytes
    bad: bytes
    base: float
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    reach: np.ndarray | None = None  # least and largest value of each size feature when fitted
    _ready: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            import zstandard as z

            bare = {"level": LEVEL, "write_content_size": False, "write_dict_id": False}
            self._ready = tuple(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d), **bare).compress
                                for d in (self.good, self.bad)) + (z.ZstdCompressor(**bare).compress,)
        return self._ready

    def sizes(self, text: str) -> tuple[int, int, int, int]:
        """Bytes of the whole text, and compressed with the good, the bad and no dictionary."""
        good, bad, plain = self._compressors()
        parts = _windows(text)
        return (sum(map(len, parts)), sum(len(good(w)) for w in parts), sum(len(bad(w)) for w in parts),
                sum(len(plain(w)) for w in parts))

    def features(self, texts: list[str]) -> np.ndarray:
        """The normalised difference of the two sizes, and how far the good and no dictionary
        compress, with their products.  Values beyond those the calibration has seen (a text
        that is in a dictionary itself, say) count as the nearest one seen."""
        n, g, b, p = np.maximum(np.array([self.sizes(t) for t in texts], float).reshape(-1, 4), 1).T
        x = np.c_[(b - g) / (b + g), np.log(g / n), np.log(p / n)]
        if self.reach is None:
            self.reach = np.stack([x.min(axis=0), x.max(axis=0)])
        x = np.clip(x, *self.reach)
        return np.c_[x, x * x, x[:, [0, 0, 1]] * x[:, [1, 2, 2]]]

    def fit(self, texts: list[str], labels: np.ndarray, rounds: int = 100) -> None:
        """Weights of the logistic with a ridge; rows are weighted so that the kinds have their
        shares.  Newton steps are halved until the penalised loss falls, so that kinds that
        are told apart completely don't carry the weights away."""
        self.reach = None
        x = self.features(texts)
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.c_[(x - self.centre) / self.scale, np.ones(len(x))]
        share = labels.mean()
        row = np.where(labels == 1, self.base / share, (1 - self.base) / (1 - share))

        def loss(w):
            z = x @ w
            return row @ (np.logaddexp(0, z) - labels * z) + 0.5 * RIDGE * (w[:-1] @ w[:-1])

        w, held = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 0.0] * RIDGE
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            bend = (x * (row * p * (1 - p))[:, None]).T @ x + np.diag(held + 1e-9)
            step = np.linalg.solve(bend, x.T @ (row * (labels - p)) - held * w)
            now, size = loss(w), 1.0
            while size > 1e-6 and not loss(w + size * step) <= now:
                size /= 2
            w = w + size * step
            if np.abs(size * step).max() < 1e-7:
                break
        self.weights = w

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; 0 of an empty text; the base share without a fit."""
        if not texts:
            return np.zeros(0)
        if self.weights is None:
            out = np.full(len(texts), self.base)
        else:
            x = (self.features(texts) - self.centre) / self.scale
            out = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -500, 500)))
        return np.where([t == "" for t in texts], 0.0, out)


def train(docs: DataFrame, labels: DataFrame) -> SizeModel:
    """A model from labelled documents outside the held-out quarter.

    The sample is bounded: of each kind the ``SAMPLE`` documents with the least hash of their
    id, whole, up to the one that reaches ``SAMPLE_CHARS`` characters of its kind.  Half makes the dictionaries, half the calibration.
    Labels other than 0 and 1 are no labels; of several for one document the largest counts.
    """
    own = labels.where(f"doc_id is not null and quality in (0, 1) and not ({HOLD_OUT})").groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    share = own.agg(F.avg("quality")).first()[0]
    model = SizeModel(b"", b"", 0.5 if share is None else float(share))
    picked = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for q in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * SAMPLE rows at most
    found = texts(docs).where("text <> ''").join(picked, "doc_id")
    sizes = found.groupBy("doc_id", "quality").agg(F.sum(F.length("text")).alias("n")).withColumn(
        "h", F.xxhash64("doc_id")).collect()
    total, keep = [0, 0], []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if total[r["quality"]] < SAMPLE_CHARS:
            keep.append((r["doc_id"], r["quality"]))
        total[r["quality"]] += r["n"]
    if len(keep) < len(sizes):
        fewer = docs.sparkSession.createDataFrame(keep, picked.select("doc_id", "quality").schema)
        found = found.join(F.broadcast(fewer.select("doc_id")), "doc_id", "left_semi")
    rows = found.select("doc_id", "quality", "text").collect()
    rows = sorted({(r["doc_id"], r["quality"], r["text"]) for r in rows})
    kinds = [[r[2] for r in rows if r[1] == q] for q in (0, 1)]
    if min(map(len, kinds)) < 2:
        return model
    model.bad, model.good = (_dictionary(k[::2]) for k in kinds)
    model.fit(kinds[0][1::2] + kinds[1][1::2], np.repeat([0, 1], [len(k[1::2]) for k in kinds]))
    return model


def with_scores(docs: DataFrame, model: SizeModel) -> DataFrame:
    """``docs`` with a column score; any other columns stay as they are."""
    def run(batches):
        for batch in text_parts(batches):
            texts_ = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.append_column("score", pa.array(model.score(texts_), pa.float64()))
    rest = docs.drop("score")
    return rest.mapInArrow(lean(run), StructType(rest.schema.fields + [StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    The score grows with how much better a dictionary of good text compresses the whole text
    than one of bad text, calibrated to a probability of label 1; predicted is 1 from 0.7 on.
    A missing or empty text scores 0.  Without two labelled texts of each kind all other
    texts score the share of label 1 (0.5 without labels).  Repeated rows are scored each,
    a missing doc_id is not held out, an empty table gives no rows, other columns go.
    """
    out = held_out(with_scores(docs.select("doc_id", "text"), train(docs, labels)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
