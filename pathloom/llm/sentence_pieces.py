"""SentencePiece ids of whole texts by merging adjacent symbols in order of score, and back."""

from __future__ import annotations

import codecs
import heapq
import re
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import table, texts
from pathloom.llm.pieces import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"        # stands for a space inside pieces
RUN = re.compile(f"{MARK}+[^{MARK}]*")
MEMORY = 200_000       # segments a Python worker remembers, some 40 MB
TOGETHER = 20_000      # new segments merged side by side
LONG = 48              # symbols from which a segment gets an agenda of its own
SLOTS = 1 << 20        # of each of the two hash tables of symbol pairs
SLICE = 1_000_000      # bytes of text, or ids, that a kernel takes and sends off together (one row at least)

ENCODED = "doc_id long, n_tokens long, ids array<int>"


def one_each(error):
    """Every byte that is no UTF-8 becomes one replacement character."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("pathloom_one_each", one_each)


def parts(sizes: np.ndarray, most: int = SLICE):
    """(first, rows) of consecutive rows of at most ``most`` in all, one row at least."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield first, i - first
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes) - first


def slot(keys: np.ndarray, salt: np.uint64) -> np.ndarray:
    return ((keys.view(np.uint64) * salt) >> np.uint64(44)).astype(np.int64)


class Model:
    """Pieces, scores and pairs of a merge-type vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        kind = [(self.library.is_byte(i), self.library.is_control(i), self.library.is_unknown(i)) for i in range(size)]
        if any(self.library.is_unused(i) for i in range(size)):
            raise ValueError("a vocabulary with unused pieces is not of the plain merge type")
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kind[i][0]}
        self.bytes_of = [bytes([int(p[3:5], 16)]) if b else b"" if c else " ⁇ ".encode() if u
                         else p.replace(MARK, " ").encode() for p, (b, c, u) in zip(self.pieces, kind)]
        self.silent = np.array([c for _, c, _ in kind])
        self.leading = np.array([p.startswith(MARK) and not any(k) for p, k in zip(self.pieces, kind)])
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not any(kind[i])}
        # a segment may start at every mark behind another character unless some piece spans the place
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """Piece that two pieces in a row make, by their ids."""
        return {(self.id_of[p[:k]], self.id_of[p[k:]]): i for p, i in self.id_of.items()
                for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of}

    @cached_property
    def rank(self) -> np.ndarray:
        """Place of each piece by falling score; equal scores share it."""
        scores = [self.library.get_score(i) for i in range(len(self.pieces))]
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        return np.array([order[s] for s in scores], np.int64)

    @cached_property
    def char_id(self) -> np.ndarray:
        out = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                out[ord(p)] = i
        return out

    @cached_property
    def hashed(self) -> tuple[list, list, list]:
        """Pairs in two tables (salts, keys, values); what shares a slot of the first lies in the second."""
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        made = np.array(list(self.pairs.values()), np.int32)
        rng = np.random.default_rng(1)
        while True:
            salt = [np.uint64(int(x) | 1) for x in rng.integers(1 << 40, 1 << 62, 2)]
            key = [np.full(SLOTS, -1, np.int64) for _ in range(2)]
            value = [np.full(SLOTS, -1, np.int32) for _ in range(2)]
            left = np.arange(len(keys))
            for t in range(2):
                at = slot(keys[left], salt[t])
                _, first = np.unique(at, return_index=True)
                key[t][at[first]], value[t][at[first]] = keys[left[first]], made[left[first]]
                left = np.delete(left, first)
            if not len(left):
                return salt, key, value

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols makes, or -1."""
        salt, key, value = self.hashed
        keys = (a.astype(np.int64) << 32) | b
        at = slot(keys, salt[0])
        out = np.where(key[0][at] == keys, value[0][at], -1)
        miss = np.flatnonzero(out < 0)
        at = slot(keys[miss], salt[1])
        out[miss] = np.where(key[1][at] == keys[miss], value[1][at], -1)
        out[(a < 0) | (b < 0)] = -1
        return out

    def symbols(self, segment: str) -> np.ndarray:
        """A symbol for each character; -1 - code point where the vocabulary has none."""
        points = np.frombuffer(segment.encode("utf-32-le"), np.uint32).astype(np.int64)
        ids = self.char_id[points]
        return np.where(ids < 0, -1 - points, ids)

    def spelled(self, symbols: list[int]) -> list[int]:
        """Ids of symbols; a character without a piece becomes its bytes."""
        if min(symbols, default=0) >= 0:
            return symbols
        return [i for s in symbols for i in ([s] if s >= 0 else [self.byte_id[b] for b in chr(-1 - s).encode()])]

    def by_agenda(self, segment: str) -> list[int]:
        """Ids of a segment: the agenda holds its adjacent pairs, the best score first and of
        equal ones the leftmost; a merge adds the pairs with its two neighbours."""
        sym = self.symbols(segment).tolist()
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def offer(i, j):
            if i >= 0 and j < n and (p := self.pairs.get((sym[i], sym[j]))) is not None:
                heapq.heappush(agenda, (int(self.rank[p]), i, j, sym[i], sym[j], p))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b, p = heapq.heappop(agenda)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = p, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self.spelled([s for s in sym if s is not None])

    def together(self, segments: list[str]) -> list[bytes]:
        """Ids (32-bit, little-endian) of many segments.  Every segment has its agenda as a
        stretch of one array; each round takes the best pair, leftmost of equals, of all."""
        out: list[bytes] = [b""] * len(segments)
        short = []
        for i, s in enumerate(segments):
            if len(s) < LONG:
                short.append(i)
            else:
                out[i] = np.array(self.by_agenda(s), np.int32).tobytes()
        of = np.array(short, np.int64)
        if not len(of):
            return out
        sym = self.symbols("".join([segments[i] for i in short]))
        size = np.array([len(segments[i]) for i in short], np.int64)

        def finish(which, symbols, sizes):
            raw, at = symbols.astype(np.int32).tobytes(), 0
            ends = (4 * np.cumsum(sizes)).tolist()
            odd = np.add.reduceat(symbols < 0, np.cumsum(sizes) - sizes) > 0 if len(sizes) else []
            for i, end, bad in zip(which.tolist(), ends, odd):
                out[i] = raw[at:end]
                if bad:
                    out[i] = np.array(self.spelled(symbols[at // 4:end // 4].tolist()), np.int32).tobytes()
                at = end

        worst = np.int64(1) << 62
        pair = np.full(len(sym), -1, np.int32)
        last = np.zeros(len(sym), bool)
        last[np.cumsum(size) - 1] = True
        look = np.flatnonzero(~last)
        pair[look] = self.merged(sym[look], sym[look + 1])
        while len(of):
            starts = np.cumsum(size) - size
            place = np.arange(len(sym)) - np.repeat(starts, size)
            cost = np.where(pair >= 0, (self.rank[pair] << 8) | place, worst)
            best = np.minimum.reduceat(cost, starts)
            go = best < worst
            if not go.all():
                rows = np.repeat(go, size)
                finish(of[~go], sym[~rows], size[~go])
                of, size, best, sym, pair, last = of[go], size[go], best[go], sym[rows], pair[rows], last[rows]
                if not len(of):
                    break
                starts = np.cumsum(size) - size
            at = starts + (best & 255)
            sym[at] = pair[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # one symbol goes in every segment
            sym, pair, last, size = sym[keep], pair[keep], last[keep], size - 1
            pair[moved[last[moved]]] = -1
            look = moved[~last[moved]]
            pair[look] = self.merged(sym[look], sym[look + 1])
            left = moved[moved > (starts - np.arange(len(at)))] - 1
            pair[left] = self.merged(sym[left], sym[left + 1])
        return out


class Encoder:
    """Ids of texts by a model and a bounded memory of the segments seen."""

    def __init__(self, path: str, memory: int = MEMORY, checked: bool = False):
        self.model, self.memory, self.checked = Model(path), memory, checked
        self.known: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Segments of a text without their first mark, which the text itself gets in front."""
        if not text:
            return []
        s = text.replace(" ", MARK)
        if not self.model.splits:
            return [s]
        if MARK * 2 in s or s[0] == MARK:
            return [x[1:] for x in RUN.findall(MARK + s)]
        return s.split(MARK)

    def encode(self, of: list[str]) -> list[bytes]:
        split = [self.segments(t) for t in of]
        here = set().union(*split)
        fresh = list(here.difference(self.known))
        if len(self.known) + len(fresh) > self.memory:  # what these texts use stays
            self.known = {p: self.known[p] for p in here.intersection(self.known)}
        for at in range(0, len(fresh), TOGETHER):
            part = fresh[at:at + TOGETHER]
            ids = self.model.together([MARK + p for p in part])
            if self.checked:
                self.check(part, ids)
            self.known.update(zip(part, ids))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) for s in split]

    def check(self, segments: list[str], ids: list[bytes]) -> None:
        """Raises unless the library gives the same ids for every segment; it puts the first
        mark itself, but none in front of nothing."""
        if "" in segments:
            at = segments.index("")
            segments, ids = segments[:at] + segments[at + 1:], ids[:at] + ids[at + 1:]
        theirs = self.model.library.encode(segments, num_threads=1)
        if np.array(list(chain.from_iterable(theirs)), np.int32).tobytes() != b"".join(ids) or any(
                4 * len(x) != len(y) for x, y in zip(theirs, ids)):
            at = next(k for k, x in enumerate(theirs) if np.array(x, np.int32).tobytes() != ids[k])
            raise ValueError(f"the sentencepiece library encodes another way: {segments[at][:200]!r}")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the space in front of the first piece that says anything goes."""
        if not len(ids):
            return ""
        m = self.model
        parts, fresh, stops = [], True, np.flatnonzero(m.silent[ids])  # bytes on two sides of a silent id make no character
        for a, b in zip(np.r_[0, stops + 1].tolist(), np.r_[stops, len(ids)].tolist()):
            raw = b"".join(map(m.bytes_of.__getitem__, ids[a:b].tolist()))
            if b > a and fresh:
                raw, fresh = raw[int(m.leading[ids[a]]):], False
            parts.append(raw.decode("utf-8", "pathloom_one_each"))
        return "".join(parts)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, checked: bool = False) -> Encoder:
    """One encoder a Python worker and vocabulary; workers are used again for later tasks."""
    if (path, checked) not in _encoders:
        _encoders[path, checked] = Encoder(path, checked=checked)
    return _encoders[path, checked]


def encode(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens and ids of every whole text of ``docs`` (doc_id, text).

    A text falls apart where no piece of the vocabulary can span; each new segment is merged
    by its agenda.  With ``check`` the library encodes the new segments of every Arrow batch
    too, and another result raises.  A missing or empty text has no ids.  Rows repeated are
    encoded each, a missing doc_id stays missing, an empty table gives no rows, other columns go.
    """
    def run(batches):
        enc = encoder(path, check)
        for batch in batches:
            for at, n in parts(pc.binary_length(batch.column(1)).to_numpy()):
                piece = batch.slice(at, n)
                rows = enc.encode(piece.column(1).to_pylist())
                offsets = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
                yield pa.record_batch([piece.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))], ["doc_id", "n_tokens", "ids"])
    return texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (ids array<int>) with the column decoded: the text of the ids as the
    library gives it.  No or missing ids give the empty text; other columns stay."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([f for f in encoded.schema.fields if f.name != "decoded"] + [StructField("decoded", StringType())])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            batch = batch.select([f.name for f in schema.fields[:-1]])
            for at, n in parts(batch.column("ids").value_lengths().fill_null(0).to_numpy()):
                piece = batch.slice(at, n)
                flat, end, out = np.asarray(piece.column("ids").flatten()), 0, []
                for k in piece.column("ids").value_lengths().fill_null(0).to_pylist():
                    out.append(enc.decode(flat[end:end + k]))
                    end += k
                yield pa.record_batch([*piece.columns, pa.array(out, pa.string())], [f.name for f in schema.fields])
    return encoded.mapInArrow(run, schema)


def op13_sentence_pieces(spark, sf_dir):
    path = tokenizer_path(VOCABULARY)
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op13_sentence_pieces": op13_sentence_pieces}
