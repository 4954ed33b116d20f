"""Byte-level BPE: distinct words are encoded once for the whole corpus, then joined back."""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import table, texts
from pathloom.llm.pieces import split_pieces, tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 32_000_000  # text of a block of neighbouring documents, at most (one document at least)
AT_ONCE = 2_000_000       # characters whose pieces are looked up together
CHUNK = 200_000           # words encoded before their ids are sent off
MASK = (1 << 61) - 1

OUT_SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def pattern():
    """The pre-token pattern with white space as Unicode has it."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def word_encoder(path: str):
    """Ids of one pre-token by the ranks of ``path``."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path),
                             special_tokens={}).encode_ordinary


def _packed(codes: array) -> bytes:
    """Word codes of a document by byte planes, compressed."""
    import zstandard

    planes = np.frombuffer(codes.tobytes(), np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _mark(word: str, code: int) -> int:
    """What a word adds to the check sum of its block."""
    return (zlib.crc32(word.encode()) + 1) * (code + 1) & MASK


def _words_of(piece: str, find) -> list[str]:
    """Pre-tokens of a piece; the two commonest shapes need no pattern."""
    if piece[:1] == " ":
        if piece[1:].isalpha():
            return [piece]
        if piece[-1] in ".," and piece[1:-1].isalpha():
            return [piece[:-1], piece[-1]]
    return find(piece)


def _blocks(batches, with_codes: bool):
    """Pre-tokens with positions, block by block: (block, words in order of first use, check
    sum, doc ids, codes of each document if asked for)."""
    from pyspark import TaskContext

    find = pattern().findall
    task, made = TaskContext.get().partitionId(), 0
    index, pieces, ids, codes, held, chars, waiting = {}, {}, [], [], [], 0, 0

    def take():
        """Learn the pieces of the held documents in their order, and code the documents."""
        nonlocal held, waiting
        for p in dict.fromkeys(chain.from_iterable(held)):
            if p not in pieces:
                pieces[p] = array("I", [index.setdefault(w, len(index)) for w in _words_of(p, find)]).tobytes()
        if with_codes:
            codes.extend(b"".join(map(pieces.__getitem__, split)) for split in held)
        held, waiting = [], 0

    def close():
        take()
        check = 0
        for word, code in index.items():
            check = (check + _mark(word, code)) & MASK
        return (task << 24) + made, list(index), check, ids, codes

    for pdf in batches:
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            if chars and chars + len(text) > BLOCK_CHARS:
                yield close()
                made += 1
                index, pieces, ids, codes, chars = {}, {}, [], [], 0
            ids.append(doc)
            held.append(split_pieces(text) if text else [])
            chars += len(text)
            waiting += len(text)
            if waiting > AT_ONCE:
                take()
    if ids:
        yield close()


def block_words(docs: DataFrame) -> DataFrame:
    """(block, code, word): the distinct words of each block."""
    def run(batches):
        for block, words, _, _, _ in _blocks(batches, False):
            for at in range(0, len(words), CHUNK):
                part = words[at:at + CHUNK]
                yield pd.DataFrame({"block": np.int64(block), "code": np.arange(at, at + len(part), dtype=np.int32),
                                    "word": part})
    return texts(docs).mapInPandas(run, "block long, code int, word string")


def block_documents(docs: DataFrame) -> DataFrame:
    """(block, words, check, doc_id, codes): each document as the codes of its pre-tokens in order."""
    def run(batches):
        for block, words, check, ids, codes in _blocks(batches, True):
            for at in range(0, len(ids), 500):
                part = codes[at:at + 500]
                yield pd.DataFrame({"block": np.int64(block), "words": np.int64(len(words)), "check": np.int64(check),
                                    "doc_id": pd.array(ids[at:at + 500], "Int64") if pd.isna(ids[at:at + 500]).any()
                                    else ids[at:at + 500], "codes": [_packed(array("I", c)) for c in part]})
    return texts(docs).mapInPandas(run, "block long, words long, check long, doc_id long, codes binary")


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(block, entries): ids of the words of each block, many words a row.

    Rows are shuffled and sorted by word, so each distinct word is encoded once wherever it
    occurs, and its ids go to all blocks that have it; what goes to one block from one task
    is put together before the second shuffle."""
    def run(batches):
        import zstandard

        encode, last, ids = word_encoder(path), None, b""
        pack = zstandard.ZstdCompressor(level=3)

        def sent(held):
            rows = []
            for block, (codes, sizes, values, check) in held.items():
                head = np.array([len(codes), check], np.int64).tobytes()
                body = np.array(codes, np.uint32).tobytes() + np.array(sizes, np.uint32).tobytes() + b"".join(values)
                rows.append((block, head + pack.compress(body)))
            return pd.DataFrame(rows, columns=["block", "entries"])

        held, n = {}, 0
        for pdf in batches:
            for block, code, word in zip(pdf["block"].tolist(), pdf["code"].tolist(), pdf["word"]):
                if word != last:
                    last, ids = word, array("I", encode(word)).tobytes()
                own = held.setdefault(block, [[], [], [], 0])
                own[0].append(code)
                own[1].append(len(ids) // 4)
                own[2].append(ids)
                own[3] = (own[3] + _mark(word, code)) & MASK
                n += 1
                if n == CHUNK:
                    yield sent(held)
                    held, n = {}, 0
        if held:
            yield sent(held)
    return words.repartition("word").sortWithinPartitions("word").mapInPandas(run, "block long, entries binary")


def _reassembled(path: str, digests: bool):
    def run(docs: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        size = int(docs["words"].iloc[0]) if len(docs) else 0
        ids_of, check = [None] * size, 0
        for blob in entries["entries"]:
            n, part = np.frombuffer(blob[:16], np.int64)
            body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16:]), np.uint32)
            codes, sizes, values = body[:n].tolist(), body[n:2 * n], body[2 * n:].tolist()
            ends = np.cumsum(sizes).tolist()
            at = 0
            for code, end in zip(codes, ends):
                ids_of[code] = values[at:end]
                at = end
            check = (check + int(part)) & MASK
        if len(docs) and check != int(docs["check"].iloc[0]):
            raise ValueError("documents came in another order on the second reading; write them to a table first")
        bytes_of = {rank: token for token, rank in read_ranks(path).items()}
        if digests:
            decimal = [",".join(map(str, x)) for x in ids_of]
        decoded = [b"".join(map(bytes_of.__getitem__, x)) for x in ids_of]
        count = np.array([len(x) for x in ids_of], np.int64)
        rows = []
        for doc, blob in zip(docs["doc_id"], docs["codes"]):
            codes = _unpacked(blob)
            n, codes = int(count[codes].sum()), codes.tolist()
            back = hashlib.sha256(b"".join(map(decoded.__getitem__, codes))).hexdigest()
            if digests:
                text = ",".join(map(decimal.__getitem__, codes))
                rows.append((doc, n, None, hashlib.sha256(text.encode()).hexdigest(), back))
            else:
                rows.append((doc, n, [i for c in codes for i in ids_of[c]], None, back))
        out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        return out.astype({"doc_id": "Int64"})
    return run


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Ids of every text of ``docs`` (doc_id, text) by the ranks of ``path``: doc_id, n_tokens,
    ids (with ``digests`` their SHA-256 in place of them) and the SHA-256 of the decoded bytes.

    Neighbouring documents make a block with a table of its distinct words.  The tables are
    shuffled by word and each word is encoded once; the ids return to their blocks and each
    text is put together by position.  The two readings of ``docs`` must give one order
    (files do, a shuffle may not); a check sum of each block raises otherwise.

    A missing or empty text has no ids.  Repeated rows are encoded each; a missing doc_id
    stays missing; an empty table gives no rows; other columns go.
    """
    left, right = block_documents(docs), encoded_words(block_words(docs), path)
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(_reassembled(path, digests), OUT_SCHEMA)


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, token): the bytes of each id."""
    rows = sorted((rank, bytearray(token)) for token, rank in read_ranks(path).items())
    return spark.createDataFrame(rows, "id int, token binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of every (doc_id, ids): ids join the token table, which has the size of
    the vocabulary, and come together again by position.  No ids give no bytes; missing ids
    count as none; an id without a token raises."""
    tokens = F.broadcast(token_table(encoded.sparkSession, path))
    marked = encoded.select("doc_id", "ids").withColumn("row", F.xxhash64("ids"))
    each = marked.select("doc_id", "row", F.posexplode_outer("ids").alias("pos", "id")).distinct().join(tokens, "id", "left")
    each = each.withColumn("hex", F.when(F.col("id").isNull(), "").otherwise(
        F.coalesce(F.hex("token"), F.raise_error(F.concat(F.lit("no token "), F.col("id").cast("string"))))))
    return each.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("pos", F.lit(0)).alias("pos"), "hex"))).alias("x")).select(
        "doc_id", F.unhex(F.array_join(F.col("x.hex"), "")).alias("bytes"))


def op6_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY), digests=True).drop("ids")


QUERIES = {"op6_bpe": op6_bpe}
