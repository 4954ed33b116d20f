"""Order-free document fingerprints: sums of wide vectors hashed from paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import table, texts, written

SUMS = 16      # 32-bit lanes of a paragraph's SHA-512, summed modulo 2^32
LANES = 21     # counters of one 64-bit unit hash share a long, three at a time, modulo 2^21
HASHES = 2     # unit hashes; 3 * LANES * HASHES counters in all
UNIT = "[^\\n.,;:!?]{1,64}"
LOW32, LOW21 = (1 << 32) - 1, (1 << 21) - 1
ONES = 1 | 1 << 21 | 1 << 42  # the lowest bit of each of the three counters in a long
TOPS = ONES << 20              # and the highest
BLOCK = 1 << 20                # units whose counts fit into a counter


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row, not at every use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _add_counters(a: Column, b: Column) -> Column:
    """Sum of two packed longs, each counter modulo 2^21: no carry leaves a counter."""
    low = lambda x: x.bitwiseAND(F.lit(~TOPS))
    return (low(a) + low(b)).bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(F.lit(TOPS)))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text: struct of ``sums``, ``marks`` and ``units``.

    A paragraph (a line that is not empty) gives a wide vector: the 16 words of its SHA-512,
    and for each short unit in it 126 hash bits as counters.  Vectors are added up, words
    modulo 2^32, counters modulo 2^21.  So order has no effect, the fingerprint of two texts
    put together as separate paragraphs is the sum of theirs (``joined``), and a paragraph is
    taken out by subtraction (``without``).  A missing text counts as empty.  Units are added
    up in blocks that cannot fill a counter, so a text may have any number of them.
    """
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.filter(F.split(text, "\n", -1), lambda p: p != "")
    sums = _bound(F.transform(paragraphs, lambda p: F.sha2(p, 512)), lambda digests: F.transform(
        F.sequence(F.lit(0), F.lit(SUMS - 1)), lambda j: F.aggregate(
            digests, F.lit(0).cast("long"),
            lambda a, d: (a + F.conv(F.substr(d, j * 8 + 1, F.lit(8)), 16, 10).cast("long")).bitwiseAND(F.lit(LOW32)))))

    def blocks(hashes):
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(hashes) / BLOCK).cast("int")),
                           lambda i: F.slice(hashes, i * BLOCK + 1, F.lit(BLOCK)))

    def counters(blocked):
        return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda j: F.aggregate(
            blocked, F.lit(0).cast("long"), lambda total, block: _add_counters(total, F.aggregate(
                block, F.lit(0).cast("long"),
                lambda a, h: a + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(ONES))))))

    def marks(units, k):
        return _bound(F.transform(units, lambda u: F.xxhash64(u, F.lit(k))), lambda hashes: _bound(blocks(hashes), counters))

    counted = _bound(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda units: F.struct(
        F.concat(*[marks(units, k) for k in range(HASHES)]).alias("marks"), F.size(units).cast("long").alias("units")))
    return _bound(counted, lambda c: F.struct(sums.alias("sums"), c["marks"].alias("marks"), c["units"].alias("units")))


def _counters(marks: Column) -> Column:
    """The 21-bit counters of the packed longs."""
    return F.flatten(F.transform(marks, lambda m: F.array(*[
        F.shiftright(m, 21 * k).bitwiseAND(F.lit(LOW21)) for k in range(3)])))


def _combined(a: Column, b: Column, sign: int) -> Column:
    words = F.zip_with(a["sums"], b["sums"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW32)))
    marks = F.zip_with(a["marks"], b["marks"], lambda x, y: F.aggregate(
        F.sequence(F.lit(0), F.lit(42), F.lit(21)), F.lit(0).cast("long"), lambda acc, k: acc + F.call_function(
            "shiftleft", (F.call_function("shiftright", x, k).bitwiseAND(F.lit(LOW21))
                          + sign * F.call_function("shiftright", y, k).bitwiseAND(F.lit(LOW21))
                          ).bitwiseAND(F.lit(LOW21)), k)))
    return F.struct(words.alias("sums"), marks.alias("marks"), (a["units"] + sign * b["units"]).alias("units"))


def joined(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _combined(a, b, 1)


def without(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of ``a`` less those of ``b``."""
    return _combined(a, b, -1)


def as_hex(fp: Column) -> Column:
    """The whole fingerprint as lowercase hex."""
    word = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(F.array_join(F.transform(fp["sums"], lambda x: word(x, 8)), ""),
                    F.array_join(F.transform(fp["marks"], lambda x: word(x, 16)), ""), word(fp["units"], 8))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of equal units, 0 to 1: the cosine of the counters about their means,
    with a standard error of about 0.09; equal fingerprints give 1, and so do two without units.
    Counters of a text with more than 2,097,151 units may have gone round: equality still
    holds there, its likeness to other texts says nothing."""
    def signed(fp):
        return F.transform(_counters(fp["marks"]), lambda c: (2 * c - fp["units"]).cast("double"))

    def product(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    x, y = signed(a), signed(b)
    size = F.sqrt(product(x, x) * product(y, y))
    cosine = F.when(size > 0, product(x, y) / size).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def successors(keys: DataFrame) -> DataFrame:
    """(doc_id, h, n) with the (next_id, next_h) of the row after it by (doc_id, h); the first
    one follows the last.  Rows are dealt by range; only the first row of each range travels
    to its neighbour, so no task sees all of them."""
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(keys.repartitionByRange(parts, "doc_id", "h").withColumn("part", F.spark_partition_id()), "order")
    first = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    heads = sorted(((r["part"], r["first"]["doc_id"], r["first"]["h"]) for r in first.collect()))  # one a partition
    follow = [(heads[i][0], *heads[(i + 1) % len(heads)][1:]) for i in range(len(heads))]
    follow = spark.createDataFrame(follow, "part int, follow_id long, follow_h long")
    inside = F.lead(F.struct("doc_id", "h")).over(
        _window_by_part())
    out = ranged.withColumn("inner", inside).join(F.broadcast(follow), "part")
    return out.select(
        "doc_id", "h", "n",
        F.when(F.col("inner").isNotNull(), F.col("inner.doc_id")).otherwise(F.col("follow_id")).alias("next_id"),
        F.when(F.col("inner").isNotNull(), F.col("inner.h")).otherwise(F.col("follow_h")).alias("next_h"))


def _window_by_part():
    from pyspark.sql import Window

    return Window.partitionBy("part").orderBy("doc_id", "h")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_fp and edited text of every document.

    The edited text swaps the last floor(n / 2) characters for the first as many of the next
    document by doc_id (all of it if shorter; the first document follows the last; a sole one
    follows itself).  A missing text is empty.  Rows with one doc_id and different texts are
    documents of their own, in the order of a text hash; rows repeated whole share one place.
    A missing doc_id comes first.
    """
    base = texts(docs).withColumn("h", F.xxhash64("text")).withColumn("fp", fingerprint(F.col("text")))
    keys = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n"))
    link = written(successors(keys.distinct()), "successor")
    before = link.select(F.col("next_id").alias("i"), F.col("next_h").alias("k"),
                         F.col("doc_id").alias("prev_id"), F.col("h").alias("prev_h"),
                         F.floor(F.col("n") / 2).cast("int").alias("half"))
    lent = base.join(before, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select(
        "prev_id", "prev_h", "half", F.expr("substring(text, 1, half)").alias("lent"), F.col("fp").alias("next_fp"))
    if link.count() != docs.count():  # rows repeated whole
        lent = lent.dropDuplicates(["prev_id", "prev_h"])
    return base.join(lent, F.col("doc_id").eqNullSafe(F.col("prev_id")) & (F.col("h") == F.col("prev_h"))).select(
        "doc_id", "text", "fp", "next_fp",
        F.expr("concat(substring(text, 1, length(text) - half), lent)").alias("edited"))


def op3_fingerprints(spark, sf_dir):
    both = edited(table(spark, sf_dir, "documents")).withColumn("edited_fp", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
