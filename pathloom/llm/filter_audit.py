"""How filters overlap, in every order, from a stream that retracts what later files change."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import scratch_dir, table
from pathloom.llm.exact_dedup import state_on_disk

LETTERS = "ABCDE"
A, B, C, D, E, GOOD, TOXIC = (1 << i for i in range(7))
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 200
BATCHES = 8           # micro-batches a call makes of the files that came, at most
TEXTS_A_KEY = 256     # texts that share a key of the state, on average, when its folder is new
LEAST_KEYS = 1024
ORDERS = ["".join(p) for p in permutations(LETTERS)]

NEWS = "key int, digest binary, doc_id long, part string, mask int, n long"
DELTAS = "part string, mask int, n long"
STATE = "digests binary, ids binary, masks binary, parts array<string>"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the failures A to D of every row as bits."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("t", SPACE, -1), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"))
    counted = rows.select("doc_id", "part", "t", words.alias("w")).select(
        "doc_id", "part", "t", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("distinct"))
    bit = lambda bad, b: F.when(bad, b).otherwise(0)
    return counted.select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"),
        (bit(F.col("n") < LEAST_WORDS, A) + bit(100 * F.col("distinct") < 50 * F.col("n"), B)
         + bit(100 * F.length(F.regexp_replace("t", "[^A-Z]+", "")) > 3 * F.length("t"), C)
         + bit(F.col("t").rlike("[#$%&*|]"), D)).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The bits of good and toxic documents added; a document counts once however often it is labelled."""
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("toxic")).where("good + toxic > 0")
    marked = marked.select(F.col("doc_id").alias("labelled"), F.lit(0).alias("salt"), (F.col("good") + F.col("toxic")).alias("bits"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(64)).cast("int")).otherwise(0)
    return rows.withColumn("dealt", spread).join(  # rows without doc_id find nothing, but not all in one task
        marked, (F.col("doc_id") == F.col("labelled")) & (F.col("dealt") == F.col("salt")), "left").select(
        "doc_id", "part", "digest", (F.col("mask") + F.coalesce("bits", F.lit(0))).alias("mask"))


def news(keys: int):
    """Rows of a task folded by digest: what keeps the least id, for the keyed state, and the
    number of rows that surely fail E, which need none.  Hot texts shrink here."""
    def run(batches):
        from pyspark import TaskContext

        own = -1 - TaskContext.get().partitionId() % LEAST_KEYS  # below 0: no text's key
        for pdf in batches:
            if pdf.empty:
                continue
            known = pdf["doc_id"].notna()
            ids = pdf["doc_id"].fillna(0).astype("int64")
            rows = pdf.assign(doc_id=ids)[known]
            least = rows.groupby("digest", sort=False)["doc_id"].transform("min")
            out = []
            first = rows[rows["doc_id"] == least].groupby(["digest", "doc_id", "part", "mask"], sort=False).size().reset_index(name="n")
            if len(first):
                head = np.frombuffer(b"".join(d[:4] for d in first["digest"]), ">u4").astype(np.int64)
                out.append(first.assign(key=(head * keys) >> 32))
            later = rows[rows["doc_id"] != least].assign(mask=lambda x: x["mask"] | E)
            sure = pd.concat([later, pdf[~known]])  # a row without id is never the copy of a smaller one
            if len(sure):
                out.append(sure.groupby(["part", "mask"], sort=False).size().reset_index(name="n").assign(
                    key=own, digest=b"", doc_id=0))
            yield pd.concat(out)[["key", "digest", "doc_id", "part", "mask", "n"]]
    return run


def fold(key, frames, state):
    """Least ids of the texts of one key: arrivals against the state, with what changes in the
    part counters.  A smaller id moves the earlier holder of the text under E."""
    change = Counter()
    if key[0] >= 0:
        held = {}
        if state.exists:
            digests, ids, masks, parts = state.get
            ids, masks = np.frombuffer(ids, np.int64), np.frombuffer(masks, np.int64).reshape(-1, 2)
            for i, (d, m, p) in enumerate(zip(ids.tolist(), masks.tolist(), parts)):
                held.setdefault(digests[32 * i:32 * i + 32], [d, Counter()])[1][p, m[0]] += m[1]
        for pdf in frames:
            for digest, d, part, mask, n in zip(pdf["digest"], pdf["doc_id"].tolist(), pdf["part"], pdf["mask"].tolist(), pdf["n"].tolist()):
                now = held.setdefault(bytes(digest), [d, Counter()])
                if d < now[0]:
                    for (p, m), k in now[1].items():
                        change[p, m] -= k
                        change[p, m | E] += k
                    now[:] = d, Counter()
                if d == now[0]:
                    now[1][part, mask] += n
                    change[part, mask] += n
                else:
                    change[part, mask | E] += n
        rows = [(g, d, p, m, k) for g, (d, c) in held.items() for (p, m), k in c.items()]
        state.update((b"".join(r[0] for r in rows), np.array([r[1] for r in rows], np.int64).tobytes(),
                      np.array([r[3:] for r in rows], np.int64).tobytes(), [r[2] for r in rows]))
    else:
        for pdf in frames:
            for part, mask, n in zip(pdf["part"], pdf["mask"].tolist(), pdf["n"].tolist()):
                change[part, mask] += n
    rows = [(p, m, n) for (p, m), n in change.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "n"]).astype({"mask": "int32", "n": "int64"})


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def counters(spark: SparkSession, path: str, labels: DataFrame, folder: str) -> DataFrame:
    """(part, mask, n): rows of the table at ``path`` by part, failures and labels.

    The files that ``folder`` (shared) hasn't seen yet are read as micro-batches.  ``state``
    below it keeps the least id of each text, without expiry, ``counters`` what each
    micro-batch changed; a batch that runs again after a failure writes its changes anew.
    """
    schema = spark.read.parquet(path).schema
    files = spark.read.parquet(path).inputFiles()
    sized = read_if_there(spark, f"{folder}/keys", "keys long")  # their number stays that of the first call
    if sized is None:
        keys = max(LEAST_KEYS, spark.read.parquet(path).count() // TEXTS_A_KEY)
        spark.createDataFrame([(keys,)], "keys long").coalesce(1).write.parquet(f"{folder}/keys")
    else:
        keys = sized.first()[0]
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", -(-max(1, len(files)) // BATCHES))
    place, name = path.rstrip("/").rsplit("/", 1)
    single = len(files) == 1 and files[0].rsplit("/", 1)[-1] == name  # a stream takes folders only
    stream = reader.option("pathGlobFilter", name).parquet(place) if single else reader.parquet(path)
    facts = with_labels(failures(stream), labels).mapInPandas(news(keys), NEWS)
    changes = facts.groupBy("key").applyInPandasWithState(fold, DELTAS, STATE, "update", "NoTimeout")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask").agg(F.sum("n").alias("n")).where("n <> 0").coalesce(1).write.mode(
            "overwrite").parquet(f"{folder}/counters/batch={number}")

    with state_on_disk(spark):
        changes.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(
            availableNow=True).start().awaitTermination()
    found = read_if_there(spark, f"{folder}/counters", DELTAS)
    if found is None:  # no file, no micro-batch
        return spark.createDataFrame([], DELTAS)
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")


def report(counted: DataFrame) -> DataFrame:
    """Every order and step of the filters for every part of ``counted`` (part, mask, n).

    A step is a letter behind a set of letters, of which there are 80; the orders take
    their steps from those.  A document counts under the first of its failures, so over all
    orders a filter removes it in 120 / failures of them."""
    steps = F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(1 << i).alias("bit"), F.lit(s).alias("before"))
                      for i, x in enumerate(LETTERS) for s in range(32) if not s >> i & 1])
    bare, has = F.col("mask") % 32, lambda b: F.col("mask").bitwiseAND(b) != 0
    fails = F.col("bare").bitwiseAND(F.col("bit")) != 0
    passed = F.col("bare").bitwiseAND(F.col("before")) == 0
    total = lambda cond, n="n": F.sum(F.when(cond, F.col(n)).otherwise(0))
    each = counted.select("part", "mask", "n", bare.alias("bare"), F.bit_count(bare).alias("failed"),
                          F.inline(steps)).groupBy("part", "letter", "before").agg(
        total(passed & ~fails).alias("kept"), total(passed & fails).alias("removed"), total(~passed & fails).alias("redundant"),
        total(F.col("bare") == F.col("bit")).alias("unique_fails"), total(passed & fails & has(GOOD)).alias("good_lost"),
        total(passed & fails & has(TOXIC)).alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr(f"{len(ORDERS)} div greatest(failed, 1)")).otherwise(0)).alias("shapley"))
    orders = counted.sparkSession.createDataFrame(
        [(o, k + 1, x, sum(1 << LETTERS.index(y) for y in o[:k])) for o in ORDERS for k, x in enumerate(o)],
        "filter_order string, step int, letter string, before int")  # 600 rows, always
    return each.join(F.broadcast(orders), ["letter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """Overlap of the five filters on the documents at ``path`` for every part and order.

    A: few words, B: few distinct ones, C: many capitals, D: signs, E: the text of a smaller
    doc_id.  Rows: part (lang, missing: empty), filter_order (120), step; kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.  ``folder`` (shared) keeps
    the state: a later call reads the files that came since and reports on all.

    A missing text is empty.  A row without doc_id has no smaller or larger one: it never
    fails E and fails nobody.  Rows repeated with one doc_id count each and don't fail each
    other.  A document labelled more than once is good or toxic if one label says so.  An
    empty table gives no rows; other columns go.
    """
    return report(counters(spark, path, labels, folder or scratch_dir(spark, "audit")))


def op11_filter_audit(spark, sf_dir):
    return audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


SQL = """
with words as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
facts as (
  select part,
         (case when len(w) < 200 then 1 else 0 end)
         + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
         + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 4 else 0 end)
         + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
         + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) as mask,
         doc_id in (select doc_id from labels where quality = 1) as good,
         doc_id in (select doc_id from labels where toxic = 1) as toxic
  from words),
counted as (
  select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from facts group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps as (
  select filter_order, cast(k as integer) as step, bits[k] as bit, cast(coalesce(list_sum(bits[1:k - 1]), 0) as integer) as before
  from orders, range(1, 6) r(k)),
each as (
  select part, filter_order, step, bit,
         sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
         sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
         sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant,
         sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end) as good_lost,
         sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
  from counted, steps group by part, filter_order, step, bit)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from each
"""

QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {"op11_filter_audit": SQL}
