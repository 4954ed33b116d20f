"""Periodic runs of words in each document: seeds on diagonals, extended once per lag."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import table

LEAST_LENGTH, LEAST_PERIODS = 24, 3
SEED = 16                  # words; two copies of a run's words one period apart share as many at least
SLICE_BYTES = 4_000_000    # text whose words are indexed together (one document at least)
STRETCH = 64               # words compared at first when a seed is extended, doubled each time

RUNS = "array<struct<start:long,length:long,period:long>>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def seeds(words: np.ndarray):
    """(lag, place): places whose seed occurs again ``lag`` words on and not before.

    ``words`` holds a number for each word of each document, another one in every document.
    Lags up to 16 are indexed by the 16-grams that any run of such a period repeats, lags in
    (k / 2, k] for k = 32, 64, ... by k-grams: a run of period q repeats 2 q >= k words at
    lag q, and as k >= q no k-gram within it comes again any sooner.  A 2k-gram is a pair of
    k-grams, and only those can repeat whose halves do, so each step looks at what is left.
    """
    n, k = len(words), 1
    gram = words.astype(np.int64)
    lags, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = np.flatnonzero(np.bincount(gram, minlength=1)[gram] > 1) if n else np.empty(0, np.int64)
    while len(at) > 1:
        if k >= SEED:
            order = at[np.argsort(gram[at], kind="stable")]
            lag = np.diff(order)
            near = (gram[order[1:]] == gram[order[:-1]]) & (lag <= k) & (lag > (0 if k == SEED else k // 2))
            lags.append(lag[near])
            places.append(order[:-1][near])
        live = np.full(n, -1, np.int64)
        live[at] = gram[at]
        at = at[at < n - k]
        at = at[live[at + k] >= 0]
        if not len(at):
            break
        _, number, count = np.unique(live[at] * (live.max() + 1) + live[at + k], return_inverse=True, return_counts=True)
        gram[at] = number
        at = at[count[number] > 1]
        k *= 2
    return np.concatenate(lags), np.concatenate(places)


def _same(words: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """How many words from ``a`` and from ``b`` on are the same, ``most`` at most; step -1: backwards."""
    done, size = 0, STRETCH
    while done < most:
        size = min(size, most - done)
        x, y = (words[a + done:a + done + size], words[b + done:b + done + size]) if step > 0 else (
            words[a - done - size + 1:a - done + 1][::-1], words[b - done - size + 1:b - done + 1][::-1])
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, size = done + size, size * 2
    return done


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    lags, places = seeds(words)
    by = np.lexsort((places, lags))
    found, lag, covered = [], 0, 0
    for q, i in zip(lags[by].tolist(), places[by].tolist()):
        if q != lag:
            lag, covered = q, 0
        if i < covered:
            continue  # within a stretch of this lag that was extended before
        back = _same(words, i - 1, i + q - 1, -1, i)
        forth = _same(words, i, i + q, 1, len(words) - i - q)
        covered = i + forth
        start, length = i - back, back + forth + q
        if length >= max(LEAST_LENGTH, LEAST_PERIODS * q):
            found.append((start, length, q))
    return sorted((s, n, q) for s, n, q in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start and period) and the text without
    repetitions of every document of ``docs`` (doc_id, text).

    Words are stretches without ASCII white space.  A run is a longest stretch of words with a
    smallest period q, of at least 24 words and 3 q.  collapsed: the words that no run holds
    behind its first q ones, joined by a space.  Whole texts are read, many at a time.

    A missing or empty text has no words and no runs.  Rows repeated are searched each; a
    missing doc_id stays missing; an empty table gives no rows; other columns go.
    """
    def slices(sizes):
        first, held = 0, 0
        for i, n in enumerate(sizes):
            if i > first and held + n > SLICE_BYTES:
                yield first, i
                first, held = i, 0
            held += n
        if len(sizes) > first:
            yield first, len(sizes)

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).fill_null(b"").to_pylist()
            for a, b in slices(list(map(len, sizes))):
                split = [t.split() for t in sizes[a:b]]
                ends = np.cumsum([len(w) for w in split]).tolist()
                flat, base = np.empty(ends[-1], np.int64), 0
                for w, end in zip(split, ends):  # each document numbers its words anew
                    number = dict(zip(dict.fromkeys(w), range(base, base + len(w))))
                    flat[end - len(w):end] = [number[x] for x in w]
                    base += len(number)
                mine = [[] for _ in split]
                starts = np.array([end - len(w) for w, end in zip(split, ends)])
                for s, n, q in runs_of(flat):
                    d = int(np.searchsorted(ends, s, "right"))
                    mine[d].append((s - int(starts[d]), n, q))
                text = []
                for w, runs in zip(split, mine):
                    if runs:
                        gone = np.zeros(len(w) + 1, np.int64)
                        for s, n, q in runs:
                            gone[s + q] += 1
                            gone[s + n] -= 1
                        w = [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    text.append(b" ".join(w))
                flat_runs = list(chain.from_iterable(mine))
                fields = [pa.array([r[i] for r in flat_runs], pa.int64()) for i in range(3)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(m) for m in mine])].astype(np.int32)),
                                                 pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([len(w) for w in split], pa.int64()), lists,
                                       pa.array(text, pa.binary()).cast(pa.string())],
                                      ["doc_id", "n_words", "runs", "collapsed"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by a CRC-32 of their doc_id, end in a
    stretch of their own words that comes again and again."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc.alias("h")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", WORD_BREAK, -1), lambda w: w != "")))
    n, g = F.size("w"), F.expr("h div 10")
    rows = rows.select("doc_id", "text", "w", n.alias("n"), g.alias("g")).withColumn(
        "a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int"))).withColumn(
        "p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " ")).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = find(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.reduce("runs", F.expr("cast(null as struct<start:long,length:long,period:long>)"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
