"""Content sums of the source tables, and the conditions later stages rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pathloom.plans.registry import query
from pathloom.sources.provenance import content_sums

TABLES = {
    "region": "r_name r_regionkey",
    "nation": "n_name n_nationkey n_regionkey",
    "customer": "c_acctbal c_custkey c_mktsegment c_name c_nationkey",
    "supplier": "s_acctbal s_name s_nationkey s_suppkey",
    "part": "p_brand p_name p_partkey p_retailprice p_size p_type",
    "orders": "o_custkey o_orderdate o_orderkey o_orderpriority o_orderstatus o_totalprice",
    "lineitem": "l_discount l_extendedprice l_linenumber l_linestatus l_orderkey l_partkey l_quantity l_returnflag "
                "l_shipdate l_suppkey l_tax",
    "events": "event_id event_type props ts user_id value",
}
TIMES = {"o_orderdate", "l_shipdate", "ts"}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sums_sql(table: str) -> str:
    text = [f"epoch_us({c})" if c in TIMES else c for c in TABLES[table].split()]
    row = "concat_ws(chr(31), " + ", ".join(f"coalesce({t}::varchar, chr(30))" for t in text) + ")"
    words = ", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint) % 2305843009213693952, 0)::bigint w{i}"
                      for i in range(4))
    return f"select '{table}' table_name, count(*) n_rows, {words} from (select md5({row}) h from {table})"


@query("table_fingerprints", " union all ".join(map(_sums_sql, TABLES)))
def table_fingerprints(spark, sf):
    return reduce(lambda a, b: a.unionByName(b), [
        content_sums(spark.read.parquet(f"{sf}/{t}.parquet").select(*c.split())).select(F.lit(t).alias("table_name"), "*")
        for t, c in TABLES.items()])


@query("source_conditions", """
with l as (select count(*) n, count(*) filter (isfinite(l_quantity)) l_quantity,
             count(*) filter (isfinite(l_extendedprice)) l_extendedprice,
             count(*) filter (isfinite(l_discount)) l_discount, count(*) filter (isfinite(l_tax)) l_tax from lineitem),
r as (select 'lines of known orders' condition,
        (select count(*) from lineitem where l_orderkey in (select o_orderkey from orders)) observed, n expected from l
      union all select 'orders of known customers',
        (select count(*) from orders where o_custkey in (select c_custkey from customer)), count(*) from orders
      union all select 'lines by order and number',
        (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)), n from l
      union all select 'finite l_quantity', l_quantity, n from l
      union all select 'finite l_extendedprice', l_extendedprice, n from l
      union all select 'finite l_discount', l_discount, n from l
      union all select 'finite l_tax', l_tax, n from l)
select condition, observed, expected, observed = expected holds from r""")
def source_conditions(spark, sf):
    """Each condition with the rows that meet it and the rows there are."""
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    line, orders, customer = read("lineitem"), read("orders"), read("customer")
    n = F.count(F.lit(1)).alias("expected")

    def known(rows, key, other, other_key, name):
        """Counts of a key's rows come first, so a hot key is one row in the join."""
        keys = rows.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
        there = other.select(F.col(other_key).alias("k")).distinct().withColumn("there", F.lit(True))
        zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return keys.join(there, "k", "left").agg(zero(F.when(F.col("there"), F.col("rows"))).alias("observed"),
                                                 zero("rows").alias("expected")).select(F.lit(name).alias("condition"), "*")

    finite = line.agg(n, *[F.count(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), True)).alias(c) for c in MEASURES])
    finite = finite.select("expected", F.explode(F.array(*[
        F.struct(F.lit(f"finite {c}").alias("condition"), F.col(c).alias("observed")) for c in MEASURES])).alias("x"))
    once = line.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("rows")).agg(
        F.count(F.lit(1)).alias("observed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("expected"))
    rows = known(line, "l_orderkey", orders, "o_orderkey", "lines of known orders").unionByName(
        known(orders, "o_custkey", customer, "c_custkey", "orders of known customers")).unionByName(
        once.select(F.lit("lines by order and number").alias("condition"), "*")).unionByName(
        finite.select("x.condition", "x.observed", "expected"))
    return rows.select("condition", "observed", "expected", (F.col("observed") == F.col("expected")).alias("holds"))
