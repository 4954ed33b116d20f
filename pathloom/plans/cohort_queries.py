"""Cohort comparison, target similarity and communication-mode attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathloom.functions.columns import count_bin, length_bin
from pathloom.operators import attribution as At
from pathloom.operators import cohort as C
from pathloom.operators import folds as Fo
from pathloom.operators import similarity as Q
from pathloom.operators.reshape import fill_keys
from pathloom.plans import fixture as fx
from pathloom.plans.fixture import WITH_PATH
from pathloom.plans.registry import query
from pathloom.session import materialize

LANGS = ["de", "en", "es", "fr"]

# ---- cohorts: documents of the first and second half of the sources -------------------

COH_SQL = """with doc as (
  select doc_id, lang, source, n_chars, len(text)::bigint n_text,
         case when regexp_extract(source, '(\\d+)', 1)::int < 10 then 'A' else 'B' end cohort,
         case when n_chars < 500 then 1 when n_chars < 1500 then 3 when n_chars < 3000 then 6
              when n_chars < 6000 then 10 else 11 end lb
  from documents)"""


def docs(spark, sf):
    n = F.col("n_chars")
    return fx.table(spark, sf, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("n_text"),
        F.when(F.regexp_extract("source", r"(\d+)", 1).cast("int") < 10, "A").otherwise("B")
        .alias("cohort"),
        F.when(n < 500, 1).when(n < 1500, 3).when(n < 3000, 6).when(n < 6000, 10).otherwise(11)
        .alias("lb"))


def _smd_sql(name: str, x: str) -> str:
    return f"""select '{name}' variable, round(case when coalesce(va + vb, 0) > 0
      then (ma - mb) / sqrt((va + vb) / 2) else 0 end, 6) smd from (
      select avg(x) filter (cohort = 'A') ma, avg(x) filter (cohort = 'B') mb,
        var_samp(x) filter (cohort = 'A') va, var_samp(x) filter (cohort = 'B') vb
      from (select cohort, ({x})::double x from doc))"""


SMD_VARS = {"n_chars": "n_chars", "lb": "lb", **{f"lang_{k}": f"(lang = '{k}')::int" for k in LANGS}}
SMD_SQL = COH_SQL + ", smd as (" + " union all ".join(
    _smd_sql(n, x) for n, x in SMD_VARS.items()) + ")"


def smd(spark, sf):
    v = {"n_chars": F.col("n_chars"), "lb": F.col("lb"),
         **{f"lang_{k}": (F.col("lang") == k).cast("int") for k in LANGS}}
    return C.smd_columns(docs(spark, sf), "cohort", "A", "B", v).withColumn(
        "smd", F.round("smd", 6))


@query("smd_table", SMD_SQL + "select variable, smd from smd")
def smd_table(spark, sf):
    return smd(spark, sf)


@query("smd_blocks", SMD_SQL + """
select split_part(variable, '_', 1) block, max(abs(smd)) max_abs_smd from smd group by 1""")
def smd_blocks(spark, sf):
    return C.max_abs_smd(smd(spark, sf), F.split("variable", "_")[0])


MATCH_SQL = COH_SQL + """,
sz as (select lang, lb, count(*) filter (cohort = 'A')::bigint n_a,
         count(*) filter (cohort = 'B')::bigint n_b from doc group by all having n_a > 0 and n_b > 0),
rk as (select *, row_number() over (partition by lang, lb, cohort
         order by sha256('match|' || doc_id), doc_id) i from doc)"""


@query("stratum_sizes", MATCH_SQL + """
select lang, lb, n_a, n_b, least(n_a, n_b)::bigint n_matched from sz""")
def stratum_sizes(spark, sf):
    return C.stratum_sizes(docs(spark, sf), "cohort", "A", "B", ["lang", "lb"])


@query("stratified_match", MATCH_SQL + """
select doc_id, cohort, lang, lb from rk join sz using (lang, lb) where i <= least(n_a, n_b)""")
def stratified_match(spark, sf):
    return C.stratified_match(docs(spark, sf), "cohort", "A", "B", ["lang", "lb"], "doc_id",
                              "match").select("doc_id", "cohort", "lang", "lb")


@query("lodo_split", COH_SQL + """,
n as (select cohort, count(*) n from doc group by 1)
select doc_id, cohort, case when row_number() over (partition by cohort
     order by sha256('lodo|' || doc_id), doc_id) <=
     round(case when cohort = 'A' then 0.8 else 0.5 end * n - 1e-9) then 'train' else 'test' end role
from doc join n using (cohort)""")
def lodo_split(spark, sf):
    return Fo.source_split(docs(spark, sf), "cohort", "doc_id", {"A": 0.8, "B": 0.5}, "lodo")


@query("pair_overlap", """
with p as (select distinct o_custkey c, l_suppkey s, l_returnflag f
           from lineitem join orders on o_orderkey = l_orderkey where l_returnflag in ('R', 'A')),
u as (select c, s, max((f = 'R')::int) a, max((f = 'A')::int) b from p group by all)
select sum(a)::bigint n_a, sum(b)::bigint n_b, sum(a * b)::bigint n_common from u""")
def pair_overlap(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    j = li.where(F.col("l_returnflag").isin("R", "A")).join(
        o, F.col("l_orderkey") == F.col("o_orderkey"))
    side = lambda f: j.where(F.col("l_returnflag") == f).select("o_custkey", "l_suppkey")
    return C.pair_overlap(side("R"), side("A"), ["o_custkey", "l_suppkey"])


@query("binning", """
select case when l_linenumber <= 1 then '1' when l_linenumber <= 3 then '2-3'
       when l_linenumber <= 6 then '4-6' when l_linenumber <= 10 then '7-10' else '>10' end l_bin,
  case when l_quantity <= 1 then '1' when l_quantity <= 5 then '2-5' when l_quantity <= 20 then '6-20'
       else '>20' end n_bin, count(*)::bigint n, count(distinct l_suppkey)::bigint n_supp
from lineitem group by all""")
def binning(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.groupBy(length_bin(F.col("l_linenumber")).alias("l_bin"),
                      count_bin(F.col("l_quantity")).alias("n_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("n_supp"))


@query("summary_tables", SMD_SQL + """
select 'rows by cohort' section, cohort as name, count(*)::double as value from doc group by cohort
union all select 'balance', variable, smd from smd
union all select 'rows by language', lang, count(*) from doc group by lang""")
def summary_tables(spark, sf):
    d = docs(spark, sf)
    n = lambda c: d.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return C.summary({"rows by cohort": n("cohort"),
                      "balance": smd(spark, sf).toDF("name", "value"),
                      "rows by language": n("lang")}, "name", "value")


@query("crosstab", """
select source, count(*) filter (lang = 'de')::bigint de, count(*) filter (lang = 'en')::bigint en,
  count(*) filter (lang = 'es')::bigint es, count(*) filter (lang = 'fr')::bigint fr
from documents group by source""")
def crosstab(spark, sf):
    d = fx.table(spark, sf, "documents").groupBy("source").pivot("lang", LANGS).count()
    return d.na.fill(0)


@query("count_matrix_filled", """
with k as (select a.n_nationkey c, b.f from nation a, (select unnest(['A', 'N', 'R']) f) b),
n as (select c_nationkey c, l_returnflag f, count(*) n from lineitem
      join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by all)
select k.c, k.f, coalesce(n, 0)::bigint n from k left join n using (c, f)""")
def count_matrix_filled(spark, sf):
    keys = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c"), F.explode(F.array(*map(F.lit, "ANR"))).alias("f"))
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("f"))
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = fx.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("c"))
    n = (li.groupBy("l_orderkey", "f").count()
         .join(o.join(c, F.col("o_custkey") == F.col("c_custkey")),
               F.col("l_orderkey") == F.col("o_orderkey"))
         .groupBy("c", "f").agg(F.sum("count").alias("n")))
    return fill_keys(n, keys, ["c", "f"], 0)


@query("name_cleanup", """
select p_partkey, replace(p_name, '''', '') p_name,
  case p_brand when 'Brand#1' then 'Brand#01' when 'Brand#2' then 'Brand#02' else p_brand end p_brand,
  coalesce(regexp_matches(p_type, '(?i)econ|prom'), false) limbic,
  contains(p_name, 'red') or contains(p_name, 'ring') listed
from part""")
def name_cleanup(spark, sf):
    p = fx.table(spark, sf, "part")
    return p.select(
        "p_partkey", F.regexp_replace("p_name", "'", "").alias("p_name"), "p_brand",
        F.coalesce(F.col("p_type").rlike("(?i)econ|prom"), F.lit(False)).alias("limbic"),
        F.exists(F.array(F.lit("red"), F.lit("ring")), lambda s: F.contains(F.col("p_name"), s))
        .alias("listed")).replace({"Brand#1": "Brand#01", "Brand#2": "Brand#02"}, subset=["p_brand"])


# ---- targets: labels of the vectors, four features each -------------------------------
# a feature is the mean of a quarter of the vector, so all 64 dimensions take part

COLS = ["f1", "f2", "f3", "f4"]
REFERENCE = 0  # label of the reference group

EMB_SQL = "with emb as (select vec_id, label, " + ", ".join(
    f"list_sum(list_transform(embedding[{16 * i + 1}:{16 * i + 16}], lambda v: v::double)) / 16 f{i + 1}"
    for i in range(4)) + """ from embeddings),
mv as (select label, count(*)::bigint n, avg(f1) f1, avg(f2) f2, avg(f3) f3, avg(f4) f4
       from emb group by label)"""


def vectors(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[(F.aggregate(
        F.slice("embedding", 16 * i + 1, 16), F.lit(0.0), lambda a, v: a + v.cast("double")) / 16).alias(c)
        for i, c in enumerate(COLS)])


@query("group_means", EMB_SQL + """
select label, n, round(f1, 6) f1, round(f2, 6) f2, round(f3, 6) f3, round(f4, 6) f4 from mv""")
def group_means(spark, sf):
    m = Q.mean_vectors(vectors(spark, sf), "label", COLS)
    return m.select("label", "n", *[F.round(c, 6).alias(c) for c in COLS])


@query("target_selection", """
with r as (select p_brand || '_' || p_type region, count(*)::bigint n from lineitem join part on p_partkey = l_partkey
           group by 1 having count(*) >= 50),
t as (select region, n, case when regexp_matches(region, '(?i)econ') then 'personalized'
        when contains(region, 'PROMO') or contains(region, 'SMALL') then 'conventional'
        when contains(region, 'STAND') then 'control' end target_type from r),
k as (select *, row_number() over (partition by target_type order by n desc, region) pos from t
      where target_type is not null)
select target_type, region, n, pos::int pos from k where pos <= 10""")
def target_selection(spark, sf):
    named = fx.table(spark, sf, "part").select("p_partkey", F.concat_ws("_", "p_brand", "p_type").alias("region"))
    p = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(named, "p_partkey").select("region")
    r = F.col("region")
    any_of = lambda *names: F.exists(F.array(*map(F.lit, names)), lambda s: F.contains(r, s))
    return Q.select_targets(p, "region", {
        "personalized": r.rlike("(?i)econ"), "conventional": any_of("PROMO", "SMALL"),
        "control": any_of("STAND")})


DISP_SQL = EMB_SQL + """,
ref as (select f1 r1, f2 r2, f3 r3, f4 r4 from mv where label = 0),
api as (select label, avg(((least(1, greatest(0, (abs(f1-r1)+abs(f2-r2)+abs(f3-r3)+abs(f4-r4))/4))
          < 0.2)::int)) normal from emb, ref group by label),
mo as (select mv.*, 0.758*f1+0.242*r1 m1, 0.758*f2+0.242*r2 m2, 0.758*f3+0.242*r3 m3,
         0.758*f4+0.242*r4 m4, r1, r2, r3, r4 from mv, ref),
d as (select *, least(1, greatest(0, (abs(f1-r1)+abs(f2-r2)+abs(f3-r3)+abs(f4-r4))/4)) b,
  least(1, greatest(0, (abs(m1-r1)+abs(m2-r2)+abs(m3-r3)+abs(m4-r4))/4)) a from mo)"""


@query("displacement_sr", DISP_SQL + """
select label, n, round(b, 6) index_before, round(a, 6) index_after,
  round(case when b > 0 then least(1, greatest(0, (b - a) / b)) else 0 end, 6) cr,
  round((m1*r1+m2*r2+m3*r3+m4*r4) / (sqrt(m1*m1+m2*m2+m3*m3+m4*m4) * sqrt(r1*r1+r2*r2+r3*r3+r4*r4)), 6) sr,
  round(1 - normal, 6) si
from d join api using (label) where n >= 10""")
def displacement_sr(spark, sf):
    v = vectors(spark, sf)
    ref = v.where(F.col("label") == REFERENCE).agg(*[F.avg(c).alias(c) for c in COLS]).first()
    d = Q.displacement(v, "label", COLS, [ref[c] for c in COLS])
    return d.select("label", "n", *[F.round(c, 6).alias(c) for c in
                                    ("index_before", "index_after", "cr", "sr", "si")])


@query("alpha_sensitivity", DISP_SQL.replace("0.758", "(1-al)").replace("0.242", "al").replace(
    "from mv, ref)", "from mv, ref, al)").replace("mo as (select mv.*", "mo as (select mv.*, al")
    .replace("mo as (", "al as (select unnest([0.1, 0.242, 0.5]) al), mo as (") + """,
s as (select al, label, round((m1*r1+m2*r2+m3*r3+m4*r4)
  / (sqrt(m1*m1+m2*m2+m3*m3+m4*m4) * sqrt(r1*r1+r2*r2+r3*r3+r4*r4)), 6) sr from d)
select al::double alpha, string_agg(label::varchar, ' > ' order by sr desc, label) ranking
from s group by al""")
def alpha_sensitivity(spark, sf):
    v = materialize(vectors(spark, sf))
    ref = v.where(F.col("label") == REFERENCE).agg(*[F.avg(c).alias(c) for c in COLS]).first()
    out = None
    for a in (0.1, 0.242, 0.5):
        d = Q.displacement(v, "label", COLS, [ref[c] for c in COLS], a, min_rows=1)
        d = d.select(F.lit(a).alias("alpha"), "label", F.round("sr", 6).alias("sr"))
        out = d if out is None else out.unionByName(d)
    return Q.ranking_text(out, ["alpha"], "label", "sr")


def mean_arrays(spark, sf):
    return Q.mean_vectors(vectors(spark, sf), "label", COLS).select(
        "label", F.array(*COLS).alias("vec"))


PAIR_SQL = EMB_SQL + """,
pr as (select a.label a, b.label b, a.f1*b.f1+a.f2*b.f2+a.f3*b.f3+a.f4*b.f4 dot,
   sqrt(a.f1^2+a.f2^2+a.f3^2+a.f4^2) na, sqrt(b.f1^2+b.f2^2+b.f3^2+b.f4^2) nb,
   sqrt((a.f1-b.f1)^2+(a.f2-b.f2)^2+(a.f3-b.f3)^2+(a.f4-b.f4)^2) dist from mv a, mv b)"""


@query("cosine_matrix", PAIR_SQL + "select a, b, round(dot / (na * nb), 6) cosine from pr")
def cosine_matrix(spark, sf):
    p = Q.pairwise(mean_arrays(spark, sf), "label", "vec")
    return Q.cosine_matrix(p).withColumn("cosine", F.round("cosine", 6))


@query("cosine_matrix_by_dimension", PAIR_SQL + "select a, b, round(dot / (na * nb), 6) cosine from pr")
def cosine_matrix_by_dimension(spark, sf):
    p = Q.pairwise(mean_arrays(spark, sf), "label", "vec", limit=0)
    return Q.cosine_matrix(p).withColumn("cosine", F.round("cosine", 6))


@query("distance_invariance", PAIR_SQL + """
select a, b, round(dist, 6) dist_raw, round(0.758 * dist, 6) dist_moved, true scales from pr""")
def distance_invariance(spark, sf):
    m = materialize(mean_arrays(spark, sf))
    ref = m.where(F.col("label") == REFERENCE).first()["vec"]
    moved = m.withColumn("vec", F.zip_with(
        "vec", Q._literal(ref), lambda x, r: Q.displace(x, r)))
    raw = Q.distance_matrix(Q.pairwise(m, "label", "vec"))
    mod = Q.distance_matrix(Q.pairwise(moved, "label", "vec")).withColumnRenamed("dist", "mod")
    return raw.join(mod, ["a", "b"]).select(
        "a", "b", F.round("dist", 6).alias("dist_raw"), F.round("mod", 6).alias("dist_moved"),
        (F.abs(F.col("mod") - (1 - Q.ALPHA) * F.col("dist")) < 1e-7).alias("scales"))


@query("target_zscores", EMB_SQL + """
select label, n, """ + ", ".join(
    f"round(({c} - avg({c}) over ()) / stddev_samp({c}) over (), 6) {c}" for c in COLS) + " from mv")
def target_zscores(spark, sf):
    z = Q.zscore_columns(materialize(Q.mean_vectors(vectors(spark, sf), "label", COLS)), COLS)
    return z.select("label", "n", *[F.round(c, 6).alias(c) for c in COLS])


def tail_sql(f: str, d1: str, d2: str, steps: int = 20_000) -> str:
    """Upper tail of F by Simpson's rule on the beta integral, with t = u^2 against the pole at 0."""
    return f"""(select 1 - 2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0))
      * sum(w * pow(u, {d1} - 1.0) * pow(1 - u * u, {d2} / 2.0 - 1)) * min(h) / 3
      from (select i * top / {steps} u, top / {steps} h, case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end w
            from (select sqrt({d1} * {f} / ({d1} * {f} + {d2})) top), range({steps + 1}) r(i)))"""


NORMAL_SQL = """(select 1 - 2 / sqrt(2 * pi()) * sum(w * exp(-x * x / 2)) * min(h) / 3
      from (select i * {z} / 2000 x, {z} / 2000 h, case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end w
            from range(2001) r(i)))"""


@query("anova_f", """
with g as (select event_type, count(*) n, sum(value) s, sum(value*value) q from events group by 1),
t as (select sum(n)::bigint n, count(*)::bigint k, sum(s*s/n) - sum(s)*sum(s)/sum(n) b,
        sum(q - s*s/n) w from g)
select n, k, round(b, 3) ss_between, round(w, 3) ss_within, round((b/(k-1))/(w/(n-k)), 6) f,
       round(b/(b+w), 9) eta_sq, round(""" + tail_sql("((b/(k-1))/(w/(n-k)))", "(k - 1)", "(n - k)") + """, 6)::double p from t""")
def anova_f(spark, sf):
    a = Q.anova(fx.table(spark, sf, "events"), "event_type", "value")
    return a.select("n", "k", F.round("ss_between", 3).alias("ss_between"),
                    F.round("ss_within", 3).alias("ss_within"), F.round("f", 6).alias("f"),
                    F.round("eta_sq", 9).alias("eta_sq"), F.round("p", 6).alias("p"))


@query("permanova_f", """
with l as (select label, unnest(embedding)::double x, unnest(range(64)) i from embeddings),
g as (select label, i, count(*) n, sum(x) s, sum(x*x) q from l group by all),
d as (select i, sum(n) n, count(*) k, sum(q - s*s/n) w, sum(q) - sum(s)*sum(s)/sum(n) t from g group by i),
z as (select max(n)::bigint n, max(k)::bigint k, sum(w) w, sum(t) t from d)
select n, k, round(((t-w)/(k-1))/(w/(n-k)), 6) pseudo_f, round((t-w)/t, 6) r2 from z""")
def permanova_f(spark, sf):
    p = Q.permanova(fx.table(spark, sf, "embeddings"), "label", "embedding")
    return p.select("n", "k", F.round("pseudo_f", 6).alias("pseudo_f"), F.round("r2", 6).alias("r2"))


def target_values(spark, sf):
    """(label, cls, x): one value per target, classes of 2 / 2 / rest in label order."""
    m = Q.mean_vectors(vectors(spark, sf), "label", COLS).where(F.col("label") != REFERENCE)
    k = F.col("label")
    return materialize(m.select(
        "label", F.when(k <= 2, 0).when(k <= 4, 1).otherwise(2).alias("cls"),
        F.round("f1", 9).alias("x")))


DRAWS_LABEL = 10_000  # fixed value: draws of the label permutation
CLS_SQL = EMB_SQL + """,
tv as (select label, case when label <= 2 then 0 when label <= 4 then 1 else 2 end cls, round(f1, 9) x
       from mv where label <> 0)"""
LABEL_SQL = CLS_SQL + """,
c1 as (select a.label a, b.label b from tv a join tv b on a.label < b.label),
lab as (select c1.a a1, c1.b b1, c2.a a2, c2.b b2 from c1 join c1 c2
        on c2.a not in (c1.a, c1.b) and c2.b not in (c1.a, c1.b)),
lg as (select a1, b1, a2, b2, case when t.label in (a1, b1) then 0 when t.label in (a2, b2) then 1
         else 2 end c, count(*) n, sum(x) s, sum(x*x) q from lab, tv t group by all),
lf as (select a1, b1, a2, b2, ((sum(s*s/n) - sum(s)*sum(s)/sum(n)) / 2)
         / (sum(q - s*s/n) / (sum(n) - 3)) f from lg group by all),
ob as (select f from lf where a1 = 1 and b1 = 2 and a2 = 3 and b2 = 4)"""


@query("exact_labelings", LABEL_SQL + """
select round(min(ob.f), 6) stat_obs, count(*) filter (round(lf.f, 9) >= round(ob.f, 9))::double / count(*)
  p_exact, count(*)::bigint n_perm, count(*) filter (round(lf.f, 9) >= round(ob.f, 9))::bigint n_extreme
from lf, ob""")
def exact_labelings(spark, sf):
    rows = sorted(target_values(spark, sf).collect(), key=lambda r: r["label"])  # ten labels
    t = Q.exact_label_test(spark, [r["x"] for r in rows], [r["cls"] for r in rows])
    return t.withColumn("stat_obs", F.round("stat_obs", 6))


@query("random_label_permutation", CLS_SQL + f""",
sp as (select cls c, row_number() over (order by label) i from tv),
dl as (select draw, x, row_number() over (partition by draw order by
         sha256('perm|' || draw || '|' || label), label) i from tv, range({DRAWS_LABEL}) t(draw)),
g as (select draw, c, count(*) n, sum(x) s, sum(x*x) q from dl join sp using (i) group by all),
nf as (select draw, ((sum(s*s/n) - sum(s)*sum(s)/sum(n)) / 2) / (sum(q - s*s/n) / (sum(n) - 3)) f
       from g group by draw),
og as (select cls, count(*) n, sum(x) s, sum(x*x) q from tv group by 1),
ob as (select ((sum(s*s/n) - sum(s)*sum(s)/sum(n)) / 2) / (sum(q - s*s/n) / (sum(n) - 3)) f from og)
select round(min(ob.f), 6) observed, round(avg(nf.f), 6) null_mean, round(stddev_pop(nf.f), 6) null_sd,
  (count(*) filter (round(nf.f, 9) >= round(ob.f, 9)) + 1)::double / {DRAWS_LABEL + 1} p from nf, ob""")
def random_label_permutation(spark, sf):
    r = Q.random_label_test(target_values(spark, sf), "label", "cls", "x", DRAWS_LABEL, "perm")
    return r.select("p", *[F.round(c, 6).alias(c) for c in ("observed", "null_mean", "null_sd")])


@query("two_group_contrast", """
with v as (select event_type = 'click' a, value from events where event_type in ('click', 'view')),
r as (select a, value, (rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0) rk
      from v),
s as (select count(*) filter (a)::bigint n1, count(*) filter (not a)::bigint n2, avg(value) filter (a) m1,
  avg(value) filter (not a) m2, var_samp(value) filter (a) v1, var_samp(value) filter (not a) v2,
  sum(rk) filter (a) r1 from r),
tie as (select sum(c^3 - c)::double t from (select count(*)::double c from v group by value)),
q as (select s.*, (m1-m2)/sqrt(v1/n1+v2/n2) wt, (v1/n1+v2/n2)^2/((v1/n1)^2/(n1-1)+(v2/n2)^2/(n2-1)) wd,
  greatest(abs(r1 - n1*(n1+1)/2.0 - n1*n2/2.0) - 0.5, 0) / sqrt(n1*n2/12.0 * (n1+n2+1 - t / ((n1+n2)*(n1+n2-1.0)))) z from s, tie)
select round(""" + tail_sql("(wt * wt)", "1", "wd") + """, 6)::double welch_p, round(""" + NORMAL_SQL.format(z="z") + """, 6)::double u_p, n1, n2, round(m1, 6) mean1, round(m2, 6) mean2, round((m1-m2)/sqrt(v1/n1+v2/n2), 6) welch_t,
  round((v1/n1+v2/n2)^2/((v1/n1)^2/(n1-1)+(v2/n2)^2/(n2-1)), 3) welch_df,
  round((m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)), 6) cohens_d,
  (r1 - n1*(n1+1)/2.0)::double u, round(1 - 2.0*(r1 - n1*(n1+1)/2.0)/(n1*n2), 6)::double rank_biserial
from q""")
def two_group_contrast(spark, sf):
    r = Q.two_group_stats(fx.table(spark, sf, "events"), "event_type", "click", "view", "value")
    return r.select("n1", "n2", "u", F.round("welch_df", 3).alias("welch_df"), *[
        F.round(c, 6).alias(c) for c in ("mean1", "mean2", "welch_t", "cohens_d", "rank_biserial", "welch_p", "u_p")])


@query("class_mean_ci")
def class_mean_ci(spark, sf):
    return Q.class_mean_ci(fx.table(spark, sf, "events"), "event_type", "value")


@query("bonferroni", """
with p as (select p_type, ((sum(p_size)::bigint * 7919) % 1000 + 1) / 5005.0::double p from part group by 1)
select p_type, p, least(1.0, p * 8)::double p_adj from p""")
def bonferroni(spark, sf):
    from pathloom.operators.inference import bonferroni as adjust

    p = fx.table(spark, sf, "part").groupBy("p_type").agg(
        ((F.sum("p_size") * 7919 % 1000 + 1) / F.lit(5005.0)).alias("p"))
    return p.withColumn("p_adj", adjust(F.col("p"), 8))


NEARL_SQL = EMB_SQL + """,
nr as (select vec_id, any_value(e.label) label, arg_min(m.label, {'d': (e.f1-m.f1)^2+(e.f2-m.f2)^2
   +(e.f3-m.f3)^2+(e.f4-m.f4)^2, 'o': m.label}) cluster from emb e, mv m group by vec_id)"""


@query("ari", NEARL_SQL + """,
c as (select label, cluster, count(*) n from nr group by all),
p as (select sum(n*(n-1)/2.0) p, sum(n) n from c),
a as (select sum(m*(m-1)/2.0) p from (select sum(n) m from c group by label)),
b as (select sum(m*(m-1)/2.0) p from (select sum(n) m from c group by cluster))
select p.n::bigint n, round((p.p - a.p*b.p/(p.n*(p.n-1)/2.0)) / ((a.p+b.p)/2 - a.p*b.p/(p.n*(p.n-1)/2.0)), 6)
  ::double ari from p, a, b""")
def ari(spark, sf):
    v = materialize(vectors(spark, sf))
    means = Q.mean_vectors(v, "label", COLS).collect()  # one row per label
    table = F.array(*[F.struct(*[F.lit(m[c]).alias(c) for c in COLS], F.lit(m["label"]).alias("k"))
                      for m in means])
    best = F.array_min(F.transform(table, lambda m: F.struct(
        sum(((F.col(c) - m[c]) * (F.col(c) - m[c]) for c in COLS), F.lit(0.0)).alias("d"),
        m["k"].alias("k"))))
    a = materialize(v.select("label", best["k"].alias("cluster")))
    return Q.adjusted_rand(a, "label", "cluster").withColumn("ari", F.round("ari", 6))


@query("silhouette", PAIR_SQL + """,
m as (select a, a % 3 ca, b % 3 cb, avg(dist) d from pr group by all),
s as (select a, min(d) filter (ca = cb) own, min(d) filter (ca <> cb) other from m group by a)
select a, round(case when greatest(own, other) > 0 then (other - own) / greatest(own, other) else 0 end, 6)
  silhouette from s""")
def silhouette(spark, sf):
    m = materialize(mean_arrays(spark, sf))
    d = Q.distance_matrix(Q.pairwise(m, "label", "vec"))
    lab = m.select("label", (F.col("label") % 3).alias("cluster"))
    return Q.silhouette(d, lab, "label", "cluster").withColumn("silhouette", F.round("silhouette", 6))


@query("spearman", """
with o as (select round(sum(l_quantity))::double q, count(*)::double n from lineitem group by l_orderkey),
r as (select q, n, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2.0 rq,
        rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 rn from o)
select count(*)::bigint n, round(corr(q, n), 6) pearson, round(corr(rq, rn), 6) spearman from r""")
def spearman(spark, sf):
    o = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_quantity")).alias("q"), F.count(F.lit(1)).cast("double").alias("n0"))
    s = Q.spearman(materialize(o.select("q", "n0")), "q", "n0")
    return s.select("n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query("kendall", EMB_SQL + """,
p as (select sign(a.f1 - b.f1) x, sign(a.f2 - b.f2) y from mv a join mv b on a.label < b.label)
select round(sum(x * y) / sqrt(sum(abs(x))::double * sum(abs(y))), 6)::double tau from p""")
def kendall(spark, sf):
    m = materialize(Q.mean_vectors(vectors(spark, sf), "label", COLS))
    return Q.kendall(m, "label", "f1", "f2").withColumn("tau", F.round("tau", 6))


@query("kendall_rows", """
with p as (select sign(a.p_size - b.p_size) x, sign(a.p_retailprice - b.p_retailprice) y
           from part a join part b on a.p_partkey < b.p_partkey)
select round(sum(x * y) / sqrt(sum(abs(x))::double * sum(abs(y))), 9)::double tau from p""")
def kendall_rows(spark, sf):
    return Q.kendall(fx.table(spark, sf, "part"), "p_partkey", "p_size", "p_retailprice").withColumn("tau", F.round("tau", 9))


@query("similarity_links", DISP_SQL + """,
s as (select label, (m1*r1+m2*r2+m3*r3+m4*r4) / (sqrt(m1*m1+m2*m2+m3*m3+m4*m4)
        * sqrt(r1*r1+r2*r2+r3*r3+r4*r4)) sr, (f1*r1+f2*r2+f3*r3+f4*r4) / (sqrt(f1*f1+f2*f2+f3*f3+f4*f4)
        * sqrt(r1*r1+r2*r2+r3*r3+r4*r4)) cosine from d)
select label, round(sr, 6) sr, round(cosine, 6) cosine, rank() over (order by round(sr, 6) desc)::bigint
  = rank() over (order by round(cosine, 6) desc)::bigint same_rank from s""")
def similarity_links(spark, sf):
    from pyspark.sql import Window

    v = materialize(vectors(spark, sf))
    m = materialize(mean_arrays(spark, sf))
    ref = m.where(F.col("label") == REFERENCE).first()["vec"]
    d = Q.displacement(v, "label", COLS, ref, min_rows=1).select("label", F.round("sr", 6).alias("sr"))
    c = Q.cosine_matrix(Q.pairwise(m, "label", "vec")).where(F.col("b") == REFERENCE).select(
        F.col("a").alias("label"), F.round("cosine", 6).alias("cosine"))
    by = lambda k: F.rank().over(Window.orderBy(F.desc(k)))  # a handful of targets
    return d.join(c, "label").withColumn("same_rank", by("sr") == by("cosine"))


@query("kmeans")
def kmeans(spark, sf):
    return Q.kmeans_targets(mean_arrays(spark, sf), "label", "vec", restarts=500)


@query("ward")
def ward(spark, sf):
    return Q.ward(materialize(mean_arrays(spark, sf)), "label", "vec")


@query("ward_sum_of_squares", EMB_SQL + """,
c as (select avg(f1) c1, avg(f2) c2, avg(f3) c3, avg(f4) c4 from mv)
select count(*)::bigint - 1 n_merges, round(sum((f1-c1)^2 + (f2-c2)^2 + (f3-c3)^2 + (f4-c4)^2), 9) total from mv, c""")
def ward_sum_of_squares(spark, sf):
    """Half of the squared heights of all merges, which is the total sum of squares."""
    return ward(spark, sf).agg(F.count(F.lit(1)).alias("n_merges"),
                               F.round(F.sum(F.col("height") * F.col("height")) / 2, 9).alias("total"))


@query("pca")
def pca(spark, sf):
    _, ratio = Q.pca(vectors(spark, sf), COLS)
    return spark.createDataFrame([(i, float(r)) for i, r in enumerate(ratio)],
                                 "component int, explained double")


@query("manova")
def manova(spark, sf):
    r = Q.manova(vectors(spark, sf), "label", COLS)
    return spark.createDataFrame([tuple(r.values())], ", ".join(
        f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in r.items()))


# ---- attribution -------------------------------------------------------------------------

COEF = {"FULLCOEF": (0.5, -0.4, 0.3, 0.2), "MEDIANCOEF": (0.1, 0.2, -0.3, 0.25)}

PREFIX_SQL = WITH_PATH + """,
pre as (select sample_id, path_key, L path_len, nodes[1] u, unnest(nodes[2:]) v,
               unnest(range(1, L + 1))::int length from path),
sub as (select pre.*, e.y, e.nav, e.rout, e.search, e.comm from pre join edge e using (u, v))"""
CON_SQL = PREFIX_SQL + """,
sc as (select length, """ + ", ".join(
    f"avg({f}) m_{f}, stddev_pop({f}) s_{f}" for f in At.FEATURES) + """ from sub group by length),
cf as (""" + " union all ".join(
    f"select '{s}' coef_source, " + ", ".join(f"{v}::double c_{f}" for f, v in zip(At.FEATURES, c))
    for s, c in COEF.items()) + """),
con as (select sample_id, path_key, path_len, u, v, sub.length, coef_source, """ + ", ".join(
    f"coalesce(round(abs(c_{f} * ({f} - m_{f}) / nullif(s_{f}, 0)), 9), 0.0) k_{f}" for f in At.FEATURES) + """
  from sub join sc using (length), cf),
dom as (select *, case when greatest(k_nav, k_rout, k_search, k_comm) = 0 then 'all_zero'
  when k_nav >= greatest(k_rout, k_search, k_comm) then 'nav'
  when k_rout >= greatest(k_search, k_comm) then 'rout'
  when k_search >= k_comm then 'search' else 'comm' end feat from con),
typ as (select *, case when feat = 'all_zero' then 'all_zero' when feat in ('nav', 'rout') then 'routing'
  else 'diffusion' end mode from dom)"""


def subpaths(spark, sf):
    e, d = fx.dag(spark, sf)
    from pathloom.operators.graph import enumerate_paths

    p = enumerate_paths(d.select("seed", "u", "v", "lat_u", "lat_v"), fx.MAX_LEN)
    return At.prefix_subpaths(p, e)


def contributions(spark, sf):
    s = materialize(subpaths(spark, sf))
    lens = spark.range(1, fx.MAX_LEN + 1).select(F.col("id").cast("int").alias("length"))
    coefs = lens.withColumn("e", F.explode(F.array(*[
        F.struct(F.lit(n).alias("coef_source"), *[F.lit(v).alias(f"c_{f}")
                                                  for f, v in zip(At.FEATURES, c)])
        for n, c in COEF.items()]))).select("length", "e.*")
    return At.contributions(s, At.length_scaling(s), coefs)


@query("prefix_subpaths", PREFIX_SQL + """
select path_key, length, u, v, y, round(nav, 6) nav, round(comm, 6) comm from sub""")
def prefix_subpaths(spark, sf):
    return subpaths(spark, sf).select("path_key", "length", "u", "v", "y", F.round("nav", 6).alias("nav"),
                                      F.round("comm", 6).alias("comm"))


@query("dominant_mode", CON_SQL + """
select path_key, length, coef_source, feat dominant_feature, mode dominant_type,
       round(k_nav, 6) contrib_nav from typ""")
def dominant_mode(spark, sf):
    return contributions(spark, sf).select(
        "path_key", "length", "coef_source", "dominant_feature", "dominant_type",
        F.round("contrib_nav", 6).alias("contrib_nav"))


@query("mode_by_length", CON_SQL + """
select length, coef_source, count(*)::bigint n_samples, count(distinct (u, v))::bigint n_unique_pairs,
  count(*) filter (mode = 'all_zero')::bigint n_all_zero,
  count(*) filter (mode = 'routing')::double / nullif(count(*) filter (mode <> 'all_zero'), 0) routing_ratio,
  count(*) filter (mode = 'diffusion')::double / nullif(count(*) filter (mode <> 'all_zero'), 0) diffusion_ratio,
  """ + ", ".join(f"count(*) filter (feat = '{f}')::double / nullif(count(*) filter (mode <> 'all_zero'), 0) {f}_ratio"
                  for f in At.FEATURES) + """,
  round(sum(k_nav + k_rout) filter (mode <> 'all_zero')
    / nullif(sum(k_nav + k_rout + k_search + k_comm) filter (mode <> 'all_zero'), 0), 6) routing_share
from typ group by length, coef_source""")
def mode_by_length(spark, sf):
    return At.mode_by_length(contributions(spark, sf)).withColumn(
        "routing_share", F.round("routing_share", 6))


CLASS_SQL = CON_SQL + """,
cls as (select coef_source, sample_id, path_key, path_len, count(*) filter (mode = 'diffusion') > 0 part,
          max(length) = path_len complete from typ where mode <> 'all_zero'
          group by coef_source, sample_id, path_key, path_len),
trn as (select coef_source, path_len full_length, count(*)::bigint n_paths,
  count(distinct sample_id)::bigint n_cells, bool_and(complete) coverage_complete,
  count(*) filter (part)::bigint n_partial, avg(part::int)::double partial_ratio,
  1 - avg(part::int)::double persistent_ratio from cls group by all)"""


@query("path_transition", CLASS_SQL + """
select * replace (round(partial_ratio, 9) as partial_ratio, round(persistent_ratio, 9) as persistent_ratio)
from trn""")
def path_transition(spark, sf):
    t = At.transition_by_length(At.path_classes(contributions(spark, sf)))
    return t.withColumn("partial_ratio", F.round("partial_ratio", 9)).withColumn(
        "persistent_ratio", F.round("persistent_ratio", 9))


@query("accumulation", CLASS_SQL + """,
m0 as (select length, coef_source, count(*) filter (mode = 'diffusion')::double
         / nullif(count(*) filter (mode <> 'all_zero'), 0) dr from typ group by length, coef_source),
ml as (select *, row_number() over (partition by coef_source order by length) i from m0),
ac as (select t.coef_source, t.full_length, count(ml.dr) n, product(1 - ml.dr) p, any_value(partial_ratio) ob
       from trn t left join ml on ml.coef_source = t.coef_source and ml.i between 2 and full_length + 1
       group by all)
select coef_source, full_length, round(case when n >= full_length then 1 - p end, 6) predicted,
  round(ob, 6) observed, round(case when n >= full_length then abs(ob - (1 - p)) end, 6) deviation from ac""")
def accumulation(spark, sf):
    c = materialize(contributions(spark, sf))
    a = At.accumulation(At.mode_by_length(c), At.transition_by_length(At.path_classes(c)))
    return a.select("coef_source", "full_length", *[
        F.round(k, 6).alias(k) for k in ("predicted", "observed", "deviation")])


@query("participation", CLASS_SQL + """,
vis as (select case when c.path_len <= 3 then 'short' when c.path_len <= 6 then 'medium' else 'long' end grp,
  c.coef_source, case when part then 'partial' else 'persistent' end cls, nodes[1] seed,
  unnest(nodes[2:]) through from cls c join path using (path_key)),
n as (select grp, coef_source, cls, seed, through, count(*)::bigint visits from vis group by all)
select *, visits::double / sum(visits) over (partition by grp, coef_source, cls, seed) share from n""")
def participation(spark, sf):
    c = At.path_classes(contributions(spark, sf))
    p = c.select(At.length_group(F.col("path_len")).alias("grp"), "coef_source",
                 F.when(F.col("partial"), "partial").otherwise("persistent").alias("cls"),
                 F.transform(F.split("path_key", r"\|"), lambda s: s.cast("int")).alias("nodes"))
    return At.participation(p, ["grp", "coef_source", "cls"])


@query("network_axis", """
with c as (select c_nationkey, count(*)::bigint n_customers from customer group by 1)
select n_nationkey node, n_regionkey network, n_customers, row_number() over (order by
  coalesce(nullif(list_position([3, 1, 0], n_regionkey), 0), 4), n_name)::bigint axis
from nation join c on c_nationkey = n_nationkey""")
def network_axis(spark, sf):
    c = fx.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(
        F.count(F.lit(1)).alias("n_customers"))
    n = fx.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("network"), "n_name")
    return At.ordered_axis(n.join(c, "node"), [3, 1, 0], "network", "n_name").select(
        "node", "network", "n_customers", "axis")


@query("cohort_comparison", CON_SQL + """,
r as (select length, coef_source, u < 13 h, count(*) filter (mode = 'routing')::double
  / count(*) filter (mode <> 'all_zero') routing_ratio from typ group by all),
a as (select * from r where h), b as (select * from r where not h)
select coalesce(a.length, b.length) length, coalesce(a.coef_source, b.coef_source) coef_source,
  a.routing_ratio routing_ratio_a, b.routing_ratio routing_ratio_b,
  a.routing_ratio - b.routing_ratio difference
from a full join b on a.length = b.length and a.coef_source = b.coef_source""")
def cohort_comparison(spark, sf):
    c = materialize(contributions(spark, sf))
    left = F.col("u") < 13
    return At.compare_cohorts(At.mode_by_length(c.where(left)), At.mode_by_length(c.where(~left)),
                              ["length", "coef_source"], "routing_ratio")
