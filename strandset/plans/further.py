"""Queries of distances to intervals, assignment, exact sums, controls, factor sets, dimension, allele joins, linkage and clumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import association as st
from ..operators import clustering as cl
from ..operators import intervals as iv
from ..operators import joins as jn
from ..operators import linkage as lk
from ..operators import ranking as rk
from ..operators import resampling as rs
from ..operators import scan as sc
from ..operators import sets as se
from .registry import EVENTS_SQL, events, query, r6, table

HOUR = 3_600_000_000


@query(f"""WITH e AS {EVENTS_SQL}, p AS (SELECT event_id, event_type, us - 1 AS p0 FROM e WHERE event_id % 3 = 0), i AS (SELECT event_type, us, us_end FROM e WHERE event_id % 3 <> 0 AND us_end > us),
c AS (SELECT event_id, p0, max(us_end) FILTER (us <= p0) AS reach, min(us) FILTER (us > p0) AS nxt FROM p LEFT JOIN i USING (event_type) GROUP BY ALL)
SELECT event_id, CASE WHEN reach > p0 THEN 0e0 ELSE least(p0 - reach + 1, nxt - p0)::DOUBLE END AS distance FROM c""")
def distance_to_interval(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    points = e.where("event_id % 3 = 0").select("event_id", "event_type", F.col("us").alias("at"))
    out = iv.distance_to_interval(points, e.where("event_id % 3 <> 0").select("event_type", "us", "us_end"), ["event_type"], "at", "us", "us_end", HOUR)
    return out.select("event_id", "distance")


@query(f"""WITH e AS {EVENTS_SQL}, p AS (SELECT event_id, event_type, us FROM e WHERE event_id % 2 = 0), f AS (SELECT event_type, us AS fpos, user_id FROM e WHERE event_id % 2 = 1)
SELECT event_id, user_id AS assigned, abs(us - fpos)::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(us - fpos), (fpos >= us), CASE WHEN fpos < us THEN -user_id ELSE user_id END) AS k FROM p JOIN f USING (event_type)) WHERE k = 1""")
def assign_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    points = e.where("event_id % 2 = 0").select("event_id", "event_type", "us")
    features = e.where("event_id % 2 = 1").select("event_type", F.col("us").alias("at"), "user_id")
    return iv.assign_nearest(points, features, ["event_type"], "us", "at", "user_id", HOUR).select("event_id", "assigned", "distance")


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) AS min_rank FROM orders")
def min_rank(spark: SparkSession, d: str) -> DataFrame:
    return rk.global_min_rank(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "min_rank")


@query(f"""WITH e AS {EVENTS_SQL}, g AS (SELECT user_id, min(us) AS tss, min(us) AS lo, max(us_end) AS hi FROM e GROUP BY 1), c AS (SELECT user_id, count(*) AS m, count(*) FILTER (us BETWEEN tss - 3 * {HOUR} AND tss + 3 * {HOUR}) AS m_prom FROM e JOIN g USING (user_id) GROUP BY 1)
SELECT user_id, m, (greatest(tss + 3 * {HOUR}, hi) - least(tss - 3 * {HOUR}, lo) + 1)::BIGINT AS length, m_prom, m - m_prom AS m_body, round(m_prom / m, 6) AS share FROM c JOIN g USING (user_id)""")
def window_summary(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    genes = e.groupBy("user_id").agg(F.min("us").alias("tss"), F.min("us").alias("lo"), F.max("us_end").alias("hi"))
    out = iv.window_summary(e.select("user_id", "us"), genes, "user_id", "us", "tss", ("lo", "hi"), 3 * HOUR)
    return out.withColumn("share", r6(F.col("share")))


@query("SELECT l_returnflag, l_linestatus, round(fsum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem GROUP BY ALL")
def exact_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    return ag.exact_sum(rows, ["l_returnflag", "l_linestatus"], "x").withColumn("total", F.round("total", 4))


@query("""WITH t AS (SELECT c_custkey, c_acctbal AS v FROM customer), p AS (SELECT s_suppkey, s_acctbal AS s FROM supplier)
SELECT c_custkey, s_suppkey AS control, round(abs(v - s), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(v - s), s, sha256('m:' || s_suppkey::VARCHAR)) AS k FROM t, p) WHERE k = 1""")
def nearest_controls(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    pool = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"))
    return rs.nearest_controls(wanted, pool, [], "v", "s_suppkey", 500.0, "m").select("c_custkey", "control", r6(F.col("distance")).alias("distance"))


@query(f"""WITH e AS {EVENTS_SQL}, p AS (SELECT DISTINCT event_type, us FROM e WHERE event_id % 3 = 0), i AS (SELECT event_type, us AS a, us_end AS b, user_id % 40 AS f FROM e WHERE event_id % 3 <> 0),
s AS (SELECT p.event_type, p.us, count(DISTINCT f) AS n_factors, bit_or(CASE WHEN f < 20 THEN 1::BIGINT << f::INTEGER ELSE 0 END) AS top_bits FROM p JOIN i ON p.event_type = i.event_type AND a <= us AND us < b GROUP BY 1, 2)
SELECT event_id, coalesce(n_factors, 0) AS n_factors, coalesce(top_bits, 0) AS top_bits FROM e LEFT JOIN s USING (event_type, us) WHERE event_id % 3 = 0""")
def factor_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct factors of the spans around each point, and a set of the listed ones."""
    e = events(spark, d)
    spans = e.where("event_id % 3 <> 0").select("event_type", F.col("us").alias("a"), F.col("us_end").alias("b"), (F.col("user_id") % 40).alias("f"))
    points = e.where("event_id % 3 = 0").select("event_id", "event_type", "us")
    return iv.factor_sets(points, spans, ["event_type"], "us", "a", "b", "f", list(range(20)), HOUR).select("event_id", "n_factors", "top_bits")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS q, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY d) AS k FROM p), t AS (SELECT q, max(d) AS far FROM r WHERE k <= 8 GROUP BY 1 HAVING count(*) = 8 AND min(d) > 0), m AS (SELECT q, sum(ln(far / d)) / 7 AS inv FROM r JOIN t USING (q) WHERE k <= 8 GROUP BY 1)
SELECT CASE WHEN count(*) >= 20 THEN round(1 / avg(inv), 6) END AS dimension, count(*) AS n FROM m""")
def likelihood_dimension(spark: SparkSession, d: str) -> DataFrame:
    near = se.nearest_neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return cl.likelihood_dimension(near, 8).select(r6(F.col("dimension")).alias("dimension"), "n")


@query("""WITH v AS (SELECT event_type, value::DOUBLE AS x FROM events), c AS (SELECT event_type, x - avg(x) OVER (PARTITION BY event_type) AS x FROM v WHERE isfinite(x)),
m AS (SELECT event_type, count(*) AS n, sum(x * x) / count(*) AS m2, sum(x * x * x) / count(*) AS m3, sum(x * x * x * x) / count(*) AS m4 FROM c GROUP BY 1)
SELECT event_type, n, CASE WHEN n >= 30 AND m2 > 0 THEN round((m3 * m3 / pow(m2, 3) + 1) / (m4 / (m2 * m2) - 3 + 3e0 * (n - 1) * (n - 1) / ((n - 2e0) * (n - 3))), 6) END AS coefficient FROM m""")
def bimodality(spark: SparkSession, d: str) -> DataFrame:
    return cl.bimodality(table(spark, d, "events"), ["event_type"], "value").withColumn("coefficient", r6(F.col("coefficient")))


_ALLELES = "CASE {} % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END"


def _alleles(spark: SparkSession, d: str, name: str, key: str, shift: int) -> DataFrame:
    """A table's keys as places with an allele pair."""
    base = F.array(*[F.lit(x) for x in "ACGT"])
    i = F.col(key)
    return table(spark, d, name).select(F.col(key).alias(f"{name}_key"), (i % 97).alias("place"), F.get(base, (i % 4).cast("int")).alias("ref"), F.get(base, ((i + shift) % 4).cast("int")).alias("alt"))


def _alleles_sql(name: str, key: str, shift: int) -> str:
    return f"(SELECT {key} AS {name}_key, {key} % 97 AS place, {_ALLELES.format(key)} AS ref, {_ALLELES.format(f'({key} + {shift})')} AS alt FROM {name})"


@query(f"SELECT part_key, supplier_key FROM {_alleles_sql('part', 'p_partkey', 1)} a JOIN {_alleles_sql('supplier', 's_suppkey', 3)} b ON a.place = b.place AND least(a.ref, a.alt) = least(b.ref, b.alt) AND greatest(a.ref, a.alt) = greatest(b.ref, b.alt)")
def unordered_alleles(spark: SparkSession, d: str) -> DataFrame:
    return jn.unordered(_alleles(spark, d, "part", "p_partkey", 1), _alleles(spark, d, "supplier", "s_suppkey", 3), ["place"], ("ref", "alt")).select("part_key", "supplier_key")


@query(f"""SELECT CASE WHEN a.ref = b.ref AND a.alt = b.alt THEN 'same' WHEN a.ref = b.alt AND a.alt = b.ref THEN 'swapped' ELSE 'mismatch' END AS allele_status, count(*) AS n
FROM {_alleles_sql('part', 'p_partkey', 1)} a JOIN {_alleles_sql('supplier', 's_suppkey', 3)} b USING (place) GROUP BY 1""")
def position_alleles(spark: SparkSession, d: str) -> DataFrame:
    return jn.position_counts(_alleles(spark, d, "part", "p_partkey", 1), _alleles(spark, d, "supplier", "s_suppkey", 3), ["place"], ("ref", "alt"))


_BLOCK, _BORDER, _R2 = 20, 5, 0.02


@query(f"""WITH v AS (SELECT label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
c AS (SELECT label, idx, n, idx // {_BLOCK} AS block, list_transform(e, lambda x: x - list_avg(e)) AS e FROM v),
t AS (SELECT * FROM c WHERE idx >= least(n, (block + 1) * {_BLOCK}) - {_BORDER} AND (block + 1) * {_BLOCK} < n), h AS (SELECT * FROM c WHERE block > 0 AND idx < block * {_BLOCK} + {_BORDER}),
p AS (SELECT t.label, t.block AS border, t.idx AS a, h.idx AS b, pow(list_cosine_similarity(t.e, h.e), 2) > {_R2} AS high FROM t JOIN h ON t.label IS NOT DISTINCT FROM h.label AND t.block + 1 = h.block)
SELECT label, border, count(*) AS tested_pairs, count(*) FILTER (high) AS high_pairs, count(DISTINCT a) FILTER (high) AS left_involved, count(DISTINCT b) FILTER (high) AS right_involved FROM p GROUP BY 1, 2""")
def block_borders(spark: SparkSession, d: str) -> DataFrame:
    """What the borders of blocked linkage cut."""
    e = table(spark, d, "embeddings").withColumn("at", F.col("vec_id"))
    return lk.blocked_linkage(e, ["label"], "vec_id", "at", "embedding", _R2, _BLOCK, _BORDER)[1]


@query(None)
def block_teams(spark: SparkSession, d: str) -> DataFrame:
    """Complete linkage in blocks."""
    e = table(spark, d, "embeddings").withColumn("at", F.col("vec_id"))
    return lk.blocked_linkage(e, ["label"], "vec_id", "at", "embedding", _R2, _BLOCK, _BORDER)[0].select("label", "vec_id", "idx", "block", "team")


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), r AS (SELECT vec_id, run, CASE WHEN (vec_id + run) % 7 = 0 THEN -1 ELSE (e[run + 1] > 0)::INTEGER + 2 * (e[run + 2] > 0)::INTEGER END AS c FROM v, (SELECT unnest(range(0, 8)) AS run) WHERE (vec_id * 3 + run) % 5 <> 0),
n AS (SELECT vec_id, lead(vec_id) OVER (ORDER BY vec_id) AS next FROM v)
SELECT n.vec_id AS a, n.next AS b, count(*) AS n_both, count(*) FILTER (x.c = y.c AND x.c >= 0) AS n_same FROM n JOIN r x ON x.vec_id = n.vec_id JOIN r y ON y.vec_id = n.next AND y.run = x.run GROUP BY 1, 2""")
def co_association(spark: SparkSession, d: str) -> DataFrame:
    """How often neighbours by number fall into one cluster over runs that draw parts of the rows."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    run = e.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(7)))).where((F.col("vec_id") * 3 + F.col("run")) % 5 != 0)
    sign = [(F.get("embedding", F.col("run") + k) > 0).cast("int") for k in (0, 1)]
    runs = run.select("run", F.col("vec_id").alias("id"), F.when((F.col("vec_id") + F.col("run")) % 7 == 0, -1).otherwise(sign[0] + 2 * sign[1]).alias("cluster"))
    places = sc.running(e.select("vec_id"), [], ["vec_id"], sc.quantile_bucket(e, "vec_id"), {"i": ("sum", F.lit(1))})
    pairs = places.select(F.col("vec_id").alias("a"), "i").join(places.select(F.col("vec_id").alias("b"), (F.col("i") - 1).alias("i")), "i").select("a", "b")
    return lk.co_association(runs, pairs).select("a", "b", "n_both", "n_same")


@query(None)
def ld_clumps(spark: SparkSession, d: str) -> DataFrame:
    """Clumps of dimensions by their correlation over all vectors, the strongest first."""
    cells = table(spark, d, "embeddings").select(F.col("vec_id").alias("person"), F.posexplode("embedding").alias("variant", "x")).select("person", "variant", F.col("x").cast("double").alias("ds"), F.lit("1").alias("chrom")).withColumn("pos", F.col("variant"))
    n = table(spark, d, "embeddings").count()
    links = st.ld_pairs(cells, "variant", "person", "ds", n, "pos", 16.0).where("r2 >= 0.001").withColumn("chrom", F.lit("1"))
    p = cells.groupBy("chrom", "variant").agg((1.0 / (1.0 + F.abs(F.avg("ds")))).alias("p"))
    return cl.greedy_ld_clump(p, links, ["chrom"], "variant", "p").select("variant", "lead", "is_lead")


@query(None)
def ward_clusters(spark: SparkSession, d: str) -> DataFrame:
    return lk.ward(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 8).select("label", "vec_id", "cluster")
