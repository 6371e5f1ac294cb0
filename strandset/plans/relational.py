"""Queries of the joins, aggregates, sets and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..operators import sets as st
from ..operators.scan import task_count
from .registry import EVENTS_SQL, events, query, r6, table


@query("""SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members, count(*) AS n
FROM (SELECT DISTINCT p_brand, p_partkey FROM part) GROUP BY p_brand HAVING count(*) >= 2""")
def group_membership(spark: SparkSession, d: str) -> DataFrame:
    return jn.distinct_sets(table(spark, d, "part"), ["p_brand"], "p_partkey", 2).select("p_brand", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.size("members").cast("long").alias("n"))


@query("""SELECT CASE WHEN p_size < 10 THEN 'B1' WHEN p_size < 25 THEN 'B2' WHEN p_size < 40 THEN 'B3' ELSE 'B4' END AS size_band,
CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END AS discount_band, l_returnflag,
count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def band_census(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumns({"size_band": fc.band(F.col("p_size"), [10, 25, 40], ["B1", "B2", "B3", "B4"]), "discount_band": fc.band(F.col("l_discount"), [0.03, 0.07], ["low", "mid", "high"])})
    return ag.census(rows, ["size_band", "discount_band", "l_returnflag"], "l_quantity").select("size_band", "discount_band", "l_returnflag", "n", r6(F.col("mean")).alias("mean_quantity"))


_LADDER = """WITH f AS (SELECT unnest([0.02, 0.04, 0.06, 0.08])::DOUBLE AS floor),
r AS (SELECT l_returnflag AS scope, l_discount AS r2, l_tax AS maf FROM lineitem UNION ALL SELECT 'all', l_discount, l_tax FROM lineitem),
s AS (SELECT scope, floor, count(*) FILTER (r2 >= floor) AS n_kept, coalesce(sum(maf) FILTER (r2 >= floor), 0) AS sm, coalesce(sum(r2 * maf) FILTER (r2 >= floor), 0) AS si FROM r, f GROUP BY ALL)
SELECT scope, floor, n_kept, round(sm, 6) AS sum_maf, round(si, 6) AS sum_info, CASE WHEN sm > 0 THEN round(1 - si / sm, 6) END AS fmi,
greatest(10, ceil(100 * round(1 - si / sm, 9) - 1e-12))::BIGINT AS m FROM s"""


@query(_LADDER)
def floor_ladder_fmi(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("r2"), F.col("l_tax").alias("maf"))
    scoped = rows.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("l_returnflag"))))
    out = ag.floor_ladder(scoped, [0.02, 0.04, 0.06, 0.08], "r2", "maf", ["scope"])
    m = F.greatest(F.lit(10), F.ceil(100.0 * F.round("fmi", 9) - 1e-12)).cast("long")
    return out.select("scope", "floor", "n_kept", r6(F.col("sum_maf")).alias("sum_maf"), r6(F.col("sum_info")).alias("sum_info"), r6(F.col("fmi")).alias("fmi"), m.alias("m"))


@query("""WITH s AS (SELECT s_nationkey AS nation, 1 AS pri, s_acctbal AS v, s_suppkey AS id FROM supplier UNION ALL SELECT c_nationkey, 2, c_acctbal, c_custkey FROM customer),
k AS (SELECT nation, pri, v, row_number() OVER (PARTITION BY nation ORDER BY pri, v) AS rn FROM s WHERE v IS NOT NULL)
SELECT nation, v AS balance, CASE pri WHEN 1 THEN 'supplier' ELSE 'customer' END AS source FROM k WHERE rn = 1""")
def first_wins_pool(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source")).unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("source")))
    return ag.first_available(both, ["nation"], "balance", "source", ["supplier", "customer"])


@query(f"""WITH u AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' AND value > 150 THEN 2 WHEN event_type = 'view' THEN 1 END) AS status FROM {EVENTS_SQL} GROUP BY 1)
SELECT count(*) FILTER (status = 2) AS n_case, count(*) FILTER (status = 1) AS n_control,
round(count(*) FILTER (status = 2) / count(status), 6) AS prevalence,
round(4e0 * count(*) FILTER (status = 2) * count(*) FILTER (status = 1) / count(status), 6) AS n_eff FROM u""")
def precedence_status(spark: SparkSession, d: str) -> DataFrame:
    status = ag.precedence(events(spark, d), ["user_id"], (F.col("event_type") == "purchase") & (F.col("value") > 150), F.col("event_type") == "view")
    return ag.case_control_summary(status).select("n_case", "n_control", r6(F.col("prevalence")).alias("prevalence"), r6(F.col("n_eff")).alias("n_eff"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def semi_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity >= 49"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def anti_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity >= 49"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity >= 45),
n AS (SELECT s, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.s, b.s AS other, count(*) AS k FROM s a JOIN s b ON a.p = b.p AND a.s <> b.s GROUP BY ALL),
j AS (SELECT c.s, other, k / (x.n + y.n - k) AS jaccard, row_number() OVER (PARTITION BY c.s ORDER BY k / (x.n + y.n - k) DESC, other) AS rn FROM c JOIN n x ON c.s = x.s JOIN n y ON other = y.s)
SELECT s AS l_suppkey, other, round(jaccard, 6) AS jaccard FROM j WHERE rn = 1""")
def best_match_jaccard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity >= 45")
    return jn.best_match(rows, "l_suppkey", "l_partkey").select("l_suppkey", "other", r6(F.col("jaccard")).alias("jaccard"))


@query("""WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n_common FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def unordered_pair_join(spark: SparkSession, d: str) -> DataFrame:
    return jn.pairs_within(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("""WITH v AS (SELECT event_id, user_id % 7 AS place, ['A','C','G','T'][event_id % 4 + 1] AS r, ['A','C','G','T'][(event_id // 4) % 4 + 1] AS a FROM events WHERE event_id % 4 <> (event_id // 4) % 4),
p AS (SELECT DISTINCT n_nationkey % 7 AS place, ['A','C','A','G'][n_nationkey % 4 + 1] AS r, ['G','T','C','A'][n_nationkey % 4 + 1] AS a FROM nation),
t AS (SELECT event_id, place, 0 AS k, 1 AS sign, 'direct' AS label, r, a FROM v UNION ALL SELECT event_id, place, 1, -1, 'swap', a, r FROM v
UNION ALL SELECT event_id, place, 2, 1, 'rc', reverse(translate(r, 'ACGT', 'TGCA')), reverse(translate(a, 'ACGT', 'TGCA')) FROM v
UNION ALL SELECT event_id, place, 3, -1, 'swap_rc', reverse(translate(a, 'ACGT', 'TGCA')), reverse(translate(r, 'ACGT', 'TGCA')) FROM v)
SELECT event_id, arg_min(sign, k) AS sign, arg_min(label, k) AS label, arg_min(place || ':' || r || ':' || a, k) AS matched_key FROM t JOIN p USING (place, r, a) GROUP BY event_id""")
def multi_orientation_join(spark: SparkSession, d: str) -> DataFrame:
    bases, ref, alt = F.array(*map(F.lit, "ACGT")), F.array(*map(F.lit, "ACAG")), F.array(*map(F.lit, "GTCA"))
    i, j = F.col("event_id") % 4, F.floor(F.col("event_id") / 4) % 4
    variants = table(spark, d, "events").where(i != j).select("event_id", (F.col("user_id") % 7).alias("place"), F.get(bases, i.cast("int")).alias("r"), F.get(bases, j.cast("int")).alias("a"))
    k = F.col("n_nationkey") % 4
    panel = table(spark, d, "nation").select((F.col("n_nationkey") % 7).cast("long").alias("place"), F.get(ref, k).alias("r"), F.get(alt, k).alias("a")).distinct()
    return jn.multi_orientation(variants, panel, ["place"], "r", "a").select("event_id", "sign", "label", "matched_key")


@query("""SELECT r_name, n_name, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def bridge_join(spark: SparkSession, d: str) -> DataFrame:
    # counted by supplier before the hops: the bridge is crossed by few rows
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    hops = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return per.join(hops, "s_suppkey").groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


@query("""SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, 0::BIGINT AS n_duplicates FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def validated_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = jn.validated(table(spark, d, "orders"), c, ["o_custkey"])
    dup = jn.duplicate_keys(c, ["o_custkey"]).agg(F.count("*").alias("n_duplicates"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers")).crossJoin(F.broadcast(dup))


@query("""SELECT p_partkey, coalesce(n, 0) AS n_lines, coalesce(q, 0) AS quantity FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity >= 49 GROUP BY 1) ON p_partkey = l_partkey""")
def left_join_default(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").where("l_quantity >= 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    return jn.lookup(table(spark, d, "part").select("p_partkey"), per, ["p_partkey"], {"n_lines": 0, "quantity": 0.0})


@query("""WITH a AS (SELECT l_partkey AS k FROM lineitem WHERE l_quantity >= 40 GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3),
b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity >= 40)
SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS entered, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS "left", (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS kept""")
def arms_intersection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity >= 40")
    return jn.arm_changes(rows.where("l_returnflag = 'A'"), jn.in_all_arms(rows, "l_partkey", "l_returnflag", 3), ["l_partkey"])


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    return jn.in_all_arms(table(spark, d, "events"), "user_id", "event_type", 5)


@query("""WITH t AS (SELECT l_orderkey, 'big' AS tag FROM lineitem WHERE l_quantity >= 45 UNION SELECT l_orderkey, 'cheap' FROM lineitem WHERE l_discount >= 0.09 UNION SELECT l_orderkey, 'returned' FROM lineitem WHERE l_returnflag = 'R'),
k AS (SELECT l_orderkey, string_agg(tag, '+' ORDER BY tag) AS reasons FROM t GROUP BY 1) SELECT reasons, count(*) AS n FROM k GROUP BY 1""")
def link_reasons(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    tagged = {"big": li.where("l_quantity >= 45"), "cheap": li.where("l_discount >= 0.09"), "returned": li.where("l_returnflag = 'R'")}
    return jn.link_reasons(tagged, ["l_orderkey"]).groupBy("reasons").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a, b) AS nation, CASE WHEN a IS NULL THEN 'right' WHEN b IS NULL THEN 'left' ELSE 'both' END AS side FROM
(SELECT DISTINCT s_nationkey AS a FROM supplier) FULL JOIN (SELECT DISTINCT c_nationkey AS b FROM customer WHERE c_acctbal > 0) ON a = b""")
def reconcile_keys(spark: SparkSession, d: str) -> DataFrame:
    return jn.reconcile(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("nation")), ["nation"])


@query("""SELECT p_type, floor, count(*) FILTER (p_size >= floor) AS n FROM part, (SELECT unnest([5, 20, 35]) AS floor) GROUP BY ALL""")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return jn.with_grid(table(spark, d, "part"), floor=[5, 20, 35]).groupBy("p_type", "floor").agg(F.count_if(F.col("p_size") >= F.col("floor")).alias("n"))


@query("""SELECT event_type, user_id % 10 AS user_bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM events GROUP BY 1, 2""")
def modal_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("user_bin"))
    return ag.shares(rows, ["event_type"], "user_bin").select("event_type", "user_bin", "n", r6(F.col("share")).alias("share"))


@query("""SELECT least(n, 12)::BIGINT AS k, count(*) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def capped_histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    return ag.capped_counts(counts, "c", 12).select(F.col("k").cast("long").alias("k"), "n")


@query("""SELECT CASE WHEN value = 100 THEN 3 ELSE floor(value / 25)::INTEGER END AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1""")
def closed_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(ag.histogram(F.col("value"), [0.0, 25.0, 50.0, 75.0, 100.0]).alias("bin"))
    return rows.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))


@query("""SELECT user_id, round(max(value) FILTER (event_type = 'click'), 6) AS click, round(max(value) FILTER (event_type = 'error'), 6) AS error, round(max(value) FILTER (event_type = 'purchase'), 6) AS purchase, round(max(value), 6) AS max_all FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1""")
def tissue_max_pivot(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.intervals import max_by_tissue

    return max_by_tissue(table(spark, d, "events"), ["user_id"], "event_type", "value", ["click", "error", "purchase"])


@query("""WITH c AS (SELECT label, dec, count(*) AS n FROM (SELECT label, CAST(floor(vec_id % 7) AS BIGINT) AS dec FROM embeddings) GROUP BY ALL),
t AS (SELECT sum(n) AS nt FROM c), a AS (SELECT label, sum(n) AS na FROM c GROUP BY 1), b AS (SELECT dec, sum(n) AS nb FROM c GROUP BY 1),
h AS (SELECT (SELECT -sum(na / nt * log2(na / nt)) FROM a, t) AS ha, (SELECT -sum(nb / nt * log2(nb / nt)) FROM b, t) AS hb),
m AS (SELECT sum(n / nt * log2(n / nt / (na / nt * nb / nt))) AS mi FROM c JOIN a USING (label) JOIN b USING (dec), t)
SELECT round(mi, 6) AS mi_bits, round(ha, 6) AS h_a, round(hb, 6) AS h_b, round(mi / sqrt(ha * hb), 6) AS nmi FROM m, h""")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7).alias("dec"))
    return ag.mutual_information(rows, "label", "dec").select(*[r6(F.col(c)).alias(c) for c in ("mi_bits", "h_a", "h_b", "nmi")])


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_values, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) AS entropy_bits, round(pow(sum(c), 2) / sum(c * c), 6) AS effective, round(count(*) FILTER (c = 1) / count(*), 6) AS singleton_share FROM c GROUP BY 1""")
def entropy_effective(spark: SparkSession, d: str) -> DataFrame:
    out = ag.entropy_summary(table(spark, d, "events"), "user_id", ["event_type"])
    return out.select("event_type", "n", "n_values", *[r6(F.col(c)).alias(c) for c in ("entropy_bits", "effective", "singleton_share")])


@query("""WITH u AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT event_type, count(*) AS mass FROM u GROUP BY 1)
SELECT event_type, round(sum(n * (1e0 / (n * mass))), 6) AS total, round(max(1e0 / (n * mass)), 6) AS top FROM u JOIN m USING (event_type) GROUP BY 1""")
def class_balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    out = ag.block_balanced_weights(table(spark, d, "events"), ["user_id"], ["event_type"])
    return out.groupBy("event_type").agg(r6(F.sum("weight")).alias("total"), r6(F.max("weight")).alias("top"))


@query("""SELECT l_partkey, arg_min(p, s) AS first_value, count(DISTINCT s) AS n_sources, round(greatest(abs(max(p) - arg_min(p, s)), abs(arg_min(p, s) - min(p))), 6) AS max_abs_diff,
CASE WHEN greatest(abs(max(p) - arg_min(p, s)), abs(arg_min(p, s) - min(p))) > 1e-6 THEN 1 ELSE 0 END AS differs
FROM (SELECT l_partkey, l_suppkey AS s, min(l_tax) AS p FROM lineitem GROUP BY ALL) GROUP BY 1""")
def source_consistency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_tax")
    tasks = task_count(spark, rows.count())  # dealt before it is counted: a task's table of keys does not grow with the files
    per = rows.repartition(tasks, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.min("l_tax").alias("p")).repartition(tasks, "l_partkey")
    return ag.source_consistency(per, ["l_partkey"], "p", "l_suppkey").withColumn("max_abs_diff", r6(F.col("max_abs_diff")))


@query("""SELECT event_type, user_id % 20 AS bin, max(value) AS best, string_agg(DISTINCT (event_id % 3)::VARCHAR, ',' ORDER BY (event_id % 3)::VARCHAR) AS tags, count(*) - 1 AS n_duplicates FROM events GROUP BY ALL""")
def best_score_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 20).alias("bin"), "value", (F.col("event_id") % 3).cast("string").alias("tag"))
    return ag.best_score_tags(rows, ["event_type", "bin"], "value", "tag")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ln(l_extendedprice) / ln(10) AS y, ln(l_quantity) / ln(10) AS x FROM lineitem)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM x""")
def regression_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.log10("l_extendedprice").alias("y"), F.log10("l_quantity").alias("x"))
    return ag.line_fit(rows, "y", "x").select(*[r6(F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS y, o_custkey::DOUBLE AS x FROM orders), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x)
SELECT o_orderkey, round(y - (i + s * x), 4) AS residual FROM x, f ORDER BY abs(y - (i + s * x)) DESC, o_orderkey LIMIT 20""")
def regression_residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"))
    return ag.line_residuals(rows, "y", "x", 20, ["o_orderkey"]).select("o_orderkey", (F.round("residual", 4) + 0.0).alias("residual"))


@query("""SELECT r_name, n_name, (GROUPING_ID(r_name, n_name))::BIGINT AS level, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def scope_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ag.scope_union(rows, "r_name", "n_name")


@query("""SELECT 'value' AS "column", round(avg((value > 1)::INTEGER), 6) AS hit_rate FROM events UNION ALL SELECT 'props', round(avg((props LIKE '%5%')::INTEGER), 6) FROM events""")
def observed_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.when(F.col("value") > 1, F.col("value")).alias("value"), F.when(F.col("props").contains("5"), F.col("props")).alias("props"))
    return ag.hit_rates(rows, ["value", "props"]).select("column", r6(F.col("hit_rate")).alias("hit_rate"))


@query("""WITH b AS (SELECT event_type, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(s) AS ts, sum(q) AS tq FROM b)
SELECT event_type, CAST(tn - n AS BIGINT) AS n_out, round((ts - s) / (tn - n), 6) AS mean_out, round((tq - q) / (tn - n) - pow((ts - s) / (tn - n), 2), 6) AS var_out FROM b, t""")
def leave_block_out(spark: SparkSession, d: str) -> DataFrame:
    return ag.leave_block_out(table(spark, d, "events"), "event_type", "value").select("event_type", "n_out", r6(F.col("mean_out")).alias("mean_out"), r6(F.col("var_out")).alias("var_out"))


@query("""SELECT event_type, round(avg(m), 6) AS mean_of_means, count(*) AS n_inner FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY 1""")
def group_then_global(spark: SparkSession, d: str) -> DataFrame:
    return ag.group_then_global(table(spark, d, "events"), ["event_type"], ["user_id"], "value").withColumn("mean_of_means", r6(F.col("mean_of_means")))


@query("""SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS weighted_discount, round(sum(l_discount) / sum(l_quantity), 9) AS ratio FROM lineitem GROUP BY 1""")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    ratio = ag.ratio_of_sums(li, ["l_returnflag"], "l_discount", "l_quantity")
    mean = li.groupBy("l_returnflag").agg(r6(ag.weighted_mean(F.col("l_discount"), F.col("l_extendedprice"))).alias("weighted_discount"))
    return mean.join(ratio.withColumn("ratio", F.round("ratio", 9)), "l_returnflag")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_census(spark: SparkSession, d: str) -> DataFrame:
    return jn.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT round(embedding[1]::DOUBLE, 1) + 0 AS d0, round(embedding[2]::DOUBLE, 1) + 0 AS d1, round(embedding[3]::DOUBLE, 1) + 0 AS d2, count(*) AS n FROM embeddings GROUP BY ALL""")
def dup_vectors(spark: SparkSession, d: str) -> DataFrame:
    from .registry import vectors

    return st.duplicate_vectors(vectors(spark, d, 3), ["d0", "d1", "d2"], 1)


@query("""WITH a AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, s, CAST(sum(x) AS BIGINT) AS difference FROM (SELECT k, s, 1 AS x FROM a UNION ALL SELECT k, s, -1 FROM b) GROUP BY ALL HAVING sum(x) <> 0""")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return st.multiset_difference(o.where("o_orderkey % 2 = 0").select("k", "s"), o.where("o_orderkey % 2 = 1").select("k", "s"))


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 10 <> 3), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal + 1e-9 END AS v FROM customer WHERE c_custkey % 10 <> 4)
SELECT 'v' AS "column", count(*) FILTER (abs(a.v - b.v) > 1e-6) AS n_different FROM a JOIN b USING (k)
UNION ALL SELECT '(unmatched keys)', count(*) FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def tolerance_compare(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = c.where("c_custkey % 10 <> 4").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 1.0).otherwise(1e-9)).alias("v"))
    return st.tolerance_difference(a, b, ["k"], ["v"])


@query("""SELECT CASE WHEN length(text) < 200 THEN 'short' WHEN text LIKE '%@%' THEN 'address' WHEN lang <> 'en' THEN 'language' ELSE 'pass' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def quarantine_ladder(spark: SparkSession, d: str) -> DataFrame:
    rules = [("short", F.length("text") < 200), ("address", F.col("text").contains("@")), ("language", F.col("lang") != "en")]
    return table(spark, d, "documents").select(fc.first_reason(rules).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY 1""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return parsed.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("*").alias("n"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers, regexp_extract(text, '([A-Za-z0-9._]+)@', 1) AS first_user, sha256(text) AS digest, md5(text) AS md5 FROM documents""")
def packed_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).cast("long").alias("n_numbers"), F.regexp_extract("text", "([A-Za-z0-9._]+)@", 1).alias("first_user"), F.sha2("text", 256).alias("digest"), F.md5("text").alias("md5"))


@query("""SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page, coalesce(regexp_extract(url, '[?&]utm_source=([^&#]+)', 1), '') AS utm FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("page"), F.regexp_extract("url", "[?&]utm_source=([^&#]+)", 1).alias("utm"))


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer)
SELECT c_custkey, round((c_acctbal - b) / ((c - a) / 1.349), 6) AS z FROM customer, q""")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    return ag.robust_z(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", r6(F.col("z")).alias("z"))


@query("""WITH s AS (SELECT avg(c_acctbal) FILTER (c_custkey % 5 <> 0) AS m, stddev_pop(c_acctbal) FILTER (c_custkey % 5 <> 0) AS sd FROM customer)
SELECT c_custkey, round((c_acctbal - m) / sd, 6) AS c_acctbal FROM customer, s""")
def standardise_train(spark: SparkSession, d: str) -> DataFrame:
    return ag.standardised(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], F.col("c_custkey") % 5 != 0).withColumn("c_acctbal", r6(F.col("c_acctbal")))


@query("""SELECT p_partkey, (p_type = 'ECONOMY')::INTEGER AS p_type_ECONOMY, (p_type = 'SMALL')::INTEGER AS p_type_SMALL, (p_type NOT IN ('ECONOMY', 'SMALL'))::INTEGER AS p_type_other,
round(25 * pow(1 - least(p_size, 50) / 1e2, 24), 6) AS weight, least(p_size / 1e2, 1 - p_size / 1e2) AS maf, round(2 * (p_size / 1e2) * (1 - p_size / 1e2) * 0.9, 6) AS variance FROM part""")
def derived_columns(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.special import beta_density

    af = F.col("p_size") / 100.0
    rows = fc.one_hot(table(spark, d, "part"), "p_type", ["ECONOMY", "SMALL"], "other")
    return rows.select("p_partkey", "p_type_ECONOMY", "p_type_SMALL", "p_type_other", r6(beta_density(F.least(F.col("p_size"), F.lit(50)) / 100.0, 1, 25)).alias("weight"), fc.folded(af).alias("maf"), r6(fc.dosage_variance(af, F.lit(0.9))).alias("variance"))


@query("""SELECT a, b, n, round(r, 6) AS r FROM (
SELECT 'd0' AS a, 'd1' AS b, count(*) AS n, corr(d0, d1) AS r FROM v UNION ALL SELECT 'd0', 'd2', count(*), corr(d0, d2) FROM v UNION ALL SELECT 'd1', 'd2', count(*), corr(d1, d2) FROM v)""".replace("FROM v", "FROM (SELECT embedding[1]::DOUBLE AS d0, embedding[2]::DOUBLE AS d1, embedding[3]::DOUBLE AS d2 FROM embeddings)"))
def column_correlations(spark: SparkSession, d: str) -> DataFrame:
    from .registry import vectors

    return ag.correlations(vectors(spark, d, 3), ["d0", "d1", "d2"]).withColumn("r", r6(F.col("r")))


@query("""SELECT "column", round(sum(q - s * s / n), 6) AS within, round(sum(q) - sum(s) * sum(s) / sum(n), 6) AS total, round(sum(q - s * s / n) / (sum(q) - sum(s) * sum(s) / sum(n)), 6) AS ratio FROM (
SELECT 'd' || (k - 1) AS "column", label, count(*) AS n, sum(embedding[k]::DOUBLE) AS s, sum(embedding[k]::DOUBLE * embedding[k]::DOUBLE) AS q FROM embeddings, (SELECT unnest(range(1, 9)) AS k) GROUP BY ALL) GROUP BY 1""")
def variance_ratio(spark: SparkSession, d: str) -> DataFrame:
    from .registry import vectors

    out = ag.variance_ratio(vectors(spark, d, 8), "label", [f"d{k}" for k in range(8)])
    return out.select("column", *[r6(F.col(c)).alias(c) for c in ("within", "total", "ratio")])


@query("""SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'assistant') AS n_assistant, CAST(sum(length(text)) AS BIGINT) AS n_chars, arg_min(role, turn) AS first_role FROM conversations GROUP BY 1""")
def conversation_census(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.sum(F.length("text").cast("long")).alias("n_chars"), F.min_by("role", "turn").alias("first_role"))


@query("""SELECT count(*) AS n_pairs, count(DISTINCT l_partkey) AS n_a, count(DISTINCT l_suppkey) AS n_b, round(count(*) / count(DISTINCT l_suppkey), 6) AS mean_per_b FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def redundancy(spark: SparkSession, d: str) -> DataFrame:
    return ag.redundancy(table(spark, d, "lineitem"), "l_partkey", "l_suppkey").withColumn("mean_per_b", r6(F.col("mean_per_b")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS b,
CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 0 THEN 2 WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 1 ELSE 0 END AS incomplete FROM customer""")
def all_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 3 != 0, F.col("c_acctbal")).alias("a"), F.when(k % 4 != 0, F.col("c_nationkey")).alias("b"))
    return fc.all_or_nothing(rows, ["a", "b"])
