"""Queries of the statistics operators over the star-schema tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import names, safe
from tessella.operators import clusters, distributions as dist, groups, metric_join, relations, surfaces
from tessella.operators.ranks import numbered
from tessella.sources.tables import table

from .registry import Registry

registry = Registry()
query = registry.add

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TYPES = "'click', 'purchase', 'scroll', 'search', 'view'"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


@query("""
WITH f AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders), a AS (SELECT DISTINCT o_orderpriority FROM f), b AS (SELECT DISTINCT o_orderstatus FROM f),
n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
SELECT a.o_orderpriority, b.o_orderstatus, r.replicate, coalesce(n.n, 0) AS n_observed
FROM a CROSS JOIN b CROSS JOIN (SELECT unnest(range(1, 6)) AS replicate) r LEFT JOIN n ON n.o_orderpriority = a.o_orderpriority AND n.o_orderstatus = b.o_orderstatus
""")
def design_matrix(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    counts = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n_observed"))
    factors = [counts.select(c).distinct() for c in ("o_orderpriority", "o_orderstatus")]
    design = groups.factorial_design(*factors, spark.range(1, 6).withColumnRenamed("id", "replicate"))
    return design.join(counts, ["o_orderpriority", "o_orderstatus"], "left").na.fill(0, ["n_observed"])


@query("""
WITH f AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS factor FROM (SELECT DISTINCT event_type FROM events)),
s AS (SELECT (floor((user_id - 1) / 5.0) + 1)::BIGINT AS sample_id, event_type, sum(value) AS amount FROM events GROUP BY ALL)
SELECT sample_id, round(sum(amount * factor), 4) AS weighted, round(sum(amount), 4) AS total FROM s JOIN f USING (event_type) GROUP BY sample_id
""")
def weighted_composition(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    long = events.groupBy(safe.sample_block("user_id").alias("sample_id"), "event_type").agg(F.sum("value").alias("amount"))
    kinds = events.select("event_type").distinct()
    factors = numbered(kinds, ["event_type"], name="factor").select("event_type", "factor")
    return rounded(groups.weighted_sum(long, factors, "sample_id", "event_type", "amount", "factor"), 4)


_LEVELS = "SELECT o_orderpriority || '/' || o_orderstatus AS condition, dense_rank() OVER (ORDER BY o_orderpriority) AS f, dense_rank() OVER (ORDER BY o_orderstatus) AS s, m FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY ALL)"


@query(f"""
WITH l AS ({_LEVELS})
SELECT a.condition AS source, b.condition AS target FROM l a JOIN l b ON abs(a.f - b.f) + abs(a.s - b.s) = 1
""")
def condition_adjacency(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    cells = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    level = lambda c: F.dense_rank().over(Window.orderBy(c))  # noqa: E731  over the few cells
    levels = cells.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("condition"), level("o_orderpriority").alias("f"), level("o_orderstatus").alias("s"))
    return relations.adjacent(levels, "condition", "f", "s")


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
  round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std, min(l_discount) AS l_discount_min, max(l_discount) AS l_discount_max
FROM lineitem GROUP BY l_returnflag
""")
def group_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.summary(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"]))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_std, min(l_tax) AS l_tax_min, max(l_tax) AS l_tax_max
FROM lineitem GROUP BY ALL
""")
def group_mean_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_tax"]))


def _describe_sql(by: str) -> str:
    one = "SELECT {by}'{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS least, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS most FROM lineitem {group}"
    return " UNION ALL ".join(one.format(c=c, by=f"{by}, " if by else "", group=f"GROUP BY {by}" if by else "") for c in NUMBERS)


@query(_describe_sql("l_returnflag"))
def group_describe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.describe(table(spark, d, "lineitem"), NUMBERS, ["l_returnflag"]), 4)


@query(_describe_sql(""))
def global_describe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.describe(table(spark, d, "lineitem"), NUMBERS), 4)


@query("SELECT event_type, round(avg((value > 10)::INT) * 100, 6) AS rate_pct, count(*) AS n FROM events GROUP BY event_type")
def rate_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.rate(table(spark, d, "events"), ["event_type"], F.col("value") > 10))


_CV = "SELECT event_type, user_id % 9 AS condition, count(value) AS n, CASE WHEN count(value) > 1 AND avg(value) > 0 THEN stddev_pop(value) / avg(value) * 100 END AS cv_pop, stddev_samp(value) / avg(value) * 100 AS cv_samp FROM events GROUP BY ALL"


def _cv(spark: SparkSession, d: str) -> DataFrame:
    return groups.variation(table(spark, d, "events").withColumn("condition", F.col("user_id") % 9), ["event_type", "condition"], "value")


@query(f"SELECT event_type, condition, n, round(cv_pop, 6) AS cv_pop, round(cv_samp, 6) AS cv_samp FROM ({_CV})")
def cv_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_cv(spark, d))


@query(f"SELECT event_type, round(avg(cv_pop), 6) AS mean_cv_pop, count(cv_pop) AS n_groups FROM ({_CV}) GROUP BY event_type")
def mean_of_group_cv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.mean_of(_cv(spark, d), ["event_type"], "cv_pop"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_o_orderpriority, arg_min(o_totalprice, o_orderkey) AS first_o_totalprice FROM orders GROUP BY o_custkey")
def group_first(spark: SparkSession, d: str) -> DataFrame:
    return groups.first_by(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderpriority", "o_totalprice"])


_FLOW_Q = "SELECT quantile_cont(o_totalprice, 1/3) AS a, quantile_cont(o_totalprice, 2/3) AS b FROM orders"


@query(f"""
SELECT o_orderpriority, o_orderstatus, CASE WHEN o_totalprice <= a THEN 'Low' WHEN o_totalprice <= b THEN 'Medium' ELSE 'High' END AS level, count(*) AS n
FROM orders CROSS JOIN ({_FLOW_Q}) GROUP BY ALL
""")
def flow_counts(spark: SparkSession, d: str) -> DataFrame:
    return dist.terciles(table(spark, d, "orders"), "o_totalprice", "level").groupBy("o_orderpriority", "o_orderstatus", "level").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, count(DISTINCT (floor((user_id - 1) / 5.0))) AS n_blocks FROM events GROUP BY event_type")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct(safe.sample_block("user_id")).alias("n_blocks"))


@query("""
SELECT (floor((user_id - 1) / 5.0) + 1)::BIGINT AS sample_id, count(*) AS n, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max
FROM events GROUP BY 1
""")
def block_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.summary(table(spark, d, "events").withColumn("sample_id", safe.sample_block("user_id")), ["sample_id"], ["value"]))


EVENT_TYPES = ["click", "purchase", "scroll", "search", "view"]
PRIORITIES = ["p1", "p2", "p3", "p4", "p5"]


@query("SELECT user_id % 9 AS condition, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS \"{t}\"" for t in EVENT_TYPES) + " FROM events GROUP BY 1")
def pivot_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.pivot_mean(table(spark, d, "events").withColumn("condition", F.col("user_id") % 9), "condition", "event_type", EVENT_TYPES, "value"))


@query("SELECT o_orderstatus, " + ", ".join(f"round(avg(o_totalprice) FILTER (p = '{p}'), 4) AS {p}" for p in PRIORITIES) + " FROM (SELECT *, 'p' || left(o_orderpriority, 1) AS p FROM orders) GROUP BY o_orderstatus")
def pivot_3x3(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("p", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    return rounded(groups.pivot_mean(orders, "o_orderstatus", "p", PRIORITIES, "o_totalprice"), 4)


_MEANS = ", ".join(f"avg({c}) AS {c}" for c in NUMBERS)


@query(f"""
WITH m AS (SELECT l_linenumber, {_MEANS} FROM lineitem GROUP BY 1), u AS (UNPIVOT m ON {", ".join(NUMBERS)} INTO NAME feature VALUE value)
SELECT feature, round(max(value) - min(value), 4) AS value_range, round(stddev_samp(value) / avg(value) * 100, 4) AS cv_pct FROM u GROUP BY feature
""")
def range_cv(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "lineitem").groupBy("l_linenumber").agg(*(F.avg(c).alias(c) for c in NUMBERS))
    return rounded(groups.ranges(means, "l_linenumber", NUMBERS), 4)


@query("""
WITH m AS (SELECT l_shipdate::DATE AS day, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c FROM lineitem GROUP BY 1)
SELECT day, round(a / (a + b + c), 6) AS l_quantity_share, round(b / (a + b + c), 6) AS l_discount_share, round(c / (a + b + c), 6) AS l_tax_share FROM m
""")
def band_shares(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return rounded(groups.mean_shares(items, ["day"], ["l_quantity", "l_discount", "l_tax"]))


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS metric, round(avg({c}) / max({c}), 6) AS score FROM lineitem GROUP BY 1" for c in NUMBERS))
def radar_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.mean_over_most(table(spark, d, "lineitem"), ["l_returnflag"], NUMBERS))


_R = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"


@query(f"WITH r AS (SELECT {_R.format('l_quantity', 'l_extendedprice')} AS r, count(*) AS n FROM lineitem) SELECT round(r, 6) AS r, n, round(r * r, 6) AS r2 FROM r")
def pearson_pair(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query(f"WITH r AS (SELECT l_suppkey, {_R.format('l_quantity', 'l_extendedprice')} AS r, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, round(r, 6) AS r, n, round(r * r, 6) AS r2 FROM r")
def pearson_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"]))


_MATRIX = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {f'CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END' if a == b else _R.format(a, b)} AS r FROM lineitem" for a in NUMBERS for b in NUMBERS)


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return relations.matrix(table(spark, d, "lineitem"), NUMBERS)


@query(f"SELECT a, b, round(r::DOUBLE, 6) AS r FROM ({_MATRIX})")
def corr_matrix_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_matrix(spark, d))


_EMB_PAIRS = [(i, i + 32) for i in range(32)]
_EMB_R = ", ".join(_R.format(f"embedding[{a + 1}]::DOUBLE", f"embedding[{b + 1}]::DOUBLE") for a, b in _EMB_PAIRS)


@query(f"WITH p AS (SELECT unnest([{_EMB_R}]) AS r FROM embeddings) SELECT round(avg(r), 6) AS r_mean, round(stddev_pop(r), 6) AS r_std, count(r) AS n FROM p")
def corr_summary(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "embeddings").select(*(F.col("embedding")[i].cast("double").alias(f"e{i}") for p in _EMB_PAIRS for i in p))
    return rounded(relations.paired(wide, [(f"e{a}", f"e{b}") for a, b in _EMB_PAIRS]))


@query(f"WITH p AS (SELECT label::BIGINT AS label, unnest([{_EMB_R}]) AS r FROM embeddings GROUP BY 1) SELECT label, round(avg(r), 6) AS r_mean, round(stddev_pop(r), 6) AS r_std, count(r) AS n FROM p GROUP BY label")
def paired_corr_by_group(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "embeddings").select("label", *(F.col("embedding")[i].cast("double").alias(f"e{i}") for p in _EMB_PAIRS for i in p))
    return rounded(relations.paired(wide, [(f"e{a}", f"e{b}") for a, b in _EMB_PAIRS], ["label"]))


@query(f"SELECT a, b, round(r, 6) AS correlation, round(abs(r), 6) AS weight FROM ({_MATRIX}) WHERE a < b AND abs(r) > 0.0005")
def corr_network_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.network(_matrix(spark, d), 0.0005))


@query(f"SELECT 4::BIGINT AS n_nodes, count(*) AS n_edges, round(2.0 * count(*) / 12, 6) AS density FROM ({_MATRIX}) WHERE a < b AND abs(r) > 0.0005")
def graph_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.density(relations.network(_matrix(spark, d), 0.0005), len(NUMBERS)))


_ANOVA = """
WITH g AS (SELECT {g} AS g, count(*) AS n, avg({v}) AS m, coalesce(var_pop({v}), 0) AS v FROM {t} WHERE {v} IS NOT NULL GROUP BY 1),
s AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * power(m - (SELECT sum(n * m) / sum(n) FROM g), 2)) AS ssb, sum(n * v) AS ssw FROM g)
SELECT k, n, round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f, round(ssb / (ssb + ssw), 6) AS eta_squared FROM s
"""


@query(_ANOVA.format(g="l_returnflag", v="l_quantity", t="lineitem"))
def anova_f(spark: SparkSession, d: str) -> DataFrame:
    out = relations.anova(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")
    return rounded(out.withColumn("f", F.round("f", 4)))


@query(_ANOVA.format(g="(floor((user_id - 1) / 5.0))", v="value", t="events"))
def anova_by_block(spark: SparkSession, d: str) -> DataFrame:
    out = relations.anova(table(spark, d, "events").withColumn("block", safe.sample_block("user_id")), "block", "value")
    return rounded(out.withColumn("f", F.round("f", 4)))


@query()
def anova_p_value(spark: SparkSession, d: str) -> DataFrame:
    out = relations.anova(table(spark, d, "events"), "event_type", "value", p_value=True)
    return out.withColumn("p_text", safe.p_value_text(F.col("p"))).withColumn("stars", safe.p_value_stars(F.col("p")))


@query()
def pearson_p_value(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("x"), F.avg("l_discount").alias("y"))
    return relations.correlation(means, "x", "y", ["l_returnflag"], p_value=True)


@query("""
WITH r AS (SELECT l_suppkey, abs(covar_pop(l_quantity, l_tax) / nullif(stddev_pop(l_quantity) * stddev_pop(l_tax), 0)) / 10 AS p FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.4f', round(p, 4)) END AS p_text, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM r WHERE p IS NOT NULL
""")
def p_value_labels(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.abs(safe.safe_corr("l_quantity", "l_tax")) / 10).alias("p")).filter("p IS NOT NULL")
    return r.select("l_suppkey", safe.p_value_text(F.round("p", 4)).alias("t"), "p").select("l_suppkey", F.when(F.col("p") < 0.001, "<0.001").otherwise(F.col("t")).alias("p_text"), safe.p_value_stars(F.col("p")).alias("stars"))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events")
def zscore_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.zscores(table(spark, d, "events").select("event_id", "value"), ["value"]))


@query(f"""
WITH m AS (SELECT l_suppkey, {_MEANS} FROM lineitem GROUP BY 1), u AS (UNPIVOT m ON {", ".join(NUMBERS)} INTO NAME feature VALUE value)
SELECT l_suppkey, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS row_z FROM u WINDOW w AS (PARTITION BY l_suppkey)
""")
def zscore_rows(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*(F.avg(c).alias(c) for c in NUMBERS))
    return rounded(dist.row_zscores(means, "l_suppkey", NUMBERS))


@query("SELECT event_id, round((value - lo) / (hi - lo) * 40 + 10, 6) AS value_scaled FROM events CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi FROM events)")
def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.minmax(table(spark, d, "events").select("event_id", "value"), "value", 10, 50).drop("value"))


@query("""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem
WHERE l_extendedprice < (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem) AND l_quantity < (SELECT quantile_cont(l_quantity, 0.99) FROM lineitem)
""")
def outlier_p99_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = dist.below_quantile(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), ["l_extendedprice", "l_quantity"])
    return rounded(kept.select("l_orderkey", "l_linenumber"))


@query("""
WITH h AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)
SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM h)), 6) AS by_mean, round(coalesce(v, 0), 6) AS by_zero FROM h
""")
def fill_policies(spark: SparkSession, d: str) -> DataFrame:
    holes = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("by_mean"))
    return rounded(dist.fill_mean(holes.withColumn("by_zero", F.col("by_mean")), ["by_mean"]).na.fill(0.0, ["by_zero"]))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END, 6) AS ratio FROM lineitem")
def safe_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", safe.safe_ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio")))


def _bin(c: str, k: int) -> str:
    return f"least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {k}), {k - 1})::BIGINT"


_EDGES = "SELECT min(l_quantity) AS lo_l_quantity, max(l_quantity) AS hi_l_quantity, min(l_discount) AS lo_l_discount, max(l_discount) AS hi_l_discount, min(l_tax) AS lo_l_tax, max(l_tax) AS hi_l_tax, min(l_extendedprice) AS lo_l_extendedprice, max(l_extendedprice) AS hi_l_extendedprice FROM lineitem"


@query(f"""
SELECT {_bin("l_extendedprice", 20)} AS bin_l_extendedprice, count(*) AS n, round(min(lo_l_extendedprice + ({_bin("l_extendedprice", 20)} + 0.5) * (hi_l_extendedprice - lo_l_extendedprice) / 20), 4) AS center_l_extendedprice
FROM lineitem CROSS JOIN ({_EDGES}) GROUP BY 1
""")
def hist_equal_width(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.histogram(table(spark, d, "lineitem"), ["l_extendedprice"], 20), 4)


@query(f"""
SELECT {_bin("l_quantity", 10)} AS bin_l_quantity, {_bin("l_discount", 10)} AS bin_l_discount, {_bin("l_extendedprice", 10)} AS bin_l_extendedprice, count(*) AS n FROM lineitem CROSS JOIN ({_EDGES}) GROUP BY 1, 2, 3
""")
def hist_3d(spark: SparkSession, d: str) -> DataFrame:
    made = dist.histogram(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], 10)
    return rounded(made.select("bin_l_quantity", "bin_l_discount", "bin_l_extendedprice", "n"))


@query("""
WITH e AS (SELECT *, l_quantity AS x, l_extendedprice AS y FROM lineitem), q AS (SELECT quantile_cont(x, 0.99) AS qx, quantile_cont(y, 0.99) AS qy FROM e),
f AS (SELECT x, y FROM e CROSS JOIN q WHERE x < qx AND y < qy), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM f),
u AS (SELECT (x - x0) / (x1 - x0) * 20 AS u, (y - y0) / (y1 - y0) * 11 AS v FROM f CROSS JOIN b),
c AS (SELECT *, floor(u + 0.5) AS a, floor(v + 0.5) AS b, floor(u) AS c, floor(v) AS d FROM u),
h AS (SELECT *, power(u - a, 2) + 3 * power(v - b, 2) < power(u - c - 0.5, 2) + 3 * power(v - d - 0.5, 2) AS even FROM c)
SELECT even, (CASE WHEN even THEN a ELSE c END)::BIGINT AS col, (CASE WHEN even THEN b ELSE d END)::BIGINT AS row, count(*) AS n FROM h GROUP BY ALL
""")
def hexbin_counts(spark: SparkSession, d: str) -> DataFrame:
    kept = dist.below_quantile(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return dist.hexbin(kept, "l_quantity", "l_extendedprice", 20)


@query("""
SELECT event_id, CASE WHEN value <= a THEN 'Low' WHEN value <= b THEN 'Medium' ELSE 'High' END AS level
FROM events CROSS JOIN (SELECT quantile_cont(value, 1/3) AS a, quantile_cont(value, 2/3) AS b FROM events)
""")
def qcut_terciles(spark: SparkSession, d: str) -> DataFrame:
    return dist.terciles(table(spark, d, "events").select("event_id", "value"), "value", "level").drop("value")


@query("""
WITH q AS (SELECT event_type, min(value) AS least, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, max(value) AS most FROM events GROUP BY 1)
SELECT event_type, round(least, 6) AS least, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(most, 6) AS most,
  round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS low_fence, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS high_fence
FROM events JOIN q USING (event_type) GROUP BY ALL
""")
def boxplot_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.boxes(table(spark, d, "events"), ["event_type"], "value"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(stddev_samp({c}) / avg({c}) * 100), 4) AS cv_pct FROM lineitem" for c in KEYS + NUMBERS) + " ORDER BY cv_pct DESC LIMIT 10")
def topk_cv_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.most_variable(table(spark, d, "lineitem"), KEYS + NUMBERS, 10), 4)


@query("""
WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) * power(count(value), -0.2) AS h FROM events GROUP BY 1 HAVING count(value) >= 3),
v AS (SELECT event_type, value AS v, count(*) AS c FROM events GROUP BY ALL), g AS (SELECT unnest(range(0, 300)) AS g),
k AS (SELECT event_type, g, g * (100.0 / 299) AS x, sum(c * exp(-0.5 * power((g * (100.0 / 299) - v) / h, 2))) / (min(n) * min(h) * sqrt(2 * 3.141592653589793)) AS density
  FROM v JOIN s USING (event_type) CROSS JOIN g GROUP BY event_type, g)
SELECT event_type, g, round(x, 6) AS x, round(density, 6) AS density, round(density / max(density) OVER (PARTITION BY event_type), 6) AS scaled FROM k
""")
def kde_1d_ridge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.density_1d(table(spark, d, "events"), "event_type", "value", 0.0, 100.0, 300))


@query("""
WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS a, l_discount AS b, l_tax AS c FROM lineitem), w AS (SELECT a, b, c, count(*) AS w FROM p GROUP BY ALL),
m AS (SELECT count(*) AS n, 0.0225 * covar_samp(a, a) AS aa, 0.0225 * covar_samp(b, b) AS bb, 0.0225 * covar_samp(c, c) AS cc, 0.0225 * covar_samp(a, b) AS ab, 0.0225 * covar_samp(a, c) AS ac, 0.0225 * covar_samp(b, c) AS bc FROM p),
i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
f AS (SELECT x.a, x.b, x.c, y.w, n, det, ((bb * cc - bc * bc) * power(x.a - y.a, 2) + (aa * cc - ac * ac) * power(x.b - y.b, 2) + (aa * bb - ab * ab) * power(x.c - y.c, 2)
  + 2 * ((ac * bc - ab * cc) * (x.a - y.a) * (x.b - y.b) + (ab * bc - ac * bb) * (x.a - y.a) * (x.c - y.c) + (ab * ac - aa * bc) * (x.b - y.b) * (x.c - y.c))) / det AS q FROM w x CROSS JOIN w y CROSS JOIN i),
s AS (SELECT a, b, c, round(sum(w * exp(-0.5 * q)) / (min(n) * sqrt(power(2 * 3.141592653589793, 3) * min(det))), 4) AS density FROM f GROUP BY ALL)
SELECT k, density FROM p JOIN s USING (a, b, c)
""")
def kde_3d_at_points(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(dist.density_3d(items, "k", ["l_quantity", "l_discount", "l_tax"]), 4)


@query("""
WITH r AS (SELECT event_type, value AS sample, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, i, round(CASE WHEN i = n THEN power(0.5, 1.0 / n) WHEN i = 1 THEN 1 - power(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END, 6) AS p, round(sample, 6) AS sample FROM r
""")
def qq_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dist.normal_plot(table(spark, d, "events"), "event_type", "value", "event_id").drop("theoretical"))


@query()
def qq_normal_fit(spark: SparkSession, d: str) -> DataFrame:
    return dist.normal_fit(dist.normal_plot(table(spark, d, "events"), "event_type", "value", "event_id"), "event_type")


@query(f"""
WITH r AS (SELECT label, embedding[1]::DOUBLE AS v, (vec_id * {dist.DRAW_B} + {dist.DRAW_C}) % {dist.DRAW_M} AS x FROM embeddings),
b AS (SELECT b, (b * {dist.DRAW_A} + {dist.DRAW_C}) % {dist.DRAW_M} AS y FROM (SELECT unnest(range(1, 1001)) AS b)),
u AS (SELECT label, b, v, x, y, (x * y) % {dist.DRAW_M} AS u FROM r CROSS JOIN b),
w AS (SELECT label, b, v, len(list_filter({dist.DRAW_LIMITS}, lambda t: t <= (u * u + x + y) % {dist.DRAW_M})) AS w FROM u),
m AS (SELECT label, b, sum(w * v) / sum(w) AS m FROM w GROUP BY ALL)
SELECT label::BIGINT AS label, (SELECT count(*) FROM embeddings e WHERE e.label = m.label) AS n, round((SELECT avg(embedding[1]::DOUBLE) FROM embeddings e WHERE e.label = m.label), 6) AS mean,
  round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY label
""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    firsts = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("v"))
    return rounded(dist.bootstrap(firsts, "label", "v", "vec_id", 1000))


_DISTANCES = """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY i)),
z AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: coalesce((embedding[i]::DOUBLE - m[i]) / s[i], 0)) AS v FROM embeddings CROSS JOIN m),
p AS (SELECT * FROM z ORDER BY vec_id LIMIT 50)
SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS distance, 1 / (1 + list_distance(a.v, b.v)) AS similarity FROM p a CROSS JOIN z b
"""


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return relations.distances(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"SELECT i, j, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM ({_DISTANCES})")
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_distances(spark, d))


@query(f"WITH s AS ({_DISTANCES}) SELECT i, j, round(similarity, 6) AS weight FROM s WHERE i < j AND similarity > (SELECT quantile_cont(similarity, 0.8) FROM s)")
def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.similarity_edges(_distances(spark, d)))


@query("""
WITH v AS (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS k, count(*) AS n FROM embeddings GROUP BY 1)
SELECT a.k AS i, b.k AS j, a.n AS ni, b.n AS nj, round(list_distance(a.v, b.v), 6) AS distance FROM v a JOIN v b ON a.k < b.k AND list_distance(a.v, b.v) <= 1.2
""")
def near_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The graph of all vectors at most 1.2 apart."""
    return rounded(metric_join.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 1.2))


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    columns = [f"e{i}" for i in range(64)]
    return table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns))), columns


@query()
def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    return clusters.principal_components(_wide(spark, d)[0], "vec_id", _wide(spark, d)[1])


@query()
def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    return clusters.component_scores(_wide(spark, d)[0], "vec_id", _wide(spark, d)[1])


@query()
def kmeans_three(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(_wide(spark, d)[0], "vec_id", _wide(spark, d)[1])


@query()
def linkage_complete(spark: SparkSession, d: str) -> DataFrame:
    return clusters.feature_tree(relations.wide_matrix(*_wide(spark, d)), "complete")


@query()
def linkage_ward(spark: SparkSession, d: str) -> DataFrame:
    return clusters.feature_tree(relations.wide_matrix(*_wide(spark, d)), "ward")


@query()
def matrix_in_leaf_order(spark: SparkSession, d: str) -> DataFrame:
    """The correlation matrix with its rows and columns placed by the tree."""
    return clusters.in_leaf_order(relations.wide_matrix(*_wide(spark, d)), "complete")


@query("""
SELECT r_name, n_name, count(*) AS n, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(avg(c_acctbal), 4) AS c_acctbal_mean
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
""")
def means_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Facts looked up in their dimensions: orders by customer, customers by nation, nations by region."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    met = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(met.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("o_totalprice_mean"), F.avg("c_acctbal").alias("c_acctbal_mean")), 4)


@query("""
SELECT s_nationkey, n, round(mean, 4) AS mean, row_number() OVER (ORDER BY round(mean, 4) DESC, s_nationkey) AS place
FROM (SELECT s_nationkey, count(*) AS n, avg(l_extendedprice) AS mean FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
""")
def groups_by_mean(spark: SparkSession, d: str) -> DataFrame:
    """Groups in the order of their means, largest first."""
    met = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    means = met.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    return groups.by_mean(means, "mean", "s_nationkey").orderBy("place")


_RADAR = [("l_quantity", "max"), ("l_extendedprice", "max"), ("l_discount", "spread"), ("l_tax", "spread")]


@query(" UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS metric, round({f'avg({c}) / max({c})' if how == 'max' else f'1 - stddev_samp({c}) / avg({c})'}, 6) AS score FROM lineitem GROUP BY 1" for c, how in _RADAR
))
def radar_vector(spark: SparkSession, d: str) -> DataFrame:
    """A profile of several kinds of scores: levels against their largest value, and evenness as 1 - variation."""
    return rounded(groups.profile(table(spark, d, "lineitem"), ["l_returnflag"], dict(_RADAR)))


@query(f"""
SELECT feature, round(avg(value), 6) AS mean, count(value) AS n FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON {", ".join(NUMBERS)} INTO NAME feature VALUE value) GROUP BY feature
""")
def matching_columns(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns picked by their names, as far as they exist, in long form."""
    items = table(spark, d, "lineitem")
    picked = names.matching(items, r"^l_(quantity|extendedprice|discount|tax|unknown)$")
    long = names.existing(items, [*picked, "l_absent"]).unpivot([], picked, "feature", "value")
    return rounded(long.groupBy("feature").agg(F.avg("value").alias("mean"), F.count("value").alias("n")))


@query(f"WITH p AS (SELECT unnest([{_EMB_R}]) AS r FROM embeddings) SELECT round(avg(r), 6) AS r_mean, round(stddev_pop(r), 6) AS r_std, count(r) AS n FROM p")
def derived_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Columns of two modalities paired by their names."""
    vectors = table(spark, d, "embeddings")
    wide = vectors.select(*(F.col("embedding")[i].cast("double").alias(f"{'normal' if i < 32 else 'sem'}_e{i % 32}") for i in range(64)), F.lit(1.0).alias("normal_alone"))
    return rounded(relations.paired(wide, names.pairs(wide, "normal_", "sem_")))


@query("""
WITH p AS (SELECT l_quantity AS x, l_discount AS y, avg(l_tax) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
g AS (SELECT gx, gy, x0 + gx * (x1 - x0) / 29 AS ax, y0 + gy * (y1 - y0) / 29 AS ay FROM b CROSS JOIN (SELECT unnest(range(0, 30)) AS gx) CROSS JOIN (SELECT unnest(range(0, 30)) AS gy)),
d AS (SELECT gx, gy, v, round(power(ax - x, 2) + power(ay - y, 2), 9) AS d FROM g CROSS JOIN p)
SELECT gy, gx, round(min(v) FILTER (d = m), 6) AS value FROM (SELECT *, min(d) OVER (PARTITION BY gx, gy) AS m FROM d) GROUP BY ALL
""")
def nearest_surface(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clusters.nearest_surface(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_tax", 30))


@query("""
WITH p AS (SELECT avg(c_acctbal)::DOUBLE AS x, avg(c_custkey) AS y, count(*)::DOUBLE AS v, row_number() OVER (ORDER BY c_nationkey, c_mktsegment) AS i FROM customer GROUP BY c_nationkey, c_mktsegment),
t AS (SELECT a.i AS i, b.i AS j, c.i AS k, a.x AS ax, a.y AS ay, a.v AS av, b.x AS bx, b.y AS by_, b.v AS bv, c.x AS cx, c.y AS cy, c.v AS cv,
  b.x - a.x AS ux, b.y - a.y AS uy, c.x - a.x AS wx, c.y - a.y AS wy FROM p a JOIN p b ON a.i < b.i JOIN p c ON b.i < c.i),
o AS (SELECT *, ux * wy - uy * wx AS d, (wy * (ux * ux + uy * uy) - uy * (wx * wx + wy * wy)) / (2 * (ux * wy - uy * wx)) AS ox, (ux * (wx * wx + wy * wy) - wx * (ux * ux + uy * uy)) / (2 * (ux * wy - uy * wx)) AS oy FROM t),
e AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i <> o.i AND p.i <> o.j AND p.i <> o.k AND power(p.x - ax - ox, 2) + power(p.y - ay - oy, 2) < ox * ox + oy * oy)),
q AS (SELECT gy, gx, x0 + gx * (x1 - x0) / 14 AS x, y0 + gy * (y1 - y0) / 14 AS y FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) CROSS JOIN (SELECT unnest(range(0, 15)) AS gx) CROSS JOIN (SELECT unnest(range(0, 15)) AS gy)),
h AS (SELECT gy, gx, av, bv, cv, ((x - ax) * wy - (y - ay) * wx) / d AS r, (ux * (y - ay) - uy * (x - ax)) / d AS s FROM q CROSS JOIN e),
l AS (SELECT gy, gx, min(av + r * (bv - av) + s * (cv - av)) AS value FROM h WHERE r >= -1e-9 AND s >= -1e-9 AND r + s <= 1 + 1e-9 GROUP BY ALL),
n AS (SELECT gy, gx, arg_min(v, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS value FROM q CROSS JOIN p GROUP BY ALL)
SELECT gy, gx, round(coalesce(l.value, n.value), 4) AS value FROM n LEFT JOIN l USING (gy, gx)
""")
def linear_surface(spark: SparkSession, d: str) -> DataFrame:
    """Customers a cell of nation and segment, over the cells' mean balance and key."""
    cells = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").cast("double").alias("x"), F.avg("c_custkey").alias("y"), F.count("*").cast("double").alias("v"))
    return rounded(surfaces.linear_surface(cells, "x", "y", "v", 15), 4)


@query()
def feature_surface(spark: SparkSession, d: str) -> DataFrame:
    """The third component of every vector as a surface over the first two."""
    return surfaces.linear_surface(_wide(spark, d)[0], "e0", "e1", "e2", 40)


@query("""
SELECT DISTINCT p_type, array_to_string(list_transform(string_split(replace(regexp_replace('optical_' || lower(replace(p_type, ' ', '_')), '_d([0-9])', ' D\\1'), '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS label FROM part
""")
def label_format(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "part").select("p_type").distinct()
    return kinds.select("p_type", safe.readable(F.concat(F.lit("normal_"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))))).alias("label"))


_REWRITTEN = "array_to_string(list_transform(list_filter(string_split(replace(name, '_', ' '), ' '), lambda w: w <> ''), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
for _old, _new in names.DISPLAY:
    _REWRITTEN = f"replace({_REWRITTEN}, '{_old}', '{_new}')"
_NAMES = "SELECT DISTINCT 'sem_freq_' || lower(replace(p_type, ' ', '__')) || '_ssim_d' || (1 + p_size % 2)::INT || '_a' || (45 * (p_size % 4))::INT AS name FROM part"


@query(f"SELECT name, {_REWRITTEN} AS label FROM ({_NAMES})")
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    """Display names of column names as long as features have them."""
    kind = F.lower(F.replace("p_type", F.lit(" "), F.lit("__")))
    name = F.concat(F.lit("sem_freq_"), kind, F.lit("_ssim_d"), (1 + F.col("p_size") % 2).cast("int"), F.lit("_a"), (45 * (F.col("p_size") % 4)).cast("int"))
    return table(spark, d, "part").select(name.alias("name")).distinct().select("name", names.display(F.col("name")).alias("label"))


REPORTED = ["3-MEDIUM", "1-URGENT", "9-NONE", "2-HIGH", "5-LOW"]


@query(f"""
WITH o AS (SELECT k, i - 1 AS place FROM (SELECT unnest({REPORTED}) AS k, unnest(range(1, {len(REPORTED)} + 1)) AS i)), m AS (SELECT o_orderpriority, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS deviation, count(*) AS n FROM orders GROUP BY 1)
SELECT place, k AS o_orderpriority, round(mean, 4) AS mean, round(deviation, 4) AS deviation, n FROM o LEFT JOIN m ON o_orderpriority = k
""")
def reindexed_means(spark: SparkSession, d: str) -> DataFrame:
    """A summary in a fixed order of keys, one of which no order has."""
    means = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("deviation"), F.count("*").alias("n"))
    return rounded(groups.reindexed(means, "o_orderpriority", REPORTED), 4)


@query("SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def category_codes(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    codes = numbered(orders.select("o_orderpriority").distinct(), ["o_orderpriority"]).select("o_orderpriority", (F.col("i") - 1).alias("code"))
    return orders.join(codes, "o_orderpriority").select("o_orderkey", "o_orderpriority", "code")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, round(o_totalprice, 2) AS o_totalprice FROM orders")
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", step.cast("bigint").alias("step"), F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT a.l_returnflag, a.l_linenumber::BIGINT AS l_linenumber, n, m FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) a JOIN (SELECT l_returnflag, l_linenumber, round(avg(l_tax), 6) AS m FROM lineitem GROUP BY ALL) b USING (l_returnflag, l_linenumber)")
def design_join(spark: SparkSession, d: str) -> DataFrame:
    """Observations joined to their design cells by two keys."""
    items = table(spark, d, "lineitem")
    cells = items.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))
    means = items.groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_tax"), 6).alias("m"))
    return rounded(cells.join(means, ["l_returnflag", "l_linenumber"]))


