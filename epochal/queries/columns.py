"""Queries of row functions and of functions of ordered columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns, scalar, special
from .registry import plain, query, table


@query("""
    SELECT event_id, round(value, 6) AS value, round(sum(value) OVER (), 2) AS value_sum, round(avg(value) OVER (), 4) AS value_mean, round(stddev_samp(value) OVER (), 4) AS value_std, round(min(value) OVER (), 6) AS value_min, round(max(value) OVER (), 6) AS value_max FROM events""")
def column_totals(spark, sf_dir):
    out = columns.totals(table(spark, sf_dir, "events").select("event_id", "value"), "value")
    return plain(out.withColumns({"value_sum": F.round("value_sum", 2), "value_mean": F.round("value_mean", 4), "value_std": F.round("value_std", 4)}))


@query("""
    SELECT event_id, user_id, round(coalesce(lead(value) OVER w, 0), 6) AS next_value, round(coalesce(lag(value, 2) OVER w, 0), 6) AS second_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def values_ahead(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    rows = columns.ahead(rows, "value", 1, "event_id", "next_value", ["user_id"])
    return plain(columns.ahead(rows, "value", -2, "event_id", "second_last", ["user_id"]).drop("value"))


@query("SELECT event_id, round(coalesce(lead(value, 3) OVER (ORDER BY event_id), 0), 6) AS third_next FROM events")
def values_ahead_whole_column(spark, sf_dir):
    return plain(columns.ahead(table(spark, sf_dir, "events").select("event_id", "value"), "value", 3, "event_id", "third_next").drop("value"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 3) AS running FROM events")
def cumulated(spark, sf_dir):
    return plain(columns.cumulated(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", "running").drop("value"), 3)


@query("SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS smooth FROM events WHERE value IS NOT NULL")
def centred_moving_average(spark, sf_dir):
    return plain(columns.moving_average(table(spark, sf_dir, "events").where("value is not null").select("event_id", "value"), "value", 3, "event_id", "smooth").drop("value"), 4)


@query("""
    SELECT o_orderkey, round(sum(o_totalprice * o_custkey) OVER w / sum(o_custkey) OVER w, 2) AS later FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def tail_mean(spark, sf_dir):
    return plain(columns.tail_mean(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_totalprice", "o_custkey", "o_orderkey", "later").select("o_orderkey", "later"), 2)


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, rank() OVER w + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS l_quantity_rank, dense_rank() OVER w AS l_quantity_dense, round(cume_dist() OVER w, 8) AS l_quantity_cd
    FROM lineitem WINDOW w AS (ORDER BY l_quantity)""")
def ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return plain(columns.ranks(rows, "l_quantity").drop("l_quantity"), 8)


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS l_quantity_rank FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def ranks_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    return plain(columns.ranks(rows, "l_quantity", ["l_returnflag"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity_rank"))


@query("SELECT DISTINCT user_id, (SELECT count(DISTINCT event_type) FROM events e WHERE e.user_id = events.user_id) AS kinds FROM events")
def distinct_values(spark, sf_dir):
    return plain(columns.distinct_values(table(spark, sf_dir, "events").select("user_id", "event_type"), "event_type", "kinds", by=["user_id"]).select("user_id", "kinds").distinct())


@query("SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.9), 6) AS quantile FROM customer GROUP BY 1")
def quantile_of_column(spark, sf_dir):
    return plain(columns.quantile(table(spark, sf_dir, "customer"), "c_acctbal", 0.9, ["c_mktsegment"]))


@query("""
    WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), b AS (SELECT c_acctbal AS sorted, row_number() OVER (ORDER BY c_acctbal) AS k FROM customer)
    SELECT c_custkey, round(sorted, 6) AS sorted FROM a JOIN b USING (k)""")
def sorted_column(spark, sf_dir):
    return plain(columns.sorted_column(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", "sorted").select("c_custkey", "sorted"))


_RUNS = """
    WITH a AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS change FROM events WINDOW w AS ({part} ORDER BY event_id)),
    b AS (SELECT *, (sum(change) OVER ({part} ORDER BY event_id))::BIGINT AS run FROM a),
    c AS (SELECT *, count(*) OVER (PARTITION BY {key} run) AS run_size, row_number() OVER (PARTITION BY {key} run ORDER BY event_id) AS run_place FROM b)
    SELECT event_id, user_id, change::BIGINT AS change, run, run_size, run_place, CASE WHEN run_place = 1 THEN 1 ELSE 0 END::BIGINT AS run_first, CASE WHEN run_place = run_size THEN 1 ELSE 0 END::BIGINT AS run_last, run_place - 1 AS since FROM c"""


@query(_RUNS.format(part="PARTITION BY user_id", key="user_id,"))
def runs(spark, sf_dir):
    return plain(columns.runs(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_type", "event_id", ["user_id"]).drop("event_type"))


@query(_RUNS.format(part="", key=""))
def runs_of_whole_column(spark, sf_dir):
    return plain(columns.runs(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_type", "event_id").drop("event_type"))


@query("""
    WITH a AS (SELECT event_id, user_id, event_type, value, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS change FROM events),
    b AS (SELECT *, (sum(change) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS run FROM a)
    SELECT user_id, run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS size, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 5) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(DISTINCT value) AS distinct
    FROM b GROUP BY user_id, run, event_type""".replace("AS distinct", 'AS "distinct"'))
def run_statistics(spark, sf_dir):
    out = columns.run_statistics(table(spark, sf_dir, "events"), "event_type", "value", "event_id", ["user_id"])
    return plain(out.withColumn("std", F.round("std", 5)))


@query("""
    SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, dense_rank() OVER (ORDER BY c_nationkey) AS block, count(*) OVER p AS block_size, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS block_place, round(min(c_acctbal) OVER p, 6) AS block_min, round(max(c_acctbal) OVER p, 6) AS block_max,
      count(*) FILTER (c_acctbal > 0) OVER p AS block_positive, round(count(*) FILTER (c_acctbal > 0) OVER p / count(*) OVER p, 6) AS block_share FROM customer WINDOW p AS (PARTITION BY c_nationkey)""")
def blocks(spark, sf_dir):
    out = columns.blocks(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_custkey", "c_acctbal")
    return plain(out.drop("block_first", "block_last", "c_acctbal"))


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 0 ELSE 1 END::BIGINT AS absent FROM customer")
def absent(spark, sf_dir):
    return plain(columns.absent(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey"))


@query("""
    SELECT count(*) FILTER (l_linenumber = l_quantity) AS n_eq, count(*) FILTER (l_linenumber <> l_quantity) AS n_ne, count(*) FILTER (l_linenumber < l_quantity) AS n_lt, count(*) FILTER (l_linenumber > l_quantity) AS n_gt, count(*) FILTER (l_linenumber <= l_quantity) AS n_le, count(*) FILTER (l_linenumber >= l_quantity) AS n_ge FROM lineitem""")
def counted(spark, sf_dir):
    return plain(columns.counted(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity"), "l_linenumber", "l_quantity").select("n_eq", "n_ne", "n_lt", "n_gt", "n_le", "n_ge").distinct())


@query("""
    WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
    r(user_id, k, event_id, s) AS (SELECT user_id, k, event_id, 0.3::DOUBLE * value FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.event_id, 0.3::DOUBLE * e.value + 0.7::DOUBLE * r.s FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT event_id, user_id, round(s, 6) AS smooth FROM r""")
def smoothed_recursively(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", "value")
    return plain(columns.folded(rows, lambda last, r: 0.3 * r["value"] + 0.7 * last, F.lit(0.0), "event_id", ["value"], "smooth", ["user_id"]).drop("value"))


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 WHEN l_tax <> 0 THEN l_discount / l_tax END, 6) AS ratio, round(CASE WHEN l_tax = 0 THEN 0 ELSE l_tax ** 1.5 END, 8) AS power, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity % 7 END AS remainder,
      round(ln(l_extendedprice), 8) AS log, floor(l_extendedprice / 100 + 0.5) AS rounded, least(greatest(l_quantity, 10.0), 40.0) AS truncated, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 8) AS logistic, round(exp(-((l_quantity / 10) ** 2) / 2) / sqrt(2 * pi()), 10) AS density, round(lgamma(l_quantity), 6) AS log_gamma
    FROM lineitem""")
def row_functions(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    out = t.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(scalar.divide("l_discount", "l_tax"), 6).alias("ratio"), F.round(scalar.power("l_tax", F.lit(1.5)), 8).alias("power"), scalar.remainder("l_quantity", F.lit(7.0)).alias("remainder"),
        F.round(scalar.log("l_extendedprice"), 8).alias("log"), scalar.rounded(F.col("l_extendedprice") / 100).alias("rounded"), scalar.truncated("l_quantity", 10, 40).alias("truncated"), F.round(scalar.logistic((F.col("l_quantity") - 25) / 10), 8).alias("logistic"),
        F.round(scalar.normal_density(F.col("l_quantity") / 10), 10).alias("density"), F.round(scalar.log_gamma("l_quantity"), 6).alias("log_gamma"),
    )
    return out


@query("""
    SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_not, CASE WHEN c_nationkey <> 0 AND c_acctbal > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS both, CASE WHEN c_nationkey < 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS low, CASE WHEN c_nationkey >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS high,
      CASE WHEN c_nationkey IN (1, 3) OR c_nationkey BETWEEN 10 AND 12 OR c_nationkey >= 23 THEN 1.0 ELSE 0.0 END::DOUBLE AS chosen, CASE c_nationkey WHEN 1 THEN 100.0 WHEN 2 THEN 200.0 ELSE -1.0 END::DOUBLE AS recoded FROM customer""")
def logic_functions(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalar.not_("c_acctbal").alias("is_not"), scalar.and_("c_nationkey", scalar.gt("c_acctbal", F.lit(0.0))).alias("both"), scalar.lt("c_nationkey", F.lit(5)).alias("low"), scalar.ge("c_nationkey", F.lit(5)).alias("high"),
        scalar.dummy(F.col("c_nationkey"), [1, 3], [(10, 12), (23, None)]).alias("chosen"), scalar.recoded(F.col("c_nationkey"), {1: 100, 2: 200}, -1.0).alias("recoded"),
    )


@query("""
    SELECT o_orderkey, (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588)::BIGINT AS julian, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, (date_diff('day', DATE '1970-01-01', make_date(year(o_orderdate), month(o_orderdate), 1)) + 2440588)::BIGINT AS first_day FROM orders""")
def date_functions(spark, sf_dir):
    j = scalar.julian_of(F.to_date("o_orderdate"))
    return plain(table(spark, sf_dir, "orders").select("o_orderkey", j.alias("julian"), scalar.julian_year(j).alias("y"), scalar.julian_month(j).alias("m"), scalar.julian_day(j).alias("d"), scalar.julian(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)).alias("first_day")))


@query("""
    WITH p AS (SELECT n_nationkey AS k, n_nationkey * 13.0 - 160 AS lon, n_nationkey * 5.0 - 60 AS lat FROM nation), q AS (SELECT a.k AS a, b.k AS b, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2 AS h FROM p a JOIN p b ON a.k < b.k)
    SELECT a::BIGINT AS a, b::BIGINT AS b, round(degrees(2 * asin(sqrt(h))), 6) AS degrees FROM q""")
def great_circles(spark, sf_dir):
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 13.0 - 160).alias("lon"), (F.col("n_nationkey") * 5.0 - 60).alias("lat"))
    pairs = p.alias("a").join(p.alias("b"), F.col("a.k") < F.col("b.k"))
    return plain(pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), scalar.great_circle("a.lon", "a.lat", "b.lon", "b.lat").alias("degrees")))


@query()
def distribution_functions(spark, sf_dir):
    z = (F.col("c_acctbal") - 4500) / 3000
    t = table(spark, sf_dir, "customer").select("c_custkey", z.alias("z"))
    return plain(t.select("c_custkey", special.normal("z").alias("normal"), special.normal_hazard("z").alias("hazard"), special.chi2(F.abs("z") * 3, F.lit(2.0)).alias("chi2"), special.student("z", F.lit(5.0)).alias("student"), special.fisher(F.abs("z"), F.lit(3.0), F.lit(7.0)).alias("fisher"), scalar.digamma(F.abs("z") + 1).alias("digamma"), scalar.trigamma(F.abs("z") + 1).alias("trigamma")))
