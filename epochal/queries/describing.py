"""Queries of descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import describe
from .registry import plain, query, table


def _summary_sql(columns, by="l_returnflag", source="lineitem"):
    return " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS variable, count({c}) AS n, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(avg({c}), 4) AS mean, round(coalesce(stddev_samp({c}), 0), 4) AS std, round(sum({c})::DOUBLE, 2) AS sum FROM {source} GROUP BY {by}"
        for c in columns
    )


@query(_summary_sql(["l_quantity", "l_extendedprice", "l_discount"]))
def summary(spark, sf_dir):
    out = describe.summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])
    return plain(out.withColumn("sum", F.round("sum", 2)), 4)


@query("""
    WITH m AS (SELECT o_orderpriority, sum(o_custkey * o_totalprice) / sum(o_custkey) AS m FROM orders GROUP BY 1)
    SELECT o.o_orderpriority, 'o_totalprice' AS variable, count(*) AS n, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(any_value(m.m), 4) AS mean,
      round(sqrt(sum(o_custkey * (o_totalprice - m.m) ** 2) / (sum(o_custkey) - 1)), 4) AS std
    FROM orders o JOIN m USING (o_orderpriority) GROUP BY o.o_orderpriority""")
def summary_weighted(spark, sf_dir):
    return plain(describe.summary(table(spark, sf_dir, "orders"), ["o_totalprice"], ["o_orderpriority"], "o_custkey").drop("sum"), 4)


@query("""
    WITH r AS (SELECT c_mktsegment, c_acctbal AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
    q AS (SELECT unnest([0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9])::DOUBLE AS share),
    p AS (SELECT DISTINCT c_mktsegment, n, share, least(greatest(share * (n + 1), 1.0), n) AS place FROM r, q)
    SELECT p.c_mktsegment, p.share, round((1 - (place - floor(place))) * a.x + (place - floor(place)) * b.x, 6) AS value
    FROM p JOIN r a ON a.c_mktsegment = p.c_mktsegment AND a.k = floor(place) JOIN r b ON b.c_mktsegment = p.c_mktsegment AND b.k = least(floor(place) + 1, p.n)""")
def quantiles(spark, sf_dir):
    return plain(describe.quantiles(table(spark, sf_dir, "customer"), "c_acctbal", by=["c_mktsegment"]))


@query("""
    WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderstatus, o_orderpriority, n, sum(n) OVER w::BIGINT AS cumulated, round(100.0 * n / sum(n) OVER (), 6) AS percent, round(100.0 * sum(n) OVER w / sum(n) OVER (), 6) AS cumulated_percent
    FROM c WINDOW w AS (ORDER BY o_orderstatus, o_orderpriority)""".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def frequencies(spark, sf_dir):
    return plain(describe.frequencies(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("""
    WITH c AS (SELECT l_linenumber, sum(l_quantity) AS n FROM lineitem GROUP BY ALL)
    SELECT l_linenumber::BIGINT AS l_linenumber, round(n, 4) AS n, round(sum(n) OVER w, 4) AS cumulated, round(100.0 * n / sum(n) OVER (), 4) AS percent, round(100.0 * sum(n) OVER w / sum(n) OVER (), 4) AS cumulated_percent
    FROM c WINDOW w AS (ORDER BY l_linenumber)""")
def frequencies_weighted(spark, sf_dir):
    return plain(describe.frequencies(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_quantity"), 4)


@query("""
    WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY ALL)
    SELECT o_orderstatus, o_orderpriority, n, round(100 * n / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS row_percent, round(100 * n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS column_percent,
      round(sum(n) OVER (PARTITION BY o_orderstatus) * sum(n) OVER (PARTITION BY o_orderpriority) / sum(n) OVER (), 6) AS expected FROM c""")
def crosstab(spark, sf_dir):
    return plain(describe.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query("""
    WITH d AS (SELECT l_linenumber AS x, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS y FROM lineitem),
    c AS (SELECT x, y, count(*)::DOUBLE AS n FROM d GROUP BY ALL), xs AS (SELECT x, sum(n) AS r FROM c GROUP BY x), ys AS (SELECT y, sum(n) AS c FROM c GROUP BY y), t AS (SELECT sum(n) AS t FROM c),
    g AS (SELECT x, y, coalesce(n, 0) AS n, r, ys.c AS cc, r * ys.c / t AS e, t FROM xs CROSS JOIN ys CROSS JOIN t LEFT JOIN c USING (x, y)),
    k AS (SELECT sum((n - e) ** 2 / e) AS chi2, 2 * sum(CASE WHEN n > 0 THEN n * ln(n / e) ELSE 0 END) AS lr, any_value(t) AS t, sum(n * n / r) AS gk FROM g),
    p AS (SELECT sum(CASE WHEN b.x > a.x AND b.y > a.y THEN a.n * b.n ELSE 0 END) AS con, sum(CASE WHEN b.x > a.x AND b.y < a.y THEN a.n * b.n ELSE 0 END) AS dis FROM c a, c b),
    m AS (SELECT (SELECT max(r) FROM xs) AS rmax, (SELECT max(c) FROM ys) AS cmax, (SELECT sum(b) FROM (SELECT max(n) AS b FROM c GROUP BY x)) AS best_y, (SELECT sum(b) FROM (SELECT max(n) AS b FROM c GROUP BY y)) AS best_x,
      (SELECT sum(r * r) FROM xs) AS rr, (SELECT sum(c * c) FROM ys) AS cc, (SELECT sum(c * ln(c)) FROM ys) AS clog, (SELECT count(*) FROM xs) AS nx, (SELECT count(*) FROM ys) AS ny)
    SELECT t AS n, round(chi2, 6) AS chi2, round(lr, 6) AS lr, ((nx - 1) * (ny - 1))::BIGINT AS df, round(sqrt(chi2 / t), 6) AS phi, round(sqrt(chi2 / (t * (least(nx, ny) - 1))), 6) AS cramer_v, round(sqrt(chi2 / (chi2 + t)), 6) AS contingency,
      round((best_x - rmax) / (t - rmax), 6) AS lambda_x, round((best_y - cmax) / (t - cmax), 6) AS lambda_y, round((best_x + best_y - rmax - cmax) / (2 * t - rmax - cmax), 6) AS lambda_sym, round((gk - cc / t) / (t - cc / t), 6) AS tau_y,
      round(lr / 2 / (t * ln(t) - clog), 6) AS uncertainty_y, round(2 * (con - dis) / sqrt((t * t - rr) * (t * t - cc)), 6) AS kendall_tau_b, round((con - dis) / (con + dis), 6) AS gamma, round(2 * (con - dis) / (t * t - rr), 6) AS somers_y
    FROM k, p, m""")
def association(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("y"))
    return plain(describe.association(rows, "x", "y"))


@query("""
    WITH b AS (SELECT CASE WHEN o_totalprice >= 200000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 WHEN o_totalprice >= 50000 THEN 1 WHEN o_totalprice >= 0 THEN 0 END AS bin, o_totalprice, o_custkey FROM orders WHERE o_totalprice >= 0 AND o_totalprice < 500000)
    SELECT bin::BIGINT AS bin, [0.0, 50000, 100000, 200000][bin + 1]::DOUBLE AS low, [50000.0, 100000, 200000, 500000][bin + 1]::DOUBLE AS high, count(*) AS n, count(*)::DOUBLE AS weighted, round(avg(o_totalprice), 4) AS mean_x, round(avg(o_custkey), 4) AS mean_y FROM b GROUP BY bin""")
def binned(spark, sf_dir):
    return plain(describe.binned(table(spark, sf_dir, "orders"), "o_totalprice", [0, 50000, 100000, 200000, 500000], "o_custkey", drop_empty=True), 4)


#: Decimal places at which sums of different orders agree, by columns.
_MEASURES = {"l_quantity": 4, "l_extendedprice": 0, "l_discount": 6}
_PAIRS = [(a, b, min(_MEASURES[a], _MEASURES[b]) if a != b else _MEASURES[a]) for k, a in enumerate(_MEASURES) for b in list(_MEASURES)[: k + 1]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_samp({a}, {b}), {k}) AS covariance, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b, k in _PAIRS))
def covariances(spark, sf_dir):
    out = describe.covariances(table(spark, sf_dir, "lineitem"), list(_MEASURES))
    digits = F.coalesce(*[F.when((F.col("x") == a) & (F.col("y") == b), F.round("covariance", k)) for a, b, k in _PAIRS])
    return plain(out.withColumn("covariance", digits))


@query("SELECT count(*) * 0 + (SELECT count(*) FROM supplier) AS n, round(sum(sign(a.s_acctbal - b.s_acctbal) * sign(a.s_nationkey - b.s_nationkey)) / count(*), 6) AS tau FROM supplier a JOIN supplier b ON a.s_suppkey > b.s_suppkey")
def rank_correlation(spark, sf_dir):
    return plain(describe.rank_correlation(table(spark, sf_dir, "supplier"), "s_acctbal", "s_nationkey"))


@query("""
    WITH r AS (SELECT c_mktsegment, c_acctbal AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_acctbal >= 0)
    SELECT c_mktsegment, count(*) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(stddev_samp(x) / avg(x), 6) AS variation,
      round(sum((2 * k - n - 1) * x) / (any_value(n)::DOUBLE * (any_value(n) - 1) * avg(x)), 6) AS gini FROM r GROUP BY c_mktsegment""")
def inequality(spark, sf_dir):
    out = describe.inequality(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"])
    return plain(out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)}))


@query("""
    WITH c AS (SELECT l_linenumber AS k, sum(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END)::DOUBLE AS a, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS b FROM lineitem GROUP BY 1),
    t AS (SELECT sum(a) AS ga, sum(b) AS gb, sum(a + b) AS g, count(*) AS k FROM c),
    e AS (SELECT sum(abs(x.b / (x.a + x.b) - y.b / (y.a + y.b)) * (x.a + x.b) * (y.a + y.b)) / 2 AS md FROM c x, c y)
    SELECT any_value(t.k) AS n_classes, any_value(g) AS total, any_value(ga) AS total_0, any_value(gb) AS total_1, round(0.5 * sum(abs(a / ga - b / gb)), 6) AS dissimilarity,
      round(sum((a + b) * (b / (a + b) - gb / g) ** 2) / any_value(g * gb / g * (1 - gb / g)), 6) AS variance_ratio, round(any_value(md) / any_value(g * g * gb / g * (1 - gb / g)), 6) AS gini FROM c, t, e""")
def segregation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("g"), "l_linenumber")
    return plain(describe.segregation(rows, "g", "l_linenumber"))


@query("""
    WITH c AS (SELECT l_linenumber AS x, l_returnflag AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c), xs AS (SELECT x, sum(n) / any_value(t) AS f FROM c, t GROUP BY x), ys AS (SELECT y, sum(n) AS s FROM c GROUP BY y)
    SELECT ys.y AS l_returnflag, round(max(abs(coalesce(c.n, 0) / ys.s - xs.f)), 8) AS delta FROM xs CROSS JOIN ys LEFT JOIN c ON c.x = xs.x AND c.y = ys.y GROUP BY ys.y""")
def independence(spark, sf_dir):
    return plain(describe.independence(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag"), 8)


@query()
def principal_components(spark, sf_dir):
    _, _, scores = describe.principal_components(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], correlation=True)
    return plain(scores.select("l_orderkey", "l_linenumber", "pc1", "pc2"))


@query("""
    WITH r AS (SELECT 1960 + (o_custkey % 15) AS b, year(o_orderdate) AS s, year(o_orderdate) + (o_orderkey % 4) AS e, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS d FROM orders),
    x AS (SELECT b, e, d, unnest(generate_series(greatest(s, 1996), least(e, 2000))) AS year FROM r WHERE greatest(s, 1996) <= least(e, 2000))
    SELECT (year - b)::BIGINT AS age, year::BIGINT AS year, count(*) AS risk, count(*) FILTER (d <> 0 AND year = e) AS events, round(count(*) FILTER (d <> 0 AND year = e) / count(*), 6) AS rate FROM x WHERE year - b BETWEEN 25 AND 35 GROUP BY 1, 2""")
def age_period(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((1960 + F.col("o_custkey") % 15).alias("b"), F.year("o_orderdate").alias("s"), (F.year("o_orderdate") + F.col("o_orderkey") % 4).alias("e"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("d"))
    return plain(describe.age_period(rows, "b", "s", "e", "d", (1996, 2000), (25, 35)))


@query("""
    WITH b AS (SELECT floor(l_quantity / 10) AS k, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 60 GROUP BY 1), e AS (SELECT unnest(generate_series(0, 5)) AS k)
    SELECT (e.k * 10)::DOUBLE AS low, (e.k * 10 + 10)::DOUBLE AS high, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM b) / 10, 8) AS height FROM e LEFT JOIN b USING (k)""")
def histogram(spark, sf_dir):
    return plain(describe.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", range(0, 70, 10)), 8)


@query("""
    WITH p AS (SELECT unnest([0.0, 2000, 4000, 6000, 8000])::DOUBLE AS at)
    SELECT p.at, round(coalesce(sum(15.0 / 16 * (1 - ((c_acctbal - p.at) / 1500) ** 2) ** 2), 0) / ((SELECT count(*) FROM customer) * 1500.0), 10) AS density FROM p LEFT JOIN customer ON abs(c_acctbal - p.at) <= 1500 GROUP BY p.at""")
def density(spark, sf_dir):
    return plain(describe.density(table(spark, sf_dir, "customer"), "c_acctbal", [0, 2000, 4000, 6000, 8000], 1500.0), 10)


@query("""
    WITH p AS (SELECT unnest([5.0, 15, 25, 35, 45])::DOUBLE AS at)
    SELECT p.at, count(*) AS n, round(sum(0.75 * (1 - ((l_quantity - p.at) / 4) ** 2) * l_extendedprice) / sum(0.75 * (1 - ((l_quantity - p.at) / 4) ** 2)), 4) AS mean FROM p JOIN lineitem ON abs(l_quantity - p.at) <= 4 GROUP BY p.at""")
def smoothed_mean(spark, sf_dir):
    return plain(describe.smoothed_mean(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", [5, 15, 25, 35, 45], 4.0, "epanechnikov"), 4)
