"""Operators that the other modules leave out, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import clusters, graphs, intervals, joins, matrices, sequences, spatial
from .histories import _KINDS, kinds
from .registry import plain, query, table
from .structures import _MATRIX, _TREE, spans, table_matrix, tree


@query("""
    SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity = 25 THEN 1 ELSE 0 END)::BIGINT AS eq, (CASE WHEN l_quantity <> 25 THEN 1 ELSE 0 END)::BIGINT AS ne, (CASE WHEN l_discount <= 0.05 THEN 1 ELSE 0 END)::BIGINT AS le,
      (CASE WHEN l_tax <> 0 OR l_discount <> 0 THEN 1 ELSE 0 END)::BIGINT AS either, round(CASE WHEN l_discount <> 0 THEN l_tax ELSE l_quantity END, 6) AS chosen, l_linenumber::DOUBLE AS value FROM lineitem""")
def comparisons(spark, sf_dir):
    t, c = table(spark, sf_dir, "lineitem"), F.col
    return plain(t.select("l_orderkey", "l_linenumber", scalar.eq(c("l_quantity"), 25).cast("long").alias("eq"), scalar.ne(c("l_quantity"), 25).cast("long").alias("ne"), scalar.le(c("l_discount"), 0.05).cast("long").alias("le"), scalar.or_(c("l_tax"), c("l_discount")).cast("long").alias("either"), scalar.choose(c("l_discount"), c("l_tax"), c("l_quantity")).alias("chosen"), scalar.string_value(F.concat(F.lit(" "), c("l_linenumber").cast("string"))).alias("value")))


@query("""
    SELECT l_linenumber::BIGINT AS k, l_quantity AS mean, round(l_linenumber * ln(l_quantity) - l_quantity - lgamma(l_linenumber + 1), 6) AS poisson,
      round(lgamma(l_linenumber + 2.5) - lgamma(2.5) - lgamma(l_linenumber + 1) + 2.5 * ln(2.5 / (2.5 + l_quantity)) + l_linenumber * ln(l_quantity / (2.5 + l_quantity)), 6) AS negative_binomial, count(*) AS n FROM lineitem GROUP BY ALL""")
def count_densities(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("mean")).agg(F.count("*").alias("n"))
    return plain(t.select("k", "mean", scalar.log_poisson(F.col("mean"), F.col("k")).alias("poisson"), scalar.log_negative_binomial(F.col("mean"), F.lit(2.5), F.col("k")).alias("negative_binomial"), "n"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END, 6) AS c_acctbal FROM customer")
def recoded_values(spark, sf_dir):
    return plain(joins.recode(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", F.lit(0.0), F.col("c_acctbal") < 0))


@query(f"""
    WITH m AS ({_MATRIX}), r AS (
      SELECT 'transposed' AS kind, j AS i, i AS j, v FROM m UNION ALL SELECT 'product', i, j, v * v FROM m UNION ALL SELECT 'root', i, j, sqrt(v) FROM m WHERE i = j UNION ALL SELECT 'inverse_root', i, j, 1 / sqrt(v) FROM m WHERE i = j
      UNION ALL SELECT 'share', i, j, v / (SELECT sum(v) FROM m) FROM m UNION ALL SELECT 'zeroed', i, j, CASE WHEN i > j THEN 0 ELSE v END FROM m UNION ALL SELECT 'columns', (j - 1) * 7 + i, 1, v FROM m UNION ALL SELECT 'rows', (i - 1) * 3 + j, 1, v FROM m
      UNION ALL SELECT 'beside', i, j, v FROM m UNION ALL SELECT 'beside', i, j + 3, v FROM m UNION ALL SELECT 'permuted', 8 - i, j, v FROM m UNION ALL SELECT 'grouped', i % 2, j % 2, sum(v) FROM m GROUP BY i % 2, j % 2
      UNION ALL SELECT 'edges', i, j, v FROM m WHERE v >= (SELECT avg(v) FROM m) UNION ALL SELECT 'constant', a, b, 2.5 FROM generate_series(1, 4) x(a), generate_series(1, 3) y(b))
    SELECT kind, i::BIGINT AS i, j::BIGINT AS j, round(v, 6)::DOUBLE AS v FROM r""")
def matrix_forms(spark, sf_dir):
    m = table_matrix(spark, sf_dir)
    mean = m.agg(F.avg("v")).first()[0] or 0.0
    places = lambda n: spark.range(1, n + 1).select(F.col("id").alias("index"), (F.col("id") % 2).alias("group"))
    forms = {
        "transposed": matrices.transposed(m), "product": matrices.elementwise(m, m, lambda a, b: a * b), "root": matrices.root_diagonal(m), "inverse_root": matrices.root_diagonal(m, inverse=True), "share": matrices.shares(m),
        "zeroed": matrices.zeroed(m, F.col("i") > F.col("j")), "columns": matrices.stacked(m, 7, 3), "rows": matrices.stacked(m, 7, 3, by_rows=True), "beside": matrices.beside(m, m, 3),
        "permuted": matrices.permuted(m, spark.range(1, 8).select(F.col("id").alias("k"), (8 - F.col("id")).alias("p"))), "grouped": matrices.grouped(m, places(7), places(3)), "edges": matrices.edges(m, mean), "constant": matrices.constant(spark, 4, 3, 2.5),
    }
    out = None
    for kind, form in forms.items():
        form = form.select(F.lit(kind).alias("kind"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        out = form if out is None else out.union(form)
    return plain(out)


@query("SELECT n_nationkey::BIGINT + 1 AS i, u.j::BIGINT AS j, (CASE u.j WHEN 1 THEN n_nationkey ELSE n_regionkey END)::DOUBLE AS v FROM nation, (SELECT unnest([1, 2]) AS j) u")
def matrix_of_rows(spark, sf_dir):
    return plain(matrices.from_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", ["n_nationkey", "n_regionkey"]))


@query("""
    WITH d AS (SELECT datediff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS t, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS censored FROM orders), g AS (SELECT t, count(*) FILTER (censored = 0) AS events, count(*) AS n FROM d GROUP BY t),
    r AS (SELECT *, sum(n) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM g)
    SELECT t, round(1 - exp(sum(CASE WHEN events < risk THEN ln(1 - events / risk) ELSE -1e9 END) OVER (ORDER BY t)), 5) AS distribution FROM r WHERE events > 0""")
def order_dates_distribution(spark, sf_dir):
    t = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    rows = table(spark, sf_dir, "orders").select(t.alias("t"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("censored"))
    return plain(matrices.product_limit_distribution(rows, "t", "censored"), 5)


@query(f"WITH RECURSIVE e AS ({_TREE}), d(node, steps) AS (SELECT 0, 0 UNION ALL SELECT e.j, d.steps + 1 FROM d JOIN e ON e.i = d.node) SELECT 0::BIGINT AS source, node::BIGINT AS node, steps::BIGINT AS steps FROM d")
def reachable_nodes(spark, sf_dir):
    return plain(graphs.reachable(tree(spark, sf_dir), spark.range(1).withColumnRenamed("id", "node")))


@query("SELECT a.n_nationkey + 1 AS i, b.n_nationkey + 1 AS j, 1.0::DOUBLE AS v FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def complete_graph(spark, sf_dir):
    return plain(graphs.complete(spark, table(spark, sf_dir, "nation").count())).withColumns({c: F.col(c).cast("int") for c in "ij"})


@query(f"SELECT 'digraph {{' AS value UNION ALL SELECT '  ' || i || ' -> ' || j || ';' FROM ({_TREE}) UNION ALL SELECT '}}'")
def dot_lines(spark, sf_dir):
    return graphs.dot(tree(spark, sf_dir))


@query(f"""
    WITH RECURSIVE e AS ({_TREE}), up(node, part) AS (SELECT j, j FROM e WHERE i = 0 UNION ALL SELECT e.j, up.part FROM up JOIN e ON e.i = up.node)
    SELECT node::BIGINT AS node, part::BIGINT AS part FROM up WHERE node NOT IN (SELECT i FROM e)""")
def leaves_of_regions(spark, sf_dir):
    return plain(clusters.leaves_at(tree(spark, sf_dir), 0, 1))


_TRACK = "SELECT user_id, event_id, value AS x, (event_id % 50)::DOUBLE AS y FROM events WHERE value IS NOT NULL"


def tracks(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    return spatial.gathered(e, "user_id", "event_id", "x", "y")


@query(f"""
    WITH t AS ({_TRACK}), d AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id AS id, round(coalesce(sum(d), 0), 4) AS length, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, min(y) AS ymin, max(y) AS ymax, count(*) AS points FROM d GROUP BY user_id""")
def track_lengths(spark, sf_dir):
    out = tracks(spark, sf_dir).select("id", F.round(spatial.length(), 4).alias("length"), *[c.alias(k) for k, c in spatial.box().items()], F.size("shape").alias("points"))
    return plain(out)


@query(f"SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, round(x, 6) AS x, y FROM ({_TRACK})")
def track_vertices(spark, sf_dir):
    return plain(spatial.vertices(tracks(spark, sf_dir)))


@query("""
    WITH p AS (SELECT radians(c_acctbal / 100) AS l, radians((c_custkey % 170 - 85)::DOUBLE) AS f, c_custkey FROM customer), k AS (SELECT *, sin(radians(30)) * sin(f) + cos(radians(30)) * cos(f) * cos(l) AS c FROM p)
    SELECT c_custkey, round(l, 6) AS mercator_x, round(ln(tan(f / 2 + pi() / 4)), 6) AS mercator_y, round(l * cos(f), 6) AS sinusoidal_x, round(sqrt(2 / (1 + c)) * cos(f) * sin(l), 6) AS azimuthal_x, round(sqrt(2 / (1 + c)) * (cos(radians(30)) * sin(f) - sin(radians(30)) * cos(f) * cos(l)), 6) AS azimuthal_y FROM k""")
def map_projections(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("lon"), (F.col("c_custkey") % 170 - 85).cast("double").alias("lat"))
    of = lambda kind, center=(0.0, 0.0): spatial.projected(F.col("lon"), F.col("lat"), kind, center)
    (mx, my), (sx, _), (ax, ay) = of("mercator"), of("sinusoidal"), of("azimuthal", (0.0, 30.0))
    return plain(c.select("c_custkey", mx.alias("mercator_x"), my.alias("mercator_y"), sx.alias("sinusoidal_x"), ax.alias("azimuthal_x"), ay.alias("azimuthal_y")))


@query(f"SELECT id, t::BIGINT AS t, state::BIGINT AS state FROM ({_KINDS})")
def long_sequences(spark, sf_dir):
    return plain(sequences.to_long(kinds(spark, sf_dir)))


@query(f"SELECT id, string_agg(CASE WHEN state = 0 THEN '1' ELSE '0' END, '' ORDER BY t) AS s0, string_agg(CASE WHEN state = 4 THEN '1' ELSE '0' END, '' ORDER BY t) AS s4 FROM ({_KINDS}) GROUP BY id")
def state_indicators(spark, sf_dir):
    flags = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "").alias(c)
    return sequences.indicators(kinds(spark, sf_dir), [0, 4]).select("id", flags("s0"), flags("s4"))


@query(f"""
    WITH s AS ({_KINDS}), n AS (SELECT id, t, state, lead(state) OVER (PARTITION BY id ORDER BY t) AS next FROM s)
    SELECT id, t::BIGINT AS t, (CASE WHEN next = 2 THEN 1 ELSE 0 END)::BIGINT AS event, state::BIGINT AS own FROM n WHERE state = 4 AND next IS NOT NULL""")
def event_risks(spark, sf_dir):
    s = kinds(spark, sf_dir)
    return plain(sequences.event_risks(s, {"own": s}, 4, 2))


@query("""
    WITH s AS (SELECT floor(o_totalprice / 1000) AS lo, floor(o_totalprice / 1000) + o_orderkey % 7 AS hi FROM orders), c AS (SELECT lo, hi, count(*) AS c FROM s GROUP BY ALL), e AS (SELECT lo AS x FROM c UNION SELECT hi FROM c),
    k AS (SELECT x, sum(CASE WHEN hi <= x OR lo > x THEN c ELSE 0 END) AS n, sum(CASE WHEN hi <= x THEN hi * c WHEN lo > x THEN lo * c ELSE 0 END) AS s FROM e CROSS JOIN c GROUP BY x), u AS (SELECT CASE WHEN n > 0 THEN s / n ELSE x END AS u FROM k WHERE x * n - s <= 0 ORDER BY x DESC LIMIT 1)
    SELECT count(*) AS n, round(avg(lo), 6) AS mean_lo, round(avg(hi), 6) AS mean_hi, round(var_pop(lo), 4) AS variance_lo, round(var_pop(hi), 4) AS variance_hi, round(avg(greatest(lo - u, u - hi, 0) ** 2), 4) AS variance_least, round(any_value(u), 6) AS mean_least FROM s, u""")
def variance_of_intervals(spark, sf_dir):
    out = intervals.variance_bounds(spans(spark, sf_dir)).drop("variance_most")
    return plain(out.select("n", "mean_lo", "mean_hi", *[F.round(c, 4).alias(c) for c in ("variance_lo", "variance_hi", "variance_least")], "mean_least"))


@query("""
    WITH s AS (SELECT floor(o_totalprice / 1000) AS lo, floor(o_totalprice / 1000) + o_orderkey % 7 AS hi FROM orders), c AS (SELECT lo, hi, count(*) AS c FROM s GROUP BY ALL), x AS (SELECT DISTINCT lo AS x FROM c),
    p AS (SELECT x, sum(c * CASE WHEN hi > lo THEN (hi - greatest(lo, x)) / (hi - lo) ELSE 1 END) AS w, sum(c * CASE WHEN hi > lo THEN (hi - greatest(lo, x)) / (hi - lo) * (hi + greatest(lo, x)) / 2 ELSE hi END) AS m FROM x JOIN c ON hi > x GROUP BY x)
    SELECT x.x, round(m / w, 4) AS mean FROM x LEFT JOIN p ON p.x = x.x""")
def interval_means_above(spark, sf_dir):
    wide = spans(spark, sf_dir)
    return plain(intervals.means_above(wide), 4)
