"""Queries of joins, graphs, intervals, smoothing, spatial objects, matrices, models and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clusters, graphs, intervals, joins, matrices, regression, sequences, smoothing, spatial
from ..plans import ordered
from .histories import _KINDS, kinds
from .registry import plain, query, table

# joins


@query("""
    WITH e AS (SELECT user_id AS id, epoch_us(ts) / 3.6e9 - 473352 AS ts, lead(epoch_us(ts) / 3.6e9 - 473352) OVER (PARTITION BY user_id ORDER BY event_id) AS tf, event_id % 3 AS state, event_id % 2 AS half FROM events),
    a AS (SELECT 1 AS file, id, round(ts, 3) AS ts, round(tf, 3) AS tf, state FROM e WHERE half = 0 AND round(ts, 3) < round(tf, 3)), b AS (SELECT 2 AS file, id, round(ts + 1, 3) AS ts, round(tf + 3, 3) AS tf, state + 10 AS state FROM e WHERE half = 1 AND round(ts + 1, 3) < round(tf + 3, 3)),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b), n AS (SELECT id, count(*) AS records FROM u GROUP BY id), m AS (SELECT id, ts AS t FROM u UNION SELECT id, tf FROM u), c AS (SELECT id, t AS x, lead(t) OVER (PARTITION BY id ORDER BY t) AS y FROM m),
    s AS (SELECT c.id, c.x, c.y, u.file, u.state, row_number() OVER (PARTITION BY c.id, c.x, u.file ORDER BY u.ts, u.tf, u.state) AS level FROM c JOIN u ON u.id = c.id AND u.ts <= c.x AND c.x < u.tf WHERE c.y IS NOT NULL),
    g AS (SELECT id, x, y, level, coalesce(max(state) FILTER (file = 1), -3)::DOUBLE AS state1, coalesce(max(state) FILTER (file = 2), -3)::DOUBLE AS state2 FROM s GROUP BY ALL)
    SELECT g.id, records, dense_rank() OVER (PARTITION BY g.id ORDER BY x) AS "interval", level, x AS ts, y AS tf, state1, state2 FROM g JOIN n USING (id)""")
def overlapping_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 - 473352).alias("ts"))
    e = intervals.next_intervals(e, "event_id", "ts", ["id"]).select("id", F.round("lo", 3).alias("ts"), F.round("hi", 3).alias("tf"), "lo", "hi", (F.col("event_id") % 3).alias("state"), (F.col("event_id") % 2).alias("half"))
    b = e.where("half = 1").select("id", F.round(F.col("lo") + 1, 3).alias("ts"), F.round(F.col("hi") + 3, 3).alias("tf"), (F.col("state") + 10).alias("state"))
    return plain(joins.overlapped(e.where("half = 0").select("id", "ts", "tf", "state"), b))


@query("SELECT c_custkey, coalesce(max(o_orderkey), -3)::BIGINT AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def looked_up(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderkey").alias("k"))
    return plain(joins.looked_up(table(spark, sf_dir, "customer").select("c_custkey"), t, ["c_custkey"], last_by="k"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, coalesce((SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), -3)::BIGINT AS last_supplier FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def merged_files(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_suppkey").alias("last_supplier"))
    return plain(joins.merged(n, [c, s], ["n_nationkey"]).where("customers > 0"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey")
def selected_once(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.selected(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), keys, ["o_custkey"], once_by="o_orderkey")


@query("SELECT c_custkey, substring(c_name, 1, 3) || substring(c_name, 9, 4) || substring(c_name, 15) AS c_name FROM customer")
def records_without_characters(spark, sf_dir):
    return joins.without_characters(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", [(4, 8), (13, 14)])


@query("""
    WITH n AS (SELECT n_nationkey AS k, [n_nationkey::DOUBLE, n_regionkey::DOUBLE, (n_nationkey * 7 % 5)::DOUBLE] AS f FROM nation)
    SELECT a.k::BIGINT AS a, b.k::BIGINT AS b, round(sqrt((a.f[1] - b.f[1]) ** 2 + 2 * (a.f[2] - b.f[2]) ** 2 + (a.f[3] - b.f[3]) ** 2), 6) AS distance FROM n a JOIN n b ON a.k < b.k""")
def distances_of_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 7 % 5).alias("m"))
    return plain(joins.distances(n, "n_nationkey", ["n_nationkey", "n_regionkey", "m"], weights=[1, 2, 1]))


@query("SELECT c_custkey, u.k::BIGINT AS copy FROM customer, (SELECT unnest(generate_series(1, 4)) AS k) u WHERE u.k <= c_nationkey % 5")
def replicated_blocks(spark, sf_dir):
    times = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 5).alias("n"))
    return plain(joins.replicated(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", times, "n").select("c_custkey", "copy"))


@query("SELECT o_orderkey, round(o_totalprice * (SELECT count(*) FROM orders) / (SELECT sum(o_totalprice) FROM orders), 8) AS w FROM orders")
def normalised_weights(spark, sf_dir):
    return plain(joins.weights_to(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("w")), "w"), 8)


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey, CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END::BIGINT AS n_regionkey_0, CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END::BIGINT AS n_regionkey_1, CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END::BIGINT AS n_regionkey_2, CASE WHEN n_regionkey = 3 THEN 1 ELSE 0 END::BIGINT AS n_regionkey_3, CASE WHEN n_regionkey = 4 THEN 1 ELSE 0 END::BIGINT AS n_regionkey_4 FROM nation")
def dummy_variables(spark, sf_dir):
    return plain(joins.dummies(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), ["n_regionkey"]))


# graphs: parts and their suppliers as edges; parts are odd nodes, suppliers even ones

_EDGES = "SELECT l_partkey * 2 + 1 AS i, l_suppkey * 2 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
#: A sparse graph that grows with the orders: each is linked to one of the 32 keys around it.
_SPARSE = "SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM (SELECT o_orderkey AS a, o_orderkey // 32 * 32 + (o_orderkey * 31 + o_custkey) % 32 AS b FROM orders) WHERE a <> b"


def trade(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return graphs.define(lines.select((F.col("l_partkey") * 2 + 1).alias("i"), (F.col("l_suppkey") * 2).alias("j"), "l_quantity"), v="l_quantity", rows=lines.count())


def sparse(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("i"), (F.floor(k / 32) * 32 + (k * 31 + F.col("o_custkey")) % 32).alias("j")).where("i <> j")
    return graphs.define(rows, directed=False)


@query(f"SELECT i, j, round(v, 4) AS v FROM ({_EDGES})")
def graph_edges(spark, sf_dir):
    return plain(trade(spark, sf_dir), 4)


@query(f"WITH e AS ({_EDGES}) SELECT node, sum(o)::BIGINT AS out_degree, sum(n)::BIGINT AS in_degree, 0::BIGINT AS isolated FROM (SELECT i AS node, 1 AS o, 0 AS n FROM e UNION ALL SELECT j, 0, 1 FROM e) GROUP BY node")
def node_degrees(spark, sf_dir):
    return plain(graphs.degrees(trade(spark, sf_dir)))


@query(f"WITH e AS ({_EDGES}) SELECT i AS node, string_agg(j::VARCHAR, ',' ORDER BY j) AS links FROM e GROUP BY i")
def link_lists(spark, sf_dir):
    return graphs.link_lists(trade(spark, sf_dir)).select("node", F.array_join(F.transform("links", lambda x: x.cast("string")), ",").alias("links"))


@query(f"WITH e AS ({_EDGES}) SELECT i % 20 AS i, j % 6 AS j, round(sum(v), 2) AS v FROM e GROUP BY 1, 2")
def aggregated_graph(spark, sf_dir):
    e = trade(spark, sf_dir)
    # odd nodes (parts) to 20 groups, even ones (suppliers) to 6
    to = graphs.nodes(e).withColumn("to", F.when(F.col("node") % 2 == 1, F.col("node") % 20).otherwise(F.col("node") % 6))
    return plain(graphs.aggregated(e, to), 2)


@query(f"WITH a AS (SELECT * FROM ({_EDGES}) WHERE v > 30), b AS (SELECT * FROM ({_EDGES}) WHERE v < 60) SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, round(coalesce(a.v, -1), 4) AS v1, round(coalesce(b.v, -1), 4) AS v2 FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j")
def united_graphs(spark, sf_dir):
    e = trade(spark, sf_dir)
    return plain(graphs.union(e.where("v > 30"), e.where("v < 60")), 4)


@query("WITH e AS (SELECT DISTINCT o_custkey AS i, o_orderkey AS j FROM orders) SELECT i, j FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.i = e.j AND x.j = e.i)")
def asymmetric_edges(spark, sf_dir):
    e = graphs.define(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("i"), F.col("o_orderkey").alias("j")))
    return graphs.asymmetric(e).select("i", "j")


@query(f"""
    WITH e AS ({_SPARSE}), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), d AS (SELECT i AS node, count(*) AS d FROM b GROUP BY i), t AS (SELECT x.i AS node, count(*) / 2 AS t FROM b x JOIN b y ON y.i = x.i JOIN b z ON z.i = x.j AND z.j = y.j GROUP BY x.i)
    SELECT d.node, d + 1 AS size, (d + coalesce(t, 0))::BIGINT AS edges, round(2 * (d + coalesce(t, 0)) / ((d + 1) * d), 8) AS density FROM d LEFT JOIN t USING (node)""")
def neighbourhoods(spark, sf_dir):
    return plain(graphs.neighbourhoods(sparse(spark, sf_dir)), 8)


@query(f"""
    WITH RECURSIVE e AS ({_SPARSE}), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), r(node, root) AS (SELECT DISTINCT i, i FROM b UNION SELECT b.j, r.root FROM r JOIN b ON b.i = r.node)
    SELECT node, min(root) AS component FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    return graphs.components(sparse(spark, sf_dir))


_TREE = "SELECT 0 AS i, 100 + r_regionkey AS j, 1.0 + r_regionkey AS v FROM region UNION ALL SELECT 100 + n_regionkey, 1000 + n_nationkey, 2.0 + n_nationkey % 4 FROM nation UNION ALL SELECT 1000 + s_nationkey, 100000 + s_suppkey, 0.5 + s_suppkey % 3 FROM supplier"


def tree(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    row = lambda i, j, v: [i.cast("long").alias("i"), j.cast("long").alias("j"), v.cast("double").alias("v")]
    e = r.select(*row(F.lit(0), 100 + F.col("r_regionkey"), 1.0 + F.col("r_regionkey")))
    e = e.union(n.select(*row(100 + F.col("n_regionkey"), 1000 + F.col("n_nationkey"), 2.0 + F.col("n_nationkey") % 4)))
    return e.union(s.select(*row(1000 + F.col("s_nationkey"), 100000 + F.col("s_suppkey"), 0.5 + F.col("s_suppkey") % 3)))


@query(f"""
    WITH RECURSIVE e AS ({_TREE}), d(node, distance) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT e.j, d.distance + e.v FROM d JOIN e ON e.i = d.node) SELECT 0::BIGINT AS source, node::BIGINT AS node, round(distance, 6)::DOUBLE AS distance FROM d""")
def shortest_paths(spark, sf_dir):
    return plain(graphs.distances(tree(spark, sf_dir), spark.range(1).withColumnRenamed("id", "node")))


@query(f"WITH RECURSIVE e AS ({_TREE}), d(node, parent, level) AS (SELECT 0, NULL::INTEGER, 0 UNION ALL SELECT e.j, e.i::INTEGER, d.level + 1 FROM d JOIN e ON e.i = d.node) SELECT node::BIGINT AS node, parent::BIGINT AS parent, level::BIGINT AS level FROM d")
def tree_levels(spark, sf_dir):
    return plain(graphs.levels(tree(spark, sf_dir), 0))


@query(f"WITH RECURSIVE e AS ({_TREE}), c(i, j, steps) AS (SELECT i, j, 1 FROM e UNION ALL SELECT c.i, e.j, c.steps + 1 FROM c JOIN e ON e.i = c.j) SELECT i::BIGINT AS i, j::BIGINT AS j, steps::BIGINT AS steps FROM c")
def transitive_closure(spark, sf_dir):
    return plain(graphs.closure(tree(spark, sf_dir)))


@query(f"WITH RECURSIVE e AS ({_TREE}), d(node, level) AS (SELECT 0, 0 UNION ALL SELECT e.j, d.level + 1 FROM d JOIN e ON e.i = d.node) SELECT node::BIGINT AS node, level::BIGINT AS level FROM d")
def topological_order(spark, sf_dir):
    return plain(graphs.topological(tree(spark, sf_dir)))


@query(f"WITH RECURSIVE e AS ({_TREE}), p(nodes, last, length, value) AS (SELECT i || '-' || j, j, 1, v::DOUBLE FROM e UNION ALL SELECT p.nodes || '-' || e.j, e.j, p.length + 1, p.value + e.v FROM p JOIN e ON e.i = p.last WHERE p.length < 3) SELECT nodes, length::BIGINT AS length, round(value, 6)::DOUBLE AS value FROM p")
def directed_paths(spark, sf_dir):
    out = graphs.paths(tree(spark, sf_dir), 3)
    return plain(out.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), "-").alias("nodes"), "length", "value"))


@query("WITH e AS (SELECT DISTINCT n_nationkey AS i, (n_nationkey * 3 + k) % 25 AS j FROM nation, (SELECT unnest([1, 7]) AS k)) SELECT count(*) FILTER (a.i < b.i AND a.i < c.i)::BIGINT AS three FROM e a JOIN e b ON b.i = a.j JOIN e c ON c.i = b.j AND c.j = a.i WHERE a.i <> b.i AND b.i <> c.i AND a.i <> c.i")
def directed_cycles(spark, sf_dir):
    e = graphs.define(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("i"), F.explode(F.array(F.lit(1), F.lit(7))).alias("k")).select("i", ((F.col("i") * 3 + F.col("k")) % 25).alias("j")))
    return graphs.paths(e, 3, cycles=True).agg(F.count_if(F.col("length") == 3).alias("three"))


@query()
def spanning_forest(spark, sf_dir):
    e = sparse(spark, sf_dir).withColumn("v", ((F.col("i") * 7 + F.col("j") * 13) % 101).cast("double"))
    return graphs.spanning_tree(e)


@query("SELECT 2::BIGINT * 0 + k AS cycle, 1::BIGINT * (SELECT count(*) FROM customer c2 WHERE c2.c_custkey % 50 = k) AS length FROM (SELECT DISTINCT c_custkey % 50 AS k FROM customer) ORDER BY 1")
def permutation_cycles(spark, sf_dir):
    """Customers in rings by the remainder of their keys: the next one of a ring, and from the last the first. A cycle is named by its smallest element."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    first = c.groupBy((F.col("c_custkey") % 50).alias("r")).agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"))
    ring = c.withColumn("r", F.col("c_custkey") % 50).join(first, "r")
    ring = ring.withColumn("p", F.when(F.col("c_custkey") == F.col("high"), F.col("low")).otherwise(F.col("c_custkey") + 50))
    return graphs.permutation_cycles(ring, "c_custkey", "p").select((F.col("cycle") % 50).alias("cycle"), "length")


@query("WITH e AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey AS i, o_orderkey % 50 AS j FROM orders) SELECT y::BIGINT AS y, degree, count(*) AS nodes FROM (SELECT y, i, count(*) AS degree FROM e GROUP BY ALL) GROUP BY ALL")
def degrees_by_time(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("i"), (F.col("o_orderkey") % 50).alias("j")).distinct()
    return plain(graphs.degree_distribution(e, "y"))


@query("WITH p AS (SELECT DISTINCT n_regionkey::DOUBLE AS a, (n_nationkey % 4)::DOUBLE AS b FROM nation), l AS (SELECT x.a AS xa, x.b AS xb, y.a AS ya, y.b AS yb FROM p x JOIN p y ON x.a <= y.a AND x.b <= y.b AND (x.a, x.b) <> (y.a, y.b)) SELECT xa, xb, ya, yb FROM l WHERE NOT EXISTS (SELECT 1 FROM l u JOIN l w ON u.ya = w.xa AND u.yb = w.xb WHERE u.xa = l.xa AND u.xb = l.xb AND w.ya = l.ya AND w.yb = l.yb)")
def hasse_diagram(spark, sf_dir):
    out = graphs.hasse(table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") % 4).alias("m")), ["n_regionkey", "m"])
    return out.select(F.col("lower")[0].alias("xa"), F.col("lower")[1].alias("xb"), F.col("upper")[0].alias("ya"), F.col("upper")[1].alias("yb"))


@query(f"WITH e AS ({_SPARSE}), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), d AS (SELECT i, count(*) AS d FROM b GROUP BY i) SELECT x.i AS a, y.i AS b, count(*) AS common, round(count(*) / (any_value(p.d) + any_value(q.d) - count(*)), 8) AS share FROM b x JOIN b y ON x.j = y.j AND x.i < y.i JOIN d p ON p.i = x.i JOIN d q ON q.i = y.i GROUP BY ALL")
def common_neighbours(spark, sf_dir):
    return plain(graphs.common_neighbours(sparse(spark, sf_dir)), 8)


@query(f"WITH RECURSIVE e AS ({_TREE}), c(i, j, steps) AS (SELECT i, j, 1 FROM e UNION ALL SELECT c.i, e.j, c.steps + 1 FROM c JOIN e ON e.i = c.j) SELECT i::BIGINT AS i, j::BIGINT AS j, round(0.4::DOUBLE ** steps, 6) AS v FROM c")
def integrated_shares(spark, sf_dir):
    e = tree(spark, sf_dir).withColumn("v", F.lit(0.4))
    return plain(graphs.integrated(e))


# intervals

_INTERVALS = "SELECT o_orderkey, o_custkey % 5 AS g, floor(o_totalprice / 1000) AS lo, floor(o_totalprice / 1000) + o_orderkey % 7 AS hi FROM orders"


def spans(spark, sf_dir):
    lo = F.floor(F.col("o_totalprice") / 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("g"), lo.cast("double").alias("lo"), (lo + F.col("o_orderkey") % 7).cast("double").alias("hi"))


@query(f"SELECT g, count(*) AS n, round(avg(lo), 6) AS mean_lo, round(avg(hi), 6) AS mean_hi FROM ({_INTERVALS}) GROUP BY g")
def interval_means(spark, sf_dir):
    return plain(intervals.mean_bounds(spans(spark, sf_dir), by=["g"]))


@query(f"""
    WITH r AS ({_INTERVALS}), c AS (SELECT lo, hi, count(*) AS w FROM r GROUP BY ALL), x AS (SELECT lo AS x FROM c UNION SELECT hi FROM c), n AS (SELECT count(*) AS n FROM r)
    SELECT x::DOUBLE AS x, round(sum(CASE WHEN hi <= x THEN w ELSE 0 END) / any_value(n), 8) AS lower, round(sum(CASE WHEN lo <= x THEN w ELSE 0 END) / any_value(n), 8) AS upper, round(sum(CASE WHEN hi <= x THEN w WHEN lo <= x THEN w * (x - lo) / (hi - lo) ELSE 0 END) / any_value(n), 8) AS mean FROM x, c, n GROUP BY x""".replace("AS lower", 'AS "lower"').replace("AS upper", 'AS "upper"'))
def interval_distribution(spark, sf_dir):
    return plain(intervals.distribution_bounds(spans(spark, sf_dir)), 8)


@query(f"WITH r AS ({_INTERVALS}), c AS (SELECT lo, hi, count(*) AS w FROM r GROUP BY ALL) SELECT a.lo::DOUBLE AS lo, a.hi::DOUBLE AS hi, round(sum(CASE WHEN b.lo BETWEEN a.lo AND a.hi THEN b.lo * b.w END) / sum(CASE WHEN b.lo BETWEEN a.lo AND a.hi THEN b.w END), 6) AS mean_lo, round(sum(CASE WHEN b.hi BETWEEN a.lo AND a.hi THEN b.hi * b.w END) / sum(CASE WHEN b.hi BETWEEN a.lo AND a.hi THEN b.w END), 6) AS mean_hi FROM c a, c b GROUP BY a.lo, a.hi")
def averaged_ends(spark, sf_dir):
    return plain(intervals.averaged_ends(spans(spark, sf_dir)))


@query()
def self_consistent_distribution(spark, sf_dir):
    s = spans(spark, sf_dir).select((F.col("lo") / 50).cast("long").alias("lo"), (F.col("hi") / 50).cast("long").alias("hi"))
    return plain(intervals.self_consistent(s), 5)


# smoothing


@query("""
    WITH e AS (SELECT event_id, user_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b, lag(value, 2) OVER w AS aa, lead(value, 2) OVER w AS bb FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, round((3 * value + 2 * coalesce(a, 0) + 2 * coalesce(b, 0) + coalesce(aa, 0) + coalesce(bb, 0)) / (3 + CASE WHEN a IS NULL THEN 0 ELSE 2 END + CASE WHEN b IS NULL THEN 0 ELSE 2 END + CASE WHEN aa IS NULL THEN 0 ELSE 1 END + CASE WHEN bb IS NULL THEN 0 ELSE 1 END), 5) AS smooth FROM e""")
def weighted_moving_average(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", "value")
    return plain(smoothing.moving_average(e, "value", [3, 2, 1], "event_id", "smooth", ["user_id"]).select("event_id", "smooth"), 5)


@query("""
    WITH e AS (SELECT event_id, user_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), m AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN value ELSE a + b + value - least(a, b, value) - greatest(a, b, value) END AS s FROM e)
    SELECT event_id, round(CASE WHEN a IS NULL OR b IS NULL THEN s ELSE s / 2 + (lag(s) OVER w + lead(s) OVER w) / 4 END, 5) AS smooth FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def running_medians(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", "user_id", "value")
    return plain(smoothing.resistant(e, "value", "event_id", "smooth", "3H", ["user_id"]).select("event_id", "smooth"), 5)


# spatial objects: a square for each nation, customers as points


def squares(spark, sf_dir):
    k = F.col("n_nationkey")
    x, y, s = (k % 5) * 10.0, F.floor(k / 5) * 10.0, 4.0 + k % 7
    v = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return table(spark, sf_dir, "nation").select(k.alias("id"), F.array(v(x, y), v(x + s, y), v(x + s, y + s), v(x, y + s)).alias("shape"))


def places(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7 % 523 / 10.0).alias("x"), (k * 13 % 509 / 10.0).alias("y"))


@query("SELECT n_nationkey::BIGINT AS id, 4::BIGINT AS vertices, ((4.0 + n_nationkey % 7) ** 2)::DOUBLE AS area, (4 * (4.0 + n_nationkey % 7))::DOUBLE AS perimeter, 0::BIGINT AS clockwise, ((n_nationkey % 5) * 10.0)::DOUBLE AS xmin, ((n_nationkey % 5) * 10.0 + 4 + n_nationkey % 7)::DOUBLE AS xmax, (floor(n_nationkey / 5) * 10.0)::DOUBLE AS ymin, (floor(n_nationkey / 5) * 10.0 + 4 + n_nationkey % 7)::DOUBLE AS ymax FROM nation")
def object_information(spark, sf_dir):
    return plain(spatial.information(squares(spark, sf_dir)))


_INSIDE = "WITH p AS (SELECT c_custkey AS k, c_custkey * 7 % 523 / 10.0 AS x, c_custkey * 13 % 509 / 10.0 AS y FROM customer), q AS (SELECT n_nationkey AS k, (n_nationkey % 5) * 10.0 AS x, floor(n_nationkey / 5) * 10.0 AS y, 4.0 + n_nationkey % 7 AS s FROM nation)"


@query(f"{_INSIDE} SELECT p.k AS point, q.k::BIGINT AS polygon FROM p JOIN q ON p.x BETWEEN q.x AND q.x + q.s AND p.y BETWEEN q.y AND q.y + q.s")
def points_in_polygons(spark, sf_dir):
    return plain(spatial.points_in_polygons(places(spark, sf_dir), squares(spark, sf_dir)))


@query(f"{_INSIDE} SELECT k::BIGINT AS id, round((least(x + s, 33) - greatest(x, 7)) * (least(y + s, 33) - greatest(y, 7)), 6)::DOUBLE AS area FROM q WHERE least(x + s, 33) > greatest(x, 7) AND least(y + s, 33) > greatest(y, 7)")
def clipped_polygons(spark, sf_dir):
    out = spatial.clipped(squares(spark, sf_dir), (7, 7, 33, 33)).select("id", F.abs(spatial.signed_area()).alias("area")).where("area > 0")
    return plain(out)


# matrices: quantities by return flag and line number, as rows i, j, v

_MATRIX = "SELECT l_linenumber::BIGINT AS i, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END::BIGINT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"


def table_matrix(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_linenumber").cast("long").alias("i"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH m AS ({_MATRIX}) SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 0)::DOUBLE AS v FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j")
def cross_product(spark, sf_dir):
    return plain(matrices.cross(table_matrix(spark, sf_dir)), 0)


@query(f"WITH m AS ({_MATRIX}) SELECT max(i) AS rows, max(j) AS columns, round(sum(CASE WHEN i = j THEN v ELSE 0 END), 4) AS trace, round(max(abs(v)), 4) AS largest, round(sum(abs(v)), 4) AS absolute_sum, round(sqrt(sum(v * v)), 4) AS frobenius, round(sum(v), 4) AS sum FROM m".replace("AS rows", 'AS "rows"').replace("AS columns", 'AS "columns"').replace("AS sum", 'AS "sum"'))
def matrix_facts(spark, sf_dir):
    return plain(matrices.facts(table_matrix(spark, sf_dir)), 4)


@query(f"WITH m AS ({_MATRIX}) SELECT i, j, round(v - avg(v) OVER (PARTITION BY i) - avg(v) OVER (PARTITION BY j) + avg(v) OVER (), 4) + 0.0 AS v FROM m")
def double_centred_matrix(spark, sf_dir):
    return plain(matrices.double_centred(table_matrix(spark, sf_dir)), 4)


@query(f"WITH m AS ({_MATRIX}) SELECT i, j, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS v FROM m WINDOW w AS (PARTITION BY j)")
def standardised_matrix(spark, sf_dir):
    return plain(matrices.centred(table_matrix(spark, sf_dir), scale=True))


@query(f"WITH m AS ({_MATRIX}), n AS (SELECT n_nationkey % 2 + 1 AS i, n_regionkey % 2 + 1 AS j, sum(n_nationkey)::DOUBLE AS v FROM nation GROUP BY ALL) SELECT ((m.i - 1) * 2 + n.i)::BIGINT AS i, ((m.j - 1) * 2 + n.j)::BIGINT AS j, round(m.v * n.v, 2) AS v FROM m, n")
def kronecker_product(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 2 + 1).cast("long").alias("i"), (F.col("n_regionkey") % 2 + 1).cast("long").alias("j")).agg(F.sum("n_nationkey").cast("double").alias("v"))
    return plain(matrices.kronecker(table_matrix(spark, sf_dir), n, 2, 2), 2)


@query("WITH v AS (SELECT o_orderkey AS i, o_totalprice AS a, o_custkey % 3 AS w FROM orders) SELECT i, round(coalesce(sum(a * w) OVER x / nullif(sum(w) OVER x, 0), a), 1) AS v FROM v WINDOW x AS (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
def tail_means(spark, sf_dir):
    return plain(matrices.tail_means(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("a"), (F.col("o_custkey") % 3).alias("w"))), 1)


@query(f"WITH m AS ({_MATRIX}), r AS (SELECT i, sum(v) AS r FROM m GROUP BY i), c AS (SELECT j, sum(v) AS c FROM m GROUP BY j) SELECT r.i, c.j, round(r * c / (SELECT sum(v) FROM m), 4) AS v FROM r, c")
def fitted_margins(spark, sf_dir):
    m = table_matrix(spark, sf_dir)
    return plain(matrices.fitted_to_margins(m.withColumn("v", F.lit(1.0)), matrices.row_sums(m), matrices.column_sums(m)), 4)


@query("WITH t AS (SELECT c_custkey % 3 AS g, c_nationkey AS item, max(c_acctbal) AS r FROM customer GROUP BY ALL), p AS (SELECT x.g, x.item AS p, y.item AS q, sign(x.r - y.r) AS s FROM t x JOIN t y ON x.g = y.g AND x.item < y.item) SELECT u.g AS a, w.g AS b, sum(abs(u.s - w.s))::BIGINT AS distance FROM p u JOIN p w ON u.p = w.p AND u.q = w.q AND u.g < w.g GROUP BY ALL")
def rank_order_distances(spark, sf_dir):
    t = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 3).alias("g"), F.col("c_nationkey").alias("item")).agg(F.max("c_acctbal").alias("r"))
    return matrices.rank_distances(t, "g", "item", "r")


# models with a closed form


@query("SELECT 'constant' AS term, round(regr_intercept(l_extendedprice, l_quantity), 2) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2) FROM lineitem")
def linear_regression(spark, sf_dir):
    return plain(regression.least_squares(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"]).table(spark).select("term", "coef"), 2)


@query("WITH g AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS x, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS p FROM lineitem GROUP BY 1), l AS (SELECT x, ln(p / (1 - p)) AS l FROM g) SELECT 'constant' AS term, round((SELECT l FROM l WHERE x = 0), 5) AS coef UNION ALL SELECT 'x', round((SELECT l FROM l WHERE x = 1) - (SELECT l FROM l WHERE x = 0), 5)")
def binary_logit(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("x"))
    return plain(regression.logit(t, "y", ["x"]).table(spark).select("term", "coef"), 5)


@query("WITH g AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS x, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) SELECT '2:constant' AS term, round((SELECT ln(n / a) FROM g WHERE x = 0), 4) AS coef UNION ALL SELECT '2:x', round((SELECT ln(n / a) FROM g WHERE x = 1) - (SELECT ln(n / a) FROM g WHERE x = 0), 4) UNION ALL SELECT '3:constant', round((SELECT ln(r / a) FROM g WHERE x = 0), 4) UNION ALL SELECT '3:x', round((SELECT ln(r / a) FROM g WHERE x = 1) - (SELECT ln(r / a) FROM g WHERE x = 0), 4)")
def multinomial_logit(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("y"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("x"))
    return plain(regression.multinomial(t, "y", ["x"], [1, 2, 3]).table(spark).select("term", "coef"), 4)


@query("WITH g AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS x, avg(l_linenumber) AS m FROM lineitem GROUP BY 1) SELECT 'constant' AS term, round((SELECT ln(m) FROM g WHERE x = 0), 5) AS coef UNION ALL SELECT 'x', round((SELECT ln(m) FROM g WHERE x = 1) - (SELECT ln(m) FROM g WHERE x = 0), 5)")
def poisson_regression(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("y"), F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("x"))
    return plain(regression.glm(t, "y", ["x"], "poisson")[0].table(spark).select("term", "coef"), 5)


@query("WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*)::DOUBLE AS n FROM orders GROUP BY ALL), a AS (SELECT o_orderstatus, sum(n) AS r FROM c GROUP BY ALL), b AS (SELECT o_orderpriority, sum(n) AS s FROM c GROUP BY ALL) SELECT a.o_orderstatus, b.o_orderpriority, coalesce(n, 0) AS n, round(r * s / (SELECT sum(n) FROM c), 4) AS fitted FROM a CROSS JOIN b LEFT JOIN c USING (o_orderstatus, o_orderpriority)")
def loglinear_model(spark, sf_dir):
    return plain(regression.loglinear(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], [["o_orderstatus"], ["o_orderpriority"]]), 4)


@query("""
    WITH g AS (SELECT l_quantity AS x, sum(l_extendedprice) AS s, count(*) AS w FROM lineitem GROUP BY 1), c AS (SELECT *, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM g),
    m AS (SELECT a.x AS low, b.x AS high, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.x <= b.x), f AS (SELECT g.x, low, min(mean) AS least FROM g JOIN m ON low <= g.x AND high >= g.x GROUP BY g.x, low)
    SELECT x, round(max(least), 2) AS fitted FROM f GROUP BY x""")
def monotone_regression(spark, sf_dir):
    return plain(regression.monotone(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 2)


@query()
def median_regression(spark, sf_dir):
    return plain(regression.median_regression(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"]).table(spark).select("term", "coef"), 0)


@query()
def partition_by_means(spark, sf_dir):
    _, rows, _ = clusters.means(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], 4)
    return plain(rows.select("c_custkey", "cluster"))


_NEAR = "SELECT a.s_suppkey AS i, b.s_suppkey AS j, abs(a.s_acctbal - b.s_acctbal) AS v FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey"


def apart(spark, sf_dir, k: int):
    """Distances of suppliers, each pair once, that hold the k nearest of each by balance, ties to the smaller key: of its own balance and of the k next ones
    on either side, the smallest keys. Null balances are the farthest from all."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    first = s.withColumn("_k", F.row_number().over(Window.partitionBy("s_acctbal").orderBy("s_suppkey"))).where((F.col("_k") <= k + 1) & F.col("s_acctbal").isNotNull())
    levels = first.groupBy("s_acctbal").agg(F.sort_array(F.collect_list("s_suppkey")).alias("keys")).withColumn("near", F.struct("s_acctbal", "keys"))
    steps = [n for n in range(-k, k + 1) if n]
    levels = ordered.neighbours(levels, "s_acctbal", {f"near{n}": ("near", n) for n in steps})
    groups = F.array("near", *[F.col(f"near{n}") for n in steps])
    near = levels.select("s_acctbal", F.explode(F.filter(groups, lambda g: g.isNotNull())).alias("g")).select("s_acctbal", F.col("g.s_acctbal").alias("b"), F.explode("g.keys").alias("j"))
    pairs = s.join(near, "s_acctbal").select(F.col("s_suppkey").alias("i"), "j", F.abs(F.col("s_acctbal") - F.col("b")).alias("v"))
    # the first keys of all are near one without balance, the first without balance near all
    null, far = F.col("s_acctbal").isNull(), F.lit(None).cast("double").alias("v")
    lowest = lambda rows: F.broadcast(rows.orderBy("s_suppkey").limit(k + 1).select(F.col("s_suppkey").alias("j")))
    for rows, to in ((s.where(null), s), (s.where(~null), s.where(null))):
        pairs = pairs.unionByName(rows.crossJoin(lowest(to)).select(F.col("s_suppkey").alias("i"), "j", far))
    return pairs.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v").distinct()


@query(f"""
    WITH s AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal) <= 150 THEN 0 ELSE 1 END AS cut FROM supplier), g AS (SELECT *, sum(cut) OVER (ORDER BY s_acctbal) AS part FROM s)
    SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY part) AS component FROM g""")
def single_linkage(spark, sf_dir):
    return clusters.single_linkage(apart(spark, sf_dir, 1), 150.0)


@query(f"WITH e AS ({_NEAR}), b AS (SELECT i, j, v FROM e UNION ALL SELECT j, i, v FROM e) SELECT i, j, round(v, 6) AS v FROM b QUALIFY row_number() OVER (PARTITION BY i ORDER BY v, j) <= 2")
def nearest_rows(spark, sf_dir):
    return plain(clusters.nearest(apart(spark, sf_dir, 2), 2))


@query(f"WITH s AS ({_KINDS}), c AS (SELECT id, t, state, lag(state) OVER (PARTITION BY id ORDER BY t) AS before FROM s) SELECT id, t, before::BIGINT AS org, state::BIGINT AS des FROM c WHERE before >= 0 AND state >= 0 AND before <> state")
def dated_changes(spark, sf_dir):
    return plain(sequences.changes(kinds(spark, sf_dir)))
