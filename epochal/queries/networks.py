"""Queries of blocks, cut nodes, cycles and faces of graphs of conversations, of long series and of tall matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, correspondence, delaunay, graphs, matrices, orthants, planar, smoothing, tall
from ..plans.ordered import positions
from ..plans.iterate import settled
from .registry import plain, query, table

# Conversations are linked to others of their 32 by the numbers of their turns: parts of up to 32 nodes, trees and cycles mixed.
_TALKS = """
    SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM (
      SELECT conv_id AS a, unnest([conv_id // 32 * 32 + (conv_id * 31 + 7 * n) % 32, CASE WHEN n % 2 = 0 THEN conv_id // 32 * 32 + (conv_id * 13 + 5 * u) % 32 ELSE conv_id END]) AS b
      FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u FROM conversations WHERE conv_id >= 0 GROUP BY conv_id)) WHERE a <> b"""
#: What is reached from s, a neighbour of v, once v is gone.
_WITHOUT = f"e AS ({_TALKS}), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), r(v, s, node) AS (SELECT i, j, j FROM b UNION SELECT r.v, r.s, b.j FROM r JOIN b ON b.i = r.node AND b.j <> r.v)"


def talks(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").where("conv_id >= 0").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"))
    c, low = F.col("conv_id"), F.floor(F.col("conv_id") / 32) * 32
    to = F.array(low + (c * 31 + 7 * F.col("n")) % 32, F.when(F.col("n") % 2 == 0, low + (c * 13 + 5 * F.col("u")) % 32).otherwise(c))
    return graphs.define(n.select(c.alias("i"), F.explode(to).alias("j")).where("i <> j"), directed=False)


@query(f"""
    WITH RECURSIVE {_WITHOUT}, edge(i, j) AS (SELECT i, j FROM e),
    same AS (SELECT DISTINCT {{'i': least(v, s), 'j': greatest(v, s)}} AS a, {{'i': least(v, node), 'j': greatest(v, node)}} AS b FROM r WHERE EXISTS (SELECT 1 FROM b WHERE b.i = r.v AND b.j = r.node)),
    l(a, b) AS (SELECT {{'i': i, 'j': j}}, {{'i': i, 'j': j}} FROM e UNION SELECT l.a, same.b FROM l JOIN same ON same.a = l.b)
    SELECT a.i AS i, a.j AS j, min(b).i AS block_i, min(b).j AS block_j FROM l GROUP BY a""")
def graph_blocks(spark, sf_dir):
    return blocks.blocks(talks(spark, sf_dir))


# Conversations in one chain by their order; for each thousand of them a hub linked to those of an even number of turns; and a node of its own for each with 3, 6, ... turns.
_CHAIN = "p AS (SELECT row_number() OVER (ORDER BY conv_id) AS p, n FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id))"


@query(f"""
    WITH {_CHAIN}, h AS (SELECT p // 1000 AS hub, min(p) AS first, max(p) AS last FROM p WHERE n % 2 = 0 GROUP BY 1),
    x AS (SELECT p AS node, (n % 3 = 0)::INT + CASE WHEN coalesce(first < p AND p < last, false) THEN 1 ELSE (p > 1)::INT + (p < (SELECT count(*) FROM p))::INT + coalesce(first = p AND last = p, false)::INT END AS blocks FROM p LEFT JOIN h ON hub = p // 1000)
    SELECT node, blocks::BIGINT AS blocks FROM x WHERE blocks > 1""")
def cut_nodes(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n"))
    p = settled(positions(n, "conv_id", "p"))
    link = p.join(p.select((F.col("p") - 1).alias("p")), "p").select(F.col("p").alias("i"), (F.col("p") + 1).alias("j"))
    hubs = p.where("n % 2 = 0").select((-1 - F.floor(F.col("p") / 1000)).alias("i"), F.col("p").alias("j"))
    own = p.where("n % 3 = 0").select((-1_000_000_000 - F.col("p")).alias("i"), F.col("p").alias("j"))
    return blocks.cut_nodes(blocks.blocks(link.unionByName(hubs).unionByName(own)))


@query(f"WITH RECURSIVE {_WITHOUT} SELECT i, j FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.v = e.i AND r.node = e.j AND r.s <> e.j)")
def graph_bridges(spark, sf_dir):
    return blocks.bridges(blocks.blocks(talks(spark, sf_dir)))


@query(f"""
    WITH RECURSIVE e AS ({_TALKS}), b AS (SELECT i, j FROM e UNION SELECT j, i FROM e), r(node, root) AS (SELECT DISTINCT i, i FROM b UNION SELECT b.j, r.root FROM r JOIN b ON b.i = r.node),
    c AS (SELECT node, min(root) AS component FROM r GROUP BY node), m AS (SELECT component, count(*) AS m FROM e JOIN c ON node = i GROUP BY component)
    SELECT component, m - count(*) + 1 AS cycles, m - count(*) + 1 AS closed FROM c JOIN m USING (component) GROUP BY component, m HAVING m >= count(*)""")
def fundamental_cycles(spark, sf_dir):
    """Of each component with cycles: how many a fundamental set has, and how many of them are closed walks along edges without a repeated node."""
    e = settled(talks(spark, sf_dir).select("i", "j"))
    at = settled(blocks.cycles(e))
    length = at.groupBy("i", "j").agg(F.count("*").alias("n"), F.count_distinct("node").alias("nodes"))
    step = at.join(length, ["i", "j"]).select("i", "j", "n", "nodes", ((F.col("place") + 1) % F.col("n")).alias("place"), F.col("node").alias("a"))
    step = step.join(at, ["i", "j", "place"]).select("i", "j", "n", "nodes", F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    ok = step.join(e.select(F.col("i").alias("a"), F.col("j").alias("b")), ["a", "b"]).groupBy("i", "j", "n", "nodes").agg(F.count("*").alias("along"))
    closed = F.count_if((F.col("along") == F.col("n")) & (F.col("nodes") == F.col("n")) & (F.col("n") > 2))
    of = graphs.components(e).select(F.col("node").alias("i"), "component")
    return plain(ok.join(of, "i").groupBy("component").agg(F.count("*").alias("cycles"), closed.alias("closed")))


@query("""
    WITH n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id >= 0 GROUP BY conv_id), v AS (SELECT DISTINCT conv_id // 16 AS b, 1 + conv_id % 16 * 6 + n % 20 * 0.25::DOUBLE AS x FROM n),
    f AS (SELECT b, x, lead(x) OVER (PARTITION BY b ORDER BY x) AS y FROM v)
    SELECT round(x, 4) AS x_min, (b * 10)::DOUBLE AS y_min, round(y, 4) AS x_max, (b * 10 + 5)::DOUBLE AS y_max, round(5 * (y - x), 4) AS area, 4::BIGINT AS nodes FROM f WHERE y IS NOT NULL""")
def enclosed_polygons(spark, sf_dir):
    """For sixteen conversations two long lines, and for each a line across both, placed by its number of turns; no line ends where another one does."""
    n = table(spark, sf_dir, "conversations").where("conv_id >= 0").groupBy("conv_id").agg(F.count("*").alias("n"))
    x, y = 1 + F.col("conv_id") % 16 * 6 + F.col("n") % 20 * 0.25, F.floor(F.col("conv_id") / 16) * 10
    line = lambda *c: F.struct(*[v.cast("double").alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), c)])
    lines = F.array(line(x, y - 1, x, y + 6), line(F.lit(0), y, F.lit(100), y), line(F.lit(0), y + 5, F.lit(100), y + 5))
    found = planar.areas(planar.polygons(n.select(F.explode(lines).alias("s")).select("s.*")))
    return plain(found.select("x_min", "y_min", "x_max", "y_max", "area", "nodes"), 4)


# Conversations of the same eight are linked unless their product, with the number of turns of the smaller one, is a multiple of three.
_EIGHTS = """
    SELECT a.conv_id AS i, b.conv_id AS j FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id >= 0 GROUP BY conv_id) a
    JOIN (SELECT DISTINCT conv_id FROM conversations) b ON b.conv_id > a.conv_id AND b.conv_id // 8 = a.conv_id // 8 WHERE (a.conv_id * b.conv_id + a.n) % 3 <> 0"""


@query(f"""
    WITH RECURSIVE e AS ({_EIGHTS}), l AS (SELECT node, list(other) AS near FROM (SELECT i AS node, j AS other FROM e UNION ALL SELECT j, i FROM e) GROUP BY node),
    c(k) AS (SELECT [i, j] FROM e UNION ALL SELECT list_append(c.k, m.node) FROM c JOIN e ON e.i = c.k[-1] JOIN l m ON m.node = e.j WHERE len(list_intersect(c.k, m.near)) = len(c.k))
    SELECT array_to_string(k, '-') AS clique, len(k)::BIGINT AS size FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE len(list_intersect(c.k, l.near)) = len(c.k))""")
def maximal_cliques(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").where("conv_id >= 0").groupBy("conv_id").agg(F.count("*").alias("n"))
    n = settled(n)
    eight = F.floor(F.col("conv_id") / 8) * 8
    near = n.select("conv_id", "n", F.explode(F.sequence(eight, eight + 7)).alias("j")).where("j > conv_id").join(n.select(F.col("conv_id").alias("j")), "j")
    e = near.where((F.col("conv_id") * F.col("j") + F.col("n")) % 3 != 0).select(F.col("conv_id").alias("i"), "j")
    return plain(blocks.cliques(e).select(F.array_join(F.col("clique").cast("array<string>"), "-").alias("clique"), "size"))


_SERIES = "SELECT lang, doc_id::DOUBLE AS x, ln(n_chars + 1) AS y FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL"
_LOCAL = """
    f{n} AS (SELECT id, CASE WHEN h > 0 AND w2 - w1 * w1 / w0 > 1e-12 THEN v0 / w0 - (v1 - w1 * v0 / w0) / (w2 - w1 * w1 / w0) * w1 / w0 ELSE v0 / w0 END AS fit FROM (
      SELECT a.id, any_value(h) AS h, sum(w) AS w0, sum(w * d) AS w1, sum(w * d * d) AS w2, sum(w * y) AS v0, sum(w * d * y) AS v1
      FROM (SELECT a.id, h, b.y, b.x - a.x AS d, t.t * CASE WHEN h > 0 THEN greatest(1 - pow(abs(b.x - a.x) / h, 3), 0) ^ 3 ELSE (b.x = a.x)::INT END AS w FROM h a JOIN s b ON b.lang IS NOT DISTINCT FROM a.lang JOIN {trust} t ON t.id = b.id) a GROUP BY a.id))"""


@query(f"""
    WITH s AS (SELECT row_number() OVER () AS id, * FROM ({_SERIES})), k AS (SELECT lang, greatest(2, least(count(*), ceil(0.3::DOUBLE * count(*)))) AS k FROM s GROUP BY lang),
    h AS (SELECT a.id, a.lang, a.x, list_sort(list(abs(b.x - a.x)))[any_value(k.k)::BIGINT] AS h FROM s a JOIN s b ON b.lang IS NOT DISTINCT FROM a.lang JOIN k ON k.lang IS NOT DISTINCT FROM a.lang GROUP BY a.id, a.lang, a.x),
    t0 AS (SELECT id, 1.0::DOUBLE AS t FROM s), {_LOCAL.format(n=0, trust="t0")},
    m AS (SELECT lang, 6 * median(abs(y - fit)) AS m FROM s JOIN f0 USING (id) GROUP BY lang), t1 AS (SELECT id, greatest(1 - pow((y - fit) / m, 2), 0) ^ 2 AS t FROM s JOIN f0 USING (id) JOIN m ON m.lang IS NOT DISTINCT FROM s.lang), {_LOCAL.format(n=1, trust="t1")}
    SELECT lang, round(x, 4) AS doc, round(fit, 5) AS smooth FROM s JOIN f1 USING (id)""")
def local_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("double").alias("doc"), F.log(F.col("n_chars") + 1.0).alias("y"))
    return plain(smoothing.lowess(d, "doc", "y", ["lang"], 0.3, 1).select("lang", "doc", "smooth"), 5)


_VECTORS = "SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(*[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("abc")])


@query(f"WITH g AS (SELECT sum(a * a) AS p, sum(b * b) AS q, sum(a * b) AS r FROM ({_VECTORS}) WHERE a IS NOT NULL AND b IS NOT NULL) SELECT k, round(sqrt((p + q + CASE k WHEN 1 THEN 1 ELSE -1 END * sqrt((p - q) ^ 2 + 4 * r * r)) / 2), 6) AS value FROM g, (VALUES (1::BIGINT), (2::BIGINT)) v(k)")
def singular_values(spark, sf_dir):
    s, _ = tall.singular_values(vectors(spark, sf_dir), ["a", "b"])
    return plain(spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(s)], "k long, value double"))


@query(f"""
    WITH v AS (SELECT * FROM ({_VECTORS}) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL), g AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc FROM v)
    SELECT round((bb * ac - ab * bc) / (aa * bb - ab * ab), 6) AS slope_a, round((aa * bc - ab * ac) / (aa * bb - ab * ab), 6) AS slope_b FROM g""")
def stable_least_squares(spark, sf_dir):
    """c from a and a + b / 10^7, which are nearly the same; the slopes of a and b that follow."""
    fit = tall.least_squares(vectors(spark, sf_dir).withColumn("near", F.col("a") + F.col("b") * 1e-7), "c", ["a", "near"])
    return plain(spark.createDataFrame([(float(fit.coef[1] + fit.coef[2]), float(fit.coef[2] * 1e-7))], "slope_a double, slope_b double"))


@query()
def joint_outcomes(spark, sf_dir):
    """Quality and toxicity of labelled documents by their length, with errors that are correlated."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.round(F.log(F.col("n_chars") + 1.0)).alias("length")), "doc_id")
    fit = orthants.simultaneous_probit(d.select("quality", "toxic", (F.col("length") / 10).alias("length")), [("quality", ["length"]), ("toxic", ["length"])])
    return plain(fit.table(spark), 4)


@query("""
    WITH t AS (SELECT doc_id // 50 AS i, source AS j, count(*)::DOUBLE AS n FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL GROUP BY ALL), s AS (SELECT sum(n) AS s FROM t), r AS (SELECT i, sum(n) AS r FROM t GROUP BY i), c AS (SELECT j, sum(n) / any_value(s) AS c FROM t, s GROUP BY j)
    SELECT r.i::BIGINT AS i, round(any_value(r / s), 8) AS mass, round(sum((coalesce(n, 0) / r - c) ** 2 / c), 6) AS distance FROM r CROSS JOIN c CROSS JOIN s LEFT JOIN t ON t.i = r.i AND t.j = c.j GROUP BY r.i""")
def profile_distances(spark, sf_dir):
    """Fifties of documents by their sources: the squared distance of each from the whole, which all dimensions' coordinates make up."""
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("i"), F.col("source").alias("j"), F.lit(1).alias("n"))
    _, _, rows, _ = correspondence.correspondence(d, 19)
    square = sum((F.col(f"d{k}") * F.col(f"d{k}") for k in range(1, 20)), F.lit(0.0))
    return plain(rows.select("i", F.round("mass", 8).alias("mass"), F.round(square, 6).alias("distance")), 8)


@query("SELECT o_orderkey AS i, round(coalesce(sum(o_totalprice * (o_custkey % 3)) OVER x / nullif(sum(o_custkey % 3) OVER x, 0), o_totalprice), 1) AS v FROM orders WINDOW x AS (ORDER BY o_custkey RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
def means_above(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("a"), (F.col("o_custkey") % 3).alias("w"), F.col("o_custkey").alias("t"))
    return plain(matrices.means_above(o), 1)


def _in_circle(p):
    """Positive where p is in the circle of a, b, c."""
    q = {k: [f"({k}.{c} - {p}.{c})" for c in "xy"] for k in "abc"}
    square = {k: f"({x} * {x} + {y} * {y})" for k, (x, y) in q.items()}
    cross = lambda u, v: f"({q[u][0]} * {q[v][1]} - {q[u][1]} * {q[v][0]})"
    return f"{square['a']} * {cross('b', 'c')} + {square['b']} * {cross('c', 'a')} + {square['c']} * {cross('a', 'b')}"


@query(f"""
    WITH p AS (SELECT DISTINCT (conv_id * 7919 % 10007)::DOUBLE AS x, ((conv_id * 104729 + n * 31) % 9973)::DOUBLE AS y FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id >= 0 GROUP BY conv_id))
    SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, c.x AS cx, c.y AS cy
    FROM p a JOIN p b ON (a.x, a.y) < (b.x, b.y) JOIN p c ON (a.x, a.y) < (c.x, c.y) AND (b.x - a.x) * (c.y - a.y) > (b.y - a.y) * (c.x - a.x)
    WHERE NOT EXISTS (SELECT 1 FROM p d WHERE {_in_circle("d")} > 0)""")
def delaunay_triangles(spark, sf_dir):
    """Conversations as points spread over a square."""
    n = table(spark, sf_dir, "conversations").where("conv_id >= 0").groupBy("conv_id").agg(F.count("*").alias("n"))
    at = n.select((F.col("conv_id") * 7919 % 10007).alias("x"), ((F.col("conv_id") * 104729 + F.col("n") * 31) % 9973).alias("y"))
    return plain(delaunay.triangles(at))
