"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of the 64 bit places gets a nonzero vector of radius + 1 bits. For every nonzero v, a
table masks a fingerprint to the places whose vector has an odd product with v. The vectors
of up to radius differing places span no more than radius dimensions, so some v is
orthogonal to all of them: in that table the pair collides. No pair within the radius is missed.
A radius over 4 is shared out over parts of the fingerprint: a pair within it is within its share in one part at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: A bucket with more fingerprints is parted by a second family of tables, as often as needed.
BUCKET = 16_384
#: Sets of shingles that are compared in one group, about.
SETS = 1000
#: Places of a family are dealt out in this order for the second and later ones.
_SPREAD = (1, 11, 23, 37, 53)


def shingles(text: str, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of shingle words, repeats included; of all words if there are fewer, none if there is none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes, both go by ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(whole, seed)], np.uint64)
    ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts = [0, *(ends + 1).tolist()]
    ends = [*ends.tolist(), len(whole)][shingle - 1 :]
    return np.array([digest(whole[s:e], seed) for s, e in zip(starts, ends)], np.uint64)


def majority(h: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for s in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[s : s + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    return majority(shingles(text, shingle, seed))


def masks(radius: int, family: int = 0) -> list[int]:
    """Masks of 64 bits, signed; every set of up to radius places is outside one of them. Of each part: 2^(its share + 1) - 1."""
    parts = -(-(radius + 1) // 5)
    share = -(-(radius + 1) // parts) - 1
    n, spread, out = (1 << share + 1) - 1, _SPREAD[family % len(_SPREAD)], []
    dealt = range(64) if parts == 1 else [i * spread % 64 for i in range(64)]
    for part in range(parts):
        places = dealt[part * 64 // parts : (part + 1) * 64 // parts]
        vectors = [1 + (spread * (i + family * i * i)) % n for i in range(len(places))]
        for v in range(1, n + 1):
            mask = sum(1 << at for at, m in zip(places, vectors) if (m & v).bit_count() % 2)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The id and the fingerprint (long, as signed) of every row."""
    return _fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle).withColumnRenamed("id", id_col)


def _fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """rows: id, text and others, which are kept; fp takes the place of text."""
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(f)], names=[*names, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", fp long")


def _tree(of: dict[str, np.ndarray], radius: int, second: int = 64, similarity: float = 0.0) -> list[tuple[int, int]]:
    """Edges between ids that connect whatever the near pairs connect; one fewer than nodes at most. of: id, fp and, where they count, fp2 and n."""
    bits = lambda c, i, j: np.bitwise_count((of[c][i] ^ of[c][j]).view(np.uint64))

    def near(i, j):
        ok = bits("fp", i, j) <= radius
        if "n" in of:
            a, b = of["n"][i], of["n"][j]
            ok &= (bits("fp2", i, j) <= second) & (np.minimum(a, b) >= similarity * np.maximum(a, b))
        return ok

    ids, out = of["id"], []
    left = np.arange(len(ids))
    if len(ids) <= 512:  # most have no neighbour
        left = np.flatnonzero(near(left[:, None], left[None, :]).sum(1) > 1)
    while len(left):
        found, left = [left[0]], left[1:]
        while found and len(left):
            k = found.pop()
            hit = near(left, k)
            if hit.any():
                new, left = left[hit], left[~hit]
                found.extend(new)
                out += [(int(ids[k]), int(ids[j])) for j in new]
    return out


def links(fps: DataFrame, radius: int = 4, second: int = 64, similarity: float = 0.0) -> DataFrame:
    """fps: distinct fp. Pairs (a, b) whose connected components are those of all pairs within radius.

    Or fps: id, fp, fp2, n, with ids as a and b: pairs must then also be within second bits of their other fingerprints fp2, and
    the smaller n at least similarity times the larger. Buckets of a table are compared inside a task, and only the edges of a tree
    leave it. Buckets over BUCKET fingerprints are parted by further families of tables, in which no pair is missed either.
    """
    if "id" not in fps.columns:
        fps = fps.select(F.col("fp").alias("id"), "fp")
    names = fps.columns

    def table(df: DataFrame, family: int) -> DataFrame:
        of = F.array(*[F.lit(m).cast("long") for m in masks(radius, family)])
        return df.select("key", *names, F.posexplode(of).alias("_t", "_m")).select(F.xxhash64("key", "_t", F.col("fp").bitwiseAND(F.col("_m"))).alias("key"), *names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, edges = b.column(0).flatten(), []
            ends = np.cumsum([0, *b.column(0).value_lengths().to_pylist()])
            every = {c: rows.field(c).to_numpy() for c in names}
            for s, e in zip(ends, ends[1:]):
                edges += _tree({c: v[s:e] for c, v in every.items()}, radius, second, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    # each fingerprint becomes as many rows as there are tables
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, out = fps.repartition(parts, "id").withColumn("key", F.lit(0).cast("long")), None
    for family in range(len(_SPREAD)):
        rows = table(rows, family)
        large = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key")
        large = keep(large)
        last = family == len(_SPREAD) - 1 or large.isEmpty()
        small = rows if last else rows.join(large, "key", "left_anti")
        buckets = small.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("of")).where(F.size("of") > 1).select("of")
        found = buckets.mapInArrow(compare, "a long, b long")
        out = found if out is None else out.union(found)
        if last:
            break
        rows = keep(rows.join(large, "key"))
    return out.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b); nodes of one connected component have one root.

    In each round every node points to the least neighbour (itself included) in an order drawn
    anew; chains are cut short by pointer jumping and edges carried over to the roots, until none is
    left. Only aggregates and joins are used: no component or neighbourhood is gathered in a task.
    """
    edges = keep(edges.where("a <> b").select("a", "b"))
    maps = []
    for k in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").union(edges.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("h"), F.col(c).alias("v"))
        point = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["v"].alias("to"))
        point = keep(point)
        for _ in range(2):
            point = point.alias("x").join(point.alias("y"), F.col("x.to") == F.col("y.node")).select("x.node", F.col("y.to").alias("to"))
        point = keep(point)
        maps.append(point)
        left = edges.join(point, edges.a == point.node).select(F.col("to").alias("a"), "b")
        left = left.join(point, left.b == point.node).select("a", F.col("to").alias("b"))
        edges = keep(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("to").alias("root"))
    for point in reversed(maps[:-1]):
        on = roots.select(F.col("node").alias("_node"), "root")
        roots = point.join(on, F.col("to") == F.col("_node"), "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row for each row of docs: id, fp (long), component_id: the smallest id among all rows
    whose fingerprints are connected by links of radius differing bits or fewer.

    Null, empty and wordless texts have fingerprint 0, linked like any other. Null ids stay rows; they
    count in no minimum (the id of a component of such rows alone is null). Copies are one fingerprint.
    """
    fps = keep(fingerprints(docs, id_col, text_col, shingle))
    each = keep(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(each.select("fp"), radius))
    each = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    top = keep(each.groupBy("root").agg(F.min("least").alias("component_id")))  # so that a join by a common root can be split
    each = each.join(top, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(each, fps.fp == each._fp).select(id_col, "fp", "component_id")


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _resembling(sets: list[np.ndarray], fps: np.ndarray, radius: int, similarity: float, n: int) -> list[tuple[int, int]]:
    """Edges that connect whatever pairs of at least similarity connect, of the first n with all others, with fingerprints within radius."""
    size, part, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(min(n, len(sets) - 1)):
        least, most = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        near = np.bitwise_count((fps[i + 1 :] ^ fps[i]).view(np.uint64)) <= radius
        for j in i + 1 + np.flatnonzero(near & (part[i + 1 :] != part[i]) & (least >= similarity * most)):
            if part[j] == part[i]:
                continue
            if _alike(sets[i], sets[j], similarity):
                part[part == part[j]] = part[i]
                out.append((i, int(j)))
    return out


def _again(h: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles, for each k > 0; those themselves for 0."""
    for _ in range(k):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(32))
    return h


def _sets(rows: DataFrame, shingle: int, whole: bool, count: int = 1) -> DataFrame:
    """rows: id, text, hash. key names a text's set of shingles, of n; fp0, fp1 ... are count fingerprints of the set. With whole: key and the set."""
    kind, names = rows.schema["id"].dataType.simpleString(), [f"fp{k}" for k in range(count)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t.as_py() or "", shingle)) for t in b.column("text")]
            key = pa.array([np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64) for h in sets], pa.int64())
            if whole:
                yield pa.RecordBatch.from_arrays([key, pa.array([h.tobytes() for h in sets], pa.binary())], names=["key", "set"])
            else:
                fps = [pa.array(np.array([majority(_again(h, k)) for h in sets], np.uint64).view(np.int64)) for k in range(count)]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("hash"), key, *fps, pa.array([len(h) for h in sets], pa.int64())], names=["id", "hash", "key", *names, "n"])

    return rows.mapInArrow(run, "key long, set binary" if whole else f"id {kind}, hash long, key long, {' long, '.join(names)} long, n long")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 11, shingle: int = 5, similarity: float = 0.8, second: int = 20, prints: int = 3) -> DataFrame:
    """One row of docs for each component of near-duplicates: texts whose sets of shingles have a Jaccard similarity of at
    least similarity, exactly, and fingerprints within radius bits under one of several independent hashings (prints, two at least).

    One fingerprint has a pair of similarity 0.8 within 11 bits with a probability of about 0.74, one of three with 0.98; at 0.85
    with 0.88 and 0.998. The fingerprint after the one that is near must be within second bits, as it is for all but some of
    10,000 such pairs: that keeps chance neighbours of a large table out of the candidates.

    The row that stays has the smallest id (nulls last) and, of rows alike in it, the least hash of the text; of rows alike in
    both, one. Ids don't join components: rows that share one, or have none, each stay if their texts aren't linked. Texts
    without words (null or empty too) are alike. Extra columns stay as they are; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    made = keep(_sets(rows, shingle, False, prints))
    each = keep(made.groupBy("key").agg(first_row(), *[F.first(c).alias(c) for c in made.columns if c[:2] == "fp" or c == "n"]))
    # whatever the fingerprints connect is a superset: only there are sets compared. One after the other, so that their shuffles don't add up
    candidates = None
    for k in range(prints):
        near = each.select(F.col("key").alias("id"), F.col(f"fp{k}").alias("fp"), F.col(f"fp{(k + 1) % prints}").alias("fp2"), "n")
        found = keep(links(near, radius, second, similarity))
        candidates = found if candidates is None else candidates.union(found)
    roots = keep(components(candidates.distinct()))
    # only sets with a neighbour; written first, so that a join by a common root can be split
    group = keep(each.join(roots, each.key == roots.node).select("key", "first.hash", F.col("fp0").alias("fp"), "root"))
    wanted = group.select(F.col("hash").alias("_hash")).distinct()
    texts = rows.join(wanted, F.col("hash") == F.col("_hash"), "left_semi").select("id", "text", "hash").dropDuplicates(["hash"])
    sets = keep(_sets(texts, shingle, True))
    roots = components(_similar(group, sets, second, similarity))
    top = each.select("key", "first").join(roots, each.key == roots.node, "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    return chosen(docs, made, keep(top.select("first.*")), id_col, text_col)


def _similar(group: DataFrame, sets: DataFrame, bits: int, similarity: float) -> DataFrame:
    """group: key, hash, fp, root; sets: key, set. Edges (a, b) that connect whatever the pairs of one root connect that have at least
    similarity and first fingerprints within bits.

    A root of over SETS sets is met by one of them first, its pivot: sets similar to it are connected already, and only the
    others are compared with all, in pieces. So a group of copies costs about as many comparisons as it has sets.
    """
    count = group.groupBy("root").agg(F.count("*").alias("n"), F.min("key").alias("pivot"))
    count = keep(count.select(F.col("root").alias("_root"), F.ceil(F.col("n") / SETS).alias("n"), "pivot"))
    small = keep(group.join(count.where("n = 1"), F.col("root") == F.col("_root")).select("key", "fp", F.lit(True).alias("open"), F.xxhash64("root").alias("bucket")))
    large = keep(group.join(count.where("n > 1"), F.col("root") == F.col("_root")).select("key", "fp", "root", "pivot", "n"))
    edges = _compared(small, sets, bits, similarity)
    if large.isEmpty():
        return edges.distinct()
    own = sets.select(F.col("key").alias("pivot"), F.col("set").alias("_other"))
    meet = large.where("key <> pivot").join(sets, "key").join(large.select("pivot").distinct().join(own, "pivot"), "pivot")

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [_alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(b.column("set"), b.column("_other"))]
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("key")], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    star = keep(meet.mapInArrow(against, "a long, b long"))
    # the sets left over, in pieces of their own, each with every piece of the root
    done = star.select(F.col("b").alias("_done"))
    left = keep(large.join(done, F.col("key") == F.col("_done"), "left_anti").where("key <> pivot"))
    many = keep(left.groupBy("root").agg(F.ceil(F.count("*") / SETS).alias("m")).select(F.col("root").alias("_root"), "m"))
    piece = F.pmod(F.xxhash64("key"), F.col("n"))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    asks = left.join(many, F.col("root") == F.col("_root")).withColumn("i", F.pmod(F.xxhash64("key"), F.col("m"))).withColumn("j", every("n"))
    told = large.join(many, F.col("root") == F.col("_root")).withColumn("j", piece).withColumn("i", every("m"))
    row = lambda df, is_open: df.select("key", "fp", F.lit(is_open).alias("open"), F.xxhash64("root", "i", "j").alias("bucket"))
    return edges.union(star).union(_compared(row(asks, True).union(row(told, False)), sets, bits, similarity)).distinct()


def _compared(members: DataFrame, sets: DataFrame, bits: int, similarity: float) -> DataFrame:
    """members: key, fp, open, bucket. In each bucket, open sets are compared with all."""
    groups = members.join(sets, "key").groupBy("bucket").agg(F.collect_list(F.struct("key", "fp", "open", "set")).alias("of")).select("of")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = []
            for group in b.column(0):
                group = sorted(group.as_py(), key=lambda g: not g["open"])
                found = _resembling([np.frombuffer(g["set"], np.uint64) for g in group], np.array([g["fp"] for g in group], np.int64), bits, similarity, sum(g["open"] for g in group))
                edges += [(group[i]["key"], group[j]["key"]) for i, j in found]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return groups.mapInArrow(compare, "a long, b long")


def first_row():
    """Of rows with an id and a hash of the text, which one stays."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")


def chosen(docs: DataFrame, rows: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and hash of the text are in first, one of each; rows: id and hash of every row of docs."""
    first = first.select(F.col("id").alias("_id"), F.col("hash").alias("_first"))
    this = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_first"))
    out = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).join(first, this, "left_semi")
    if not rows.join(first, this, "left_semi").groupBy("id", "hash").count().where("count > 1").isEmpty():
        out = out.groupBy("id", "hash").agg(F.first("_row").alias("_row"))
    return out.select("_row.*")
