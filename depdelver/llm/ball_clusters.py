"""Centroid clustering: exact k-means rounds over partition-local ball trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depdelver.llm.rows import column
from depdelver.session import cut

#: Vectors of one tree, and of a leaf at most.
TREE, LEAF = 4096, 32
#: Components are held within these; under the other bound a squared distance is exact in doubles.
MOST, EXACT = 1 << 53, 1 << 22
LONG = (1 << 63) - 1

TREES = "ids array<long>, kind string, vectors binary, ranges binary, children binary, centers binary, radii binary, sums binary"
_TREES = pa.schema([("ids", pa.list_(pa.int64())), *((c, pa.string() if c == "kind" else pa.binary()) for c in ("kind", "vectors", "ranges", "children", "centers", "radii", "sums"))])


@dataclass
class BallTree:
    """Nested balls over some vectors, which are ordered so that each ball is a range of them.

    Of each ball: range [from, end), children (-1: a leaf), center, radius, and the whole-number
    sum of its vectors; its count is the length of the range.
    """

    vectors: np.ndarray
    ranges: np.ndarray
    children: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    sums: np.ndarray


def build(vectors: np.ndarray) -> tuple[BallTree, np.ndarray]:
    """The tree of ``vectors`` (whole numbers as doubles), and which vector is at each place.

    A ball is divided by two vectors far apart (the farthest from its center, and the farthest from
    that one): each vector goes to the nearer one. Vectors that are all equal are one leaf,
    however many they are.
    """
    order = np.arange(len(vectors))
    ranges, children, centers, radii, sums = [], [], [], [], []

    def add(a: int, b: int) -> int:
        x = vectors[order[a:b]]
        center = x.mean(axis=0)
        ranges.append((a, b))
        children.append((-1, -1))
        centers.append(center)
        radii.append(float(np.sqrt(((x - center) ** 2).sum(axis=1).max())) * (1 + 1e-9))
        sums.append(_sum(x))
        return len(ranges) - 1

    stack = [add(0, len(vectors))]
    while stack:
        node = stack.pop()
        a, b = ranges[node]
        x = vectors[order[a:b]]
        away = lambda y, x=x: ((x - y) ** 2).sum(axis=1)
        one = x[away(centers[node]).argmax()]
        other = x[away(one).argmax()]
        if b - a <= LEAF or (one == other).all():
            continue
        near = away(one) <= away(other)  # true of the one, false of the other
        mid = a + int(near.sum())
        order[a:b] = np.concatenate([order[a:b][near], order[a:b][~near]])
        children[node] = (add(a, mid), add(mid, b))
        stack += children[node]
    return BallTree(vectors[order], np.array(ranges), np.array(children), np.array(centers), np.array(radii), np.array(sums, dtype=object)), order


def _sum(x: np.ndarray) -> list[int]:
    """Exact sums of whole numbers, which may be beyond what doubles hold."""
    if len(x) * np.abs(x).max(initial=0) < 2.0**53:
        return [int(v) for v in x.sum(axis=0)]
    return [sum(map(int, c)) for c in x.T]


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number vectors from one: in doubles where that is exact, else in Python's integers."""
    if max(np.abs(x).max(initial=0), np.abs(centroid).max(initial=0)) < EXACT:
        return ((x - centroid) ** 2).sum(axis=1)
    whole = np.frompyfunc(int, 1, 1)
    return ((whole(x) - whole(centroid)) ** 2).sum(axis=1)


def assign(tree: BallTree, centroids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(ball, vector, centroid): ``ball`` as a whole belongs to the centroid, or (-1) this vector of a leaf.

    A centroid farther from a ball's center than another one by over two radii is nearest to none
    of its vectors; with one left, the ball is assigned. A margin keeps rounding from deciding,
    so that ties stay and go, in the leaves, to the smaller number.
    """
    stack = [(0, np.arange(len(centroids)))]
    while stack:
        node, left = stack.pop()
        d = np.sqrt(((centroids[left] - tree.centers[node]) ** 2).sum(axis=1))
        margin = 1e-9 * (1 + d.max() + float(np.abs(tree.centers[node]).max()))
        left = left[d - tree.radii[node] <= d.min() + tree.radii[node] + margin]
        if len(left) == 1:
            yield node, -1, int(left[0])
        elif tree.children[node][0] >= 0:
            stack += [(int(c), left) for c in tree.children[node]]
        else:
            a, b = tree.ranges[node]
            nearest = left[np.argmin(np.stack([squared(tree.vectors[a:b], centroids[c]) for c in left]), axis=0)]
            for i, c in enumerate(nearest.tolist()):
                yield -1, int(a) + i, c


# -- Trees as rows ------------------------------------------------------------------------------


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _plant(scale: float, size: int):
    """A row for each tree of up to TREE vectors of a task."""

    def row(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        tree, order = build(np.concatenate(parts))
        sums = np.array(["\0".join(map(str, s)) for s in tree.sums.tolist()])
        vectors = _small(tree.vectors)
        cells = [[[ids[i] for i in order.tolist()]], [vectors.dtype.str], *[[x.tobytes()] for x in (vectors, tree.ranges.astype(np.int32), tree.children.astype(np.int32), tree.centers, tree.radii)], ["\n".join(sums.tolist()).encode()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _TREES, strict=True)], schema=_TREES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), TREE):
                piece = batch.slice(at, TREE)
                x = np.asarray(piece.column(1).flatten(), np.float64).reshape(len(piece), size)
                x = np.clip(np.floor(scale * x), -MOST, MOST)
                if n + len(x) > TREE:
                    yield row(ids, parts)
                    ids, parts, n = [], [], 0
                ids += piece.column(0).to_pylist()
                parts.append(x)
                n += len(x)
        if n:
            yield row(ids, parts)

    return run


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, BallTree]]:
    for batch in batches:
        for ids, kind, vectors, ranges, children, centers, radii, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            number = lambda raw, t, *shape: np.frombuffer(raw, t).reshape(*shape)
            whole = [list(map(int, s.split("\0"))) for s in sums.decode().split("\n")]
            yield ids, BallTree(number(vectors, kind, -1, size).astype(np.float64), number(ranges, np.int32, -1, 2), number(children, np.int32, -1, 2), number(centers, np.float64, -1, size), number(radii, np.float64, -1), np.array(whole, dtype=object))


_SUMS = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("total", pa.decimal128(38)), ("n", pa.int64()), ("whole", pa.int64())])


def _sums(centroids: np.ndarray):
    """Of a task: the sum of each component of a cluster's vectors, how many they are, and how many of these came in whole balls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        total, n, whole = np.zeros((k, size), dtype=object), [0] * k, [0] * k
        for _, tree in _trees(batches, size):
            single: dict[int, list[int]] = {}
            for ball, vector, c in assign(tree, centroids):
                if ball < 0:
                    single.setdefault(c, []).append(vector)
                else:
                    a, b = tree.ranges[ball].tolist()
                    total[c] += tree.sums[ball]
                    n[c] += b - a
                    whole[c] += b - a
            for c, at in single.items():
                total[c] += np.array(_sum(tree.vectors[at]), dtype=object)
                n[c] += len(at)
        rows = [(c, i, total[c, i], n[c], whole[c]) for c in range(k) if n[c] for i in range(size)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SUMS, strict=True)], schema=_SUMS)

    return run


_FOUND = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _nearest(centroids: np.ndarray):
    """Every vector's id, cluster and squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, centroids.shape[1]):
            cluster = np.empty(len(ids), np.int32)
            for ball, vector, c in assign(tree, centroids):
                a, b = tree.ranges[ball].tolist() if ball >= 0 else (vector, vector + 1)
                cluster[a:b] = c
            distance = np.empty(len(ids), np.int64)
            for c in np.unique(cluster).tolist():
                at = np.flatnonzero(cluster == c)
                found = squared(tree.vectors[at], centroids[c])
                distance[at] = np.minimum(found, LONG).astype(np.int64) if found.dtype == object else found.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster), pa.array(distance)], schema=_FOUND)

    return run


# -- The operator -------------------------------------------------------------------------------


@dataclass
class Clustering:
    """``rows``: id, cluster, distance (squared), of every vector; ``centroids``: whole numbers, [cluster][component];
    ``sizes``: vectors of each cluster in the last round, ``whole``: those of them that were assigned in whole balls."""

    rows: DataFrame
    centroids: list[list[int]]
    sizes: list[int]
    whole: list[int]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, *, size: int = 64, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding", seed: str = "1:") -> Clustering:
    """``rounds`` rounds of k-means over whole-number vectors, exact in every step, and a last assignment.

    A component x counts as floor(scale * x), as a double, held within 2**53 either way. Vectors
    that are null, have another number of components than ``size``, or hold a null, a NaN or an
    infinity take no part. The first centroids are the ``k`` vectors (all, if fewer; equal vectors
    may be several of them) with the smallest sha256 of ``seed`` and the id; of one id, the
    smaller vector is first; a vector without an id is none of them, but is clustered. Nearest is
    by squared Euclidean distance, ties to the smaller number; a centroid becomes the floor of
    its vectors' mean in each component, and one without vectors stays. Repeated rows all count.
    Without vectors that take part there are no rows and no centroids. Distances are held within
    a long. Other columns are not read.

    Trees are made once, for up to TREE vectors of a task at a time, and written as a table, so
    that a hot vector is in as many trees as there are tasks. A round reads the trees: the triangle
    inequality gives whole balls to one centroid by their counts and sums, and descends to exact
    leaves elsewhere. A task sends one sum a centroid and component, and that many reach the driver.
    """
    v = column(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(column(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") == size) & ~bad)
    floors = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long"))
    first = rows.where(F.col("id").isNotNull()).select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), floors.alias("w")).orderBy("h", "w").limit(k)
    centroids = [list(r["w"]) for r in first.collect()]  # k rows
    if not centroids:
        return Clustering(rows.sparkSession.createDataFrame([], "id long, cluster int, distance long"), [], [], [])
    trees = cut(rows.mapInArrow(_plant(scale, size), TREES))
    sizes, whole = [0] * len(centroids), [0] * len(centroids)
    for _ in range(rounds):
        found = trees.mapInArrow(_sums(np.array(centroids, np.float64)), "cluster int, component int, total decimal(38,0), n long, whole long")
        sums = found.groupBy("cluster", "component").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"), F.sum("whole").alias("whole"))
        sizes, whole = [0] * len(centroids), [0] * len(centroids)
        for r in sums.collect():  # a row a centroid and component
            centroids[r["cluster"]][r["component"]] = int(r["total"]) // r["n"]
            sizes[r["cluster"]], whole[r["cluster"]] = r["n"], r["whole"]
    return Clustering(trees.mapInArrow(_nearest(np.array(centroids, np.float64)), "id long, cluster int, distance long"), centroids, sizes, whole)


def op11_ball_clusters(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = cut(found.rows)
    held = lambda x: F.least(x, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    totals = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    per = F.array(*[F.struct(F.lit(int(totals.get(i, 0))).cast("decimal(38,0)").alias("d"), F.lit(x).alias("sha")) for i, x in enumerate(digests)]) if digests else None
    if per is None:
        return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    own = F.element_at(per, F.col("cluster") + 1)
    every = F.lit(int(sum(totals.values()))).cast("decimal(38,0)")
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", held(own["d"]).alias("cluster_inertia"), held(every).alias("inertia"), own["sha"].alias("centroid_sha256"))


def _sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    near = "SELECT v.vec_id, v.rn, v.e, c.cluster, list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.c) + list_inner_product(c.c, c.c) AS d FROM v, {c} c"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {size} AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS INTEGER) AS cluster, e AS c FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, rn, any_value(e) AS e, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM ({near.format(c=f'c{i}')}) GROUP BY vec_id, rn)")
        if i < rounds:
            floors = "CAST((s - ((s % n) + n) % n) // n AS DOUBLE)"
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
    SELECT cluster, list({floors} ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range({size})) AS i FROM a{i}) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m ON m.cluster = c.cluster
)""")
    return f"""
WITH {", ".join(parts)}
SELECT a.vec_id, a.cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster
"""


SQL = _sql()
