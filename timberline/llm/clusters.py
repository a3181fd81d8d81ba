"""Centroid clustering on exact integers, with a matrix of dot products that follows the centroids' changes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import removed, saved

#: Components of a vector, units of 1, centroids, and rounds of the registered query.
DIMS, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5


def _seed(id_col: str) -> Column:
    return F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)


def integers(rows: DataFrame, vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """The rows whose vector has ``dims`` components, none null or not finite, with ``v``: each component x as floor(scale * x)."""
    v = F.col(vec_col)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.filter((F.size(v) == dims) & ~F.exists(v, lambda x: odd(x.cast("double")))).withColumn("v", whole)


def _square(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    edges = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim > 1 else 0)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def updated(dots: np.ndarray, vectors: np.ndarray, old: np.ndarray, new: np.ndarray) -> None:
    """Brings the dot products with centroids ``old`` to those with ``new``, in place: only components that changed are multiplied."""
    for k in np.flatnonzero((old != new).any(1)):
        moved = np.flatnonzero(old[k] != new[k])
        dots[:, k] += vectors[:, moved] @ (new[k] - old[k])[moved]


def _assigned(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """``state`` (id, v, dots) with the dot products of the centroids ``new``, and with cluster and distance: the nearest one, the smaller number where two are equally near."""
    dims = new.shape[1]
    own = (new * new).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _square(batch.column(1), dims)
            dots = _square(batch.column(2), len(old)).copy() if len(old) == len(new) else np.zeros((len(v), len(new)), np.int64)
            updated(dots, v, old if len(old) == len(new) else np.zeros_like(new), new)
            apart = own - 2 * dots
            nearest = apart.argmin(1)
            distance = (v * v).sum(1) + apart[np.arange(len(v)), nearest]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(dots), pa.array(nearest.astype(np.int32)), pa.array(distance)], names=["id", "v", "dots", "cluster", "distance"])

    kind = state.schema["id"].dataType.simpleString()
    return state.select("id", "v", "dots").mapInArrow(run, f"id {kind}, v array<long>, dots array<long>, cluster int, distance long")


def _sums(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and componentwise sums of each cluster, as Python integers: each task sends one row for each cluster that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, v = batch.column(0).to_numpy(), _square(batch.column(1), dims)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            if len(found):
                n = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n), _lists(np.add.reduceat(v[order], first, axis=0))], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = "decimal(38,0)"  # a task's sums are longs, those of all tasks may not be
    totals = parts.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.get("sums", F.lit(j)).cast(wide)) for j in range(dims)]).collect()  # a row for each centroid
    n, sums = np.zeros(k, object), np.zeros((k, dims), object)
    for cluster, members, *total in totals:
        n[cluster], sums[cluster] = members, [int(x) for x in total]
    return n, sums


def _moved(centroids: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Floors of the exact means; a centroid without vectors stays."""
    return np.array([[s // m for s in row] if m else old.tolist() for old, m, row in zip(centroids, n, sums, strict=True)], np.int64).reshape(centroids.shape)


def cluster(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector that :func:`integers` keeps, after ``rounds`` rounds, and the final centroids.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``2:<id>``; fewer where there are fewer. Each round assigns all vectors to
    their nearest centroid and moves each centroid to the floor of its vectors' mean; then vectors are assigned once more.

    A written table holds each vector with its exact dot products with all centroids. A round multiplies only the components of
    centroids that changed, then finds the least |c|^2 - 2 v.c again; |v|^2 is the same for all centroids. Rounds are one narrow pass and
    one sum of a row for each task and centroid: vectors are never shuffled, however many are equal. The centroids (``k`` x ``dims``
    numbers) are all that the driver sees. A round's table replaces the one before it, which is removed.

    Null vectors, and those of another length or with a component that is null or not finite, have no row. Rows that repeat an id are vectors of
    their own; equal hashes stand by their components. A null id counts as the text ``null``. Components so large that a distance may not fit a long are an error. Other columns
    are not read. An empty table gives an empty result.
    """
    kept = integers(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec", dims, scale).select("id", "v")
    state = saved(kept.withColumn("dots", F.array().cast("array<long>")), "vectors")
    top = state.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0
    if 4 * dims * top * top >= 2**63:
        raise ValueError(f"components of up to {top} are too large for distances of 64 bits")
    first = state.select(_seed("id").alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    before = np.zeros((0, dims), np.int64)
    for at in range(rounds + 1):
        if not len(centroids):
            break
        old, state = state, saved(_assigned(state, before, centroids), "assigned")
        removed(old)
        if at < rounds:
            before, centroids = centroids, _moved(centroids, *_sums(state, len(centroids), dims))
    if not len(centroids):
        state = state.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return state.select(F.col("id").alias(id_col), "cluster", "distance"), centroids.tolist()


def op13_incremental_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    hashed = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    inertia = saved(found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")), "inertia")
    total = inertia.agg(F.sum("cluster_inertia")).first()[0] or 0
    of_cluster = spark.createDataFrame(hashed, "cluster int, centroid_sha256 string").join(inertia, "cluster")  # a row for each centroid
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def _round(d: int) -> str:
    prior, now = f"c{d}", f"a{d}"
    step = f"""
{now} AS MATERIALIZED (SELECT vec_id, row_no, v, arg_min(k, (d, k)) AS cluster, min(d) AS distance FROM (
  SELECT vec_id, row_no, v, k, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM vectors, {prior}) GROUP BY ALL)"""
    if d == ROUNDS:
        return step
    return step + f""",
m{d} AS (SELECT cluster, list(mean ORDER BY j) AS c FROM (SELECT cluster, j, floor(sum(x) / count(*)) AS mean FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM {now}) GROUP BY cluster, j) GROUP BY cluster),
c{d + 1} AS MATERIALIZED (SELECT k, coalesce(m{d}.c, {prior}.c) AS c FROM {prior} LEFT JOIN m{d} ON k = cluster),"""


#: Sums and products of the tables' vectors are exact in doubles: they stay below 2^53.
OP13_SQL = rf"""
WITH vectors AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM vectors ORDER BY h, v LIMIT {CENTROIDS})),
{"".join(map(_round, range(ROUNDS + 1)))},
s AS (SELECT k, sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM c{ROUNDS})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN s ON k = cluster
"""
