"""Centroid clustering of integer vectors with a vantage-point tree over the centroids.

Vectors become integers, and all distances are squared Euclidean ones in 64-bit integers, so every run
gives the same clusters. Each round builds a vantage-point tree over the centroids on the driver (their
number is a bounded parameter), broadcasts it, and lets every vector find its nearest centroid by
best-first branch and bound. A branch is left out only if its lower bound is greater than the best
distance found (inclusive radius, rounded to the safe side), so a centroid at equal distance is always
seen, and the smaller number wins. Sums per cluster are formed in each task before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.staging import staged

# Components of all centroids together: what the driver holds and broadcasts is at most 8 MB.
MOST_COMPONENTS = 1 << 20
# Centroids that are compared one by one at the end of a branch.
LEAF = 3
# Entries of a block's table of open branches.
OPEN_BRANCHES = 1 << 20

_ROUNDING = 1e-12


@dataclass
class Tree:
    """A vantage-point tree: ``members`` of a node are compared when it is opened.

    An inner node has one member, its vantage point. ``branches`` of a node are its children with the
    least and greatest distance of their centroids to that vantage point.
    """

    centroids: np.ndarray
    members: list[list[int]]
    branches: list[list[tuple[int, float, float]]]


@dataclass
class Clustering:
    """``rows``: vec_id, cluster, distance, compared; ``centroids``: one array of integers each."""

    rows: DataFrame
    centroids: list[list[int]]


def squared_distances(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors - centroid
    return np.einsum("ij,ij->i", gap, gap)


def build_tree(centroids: np.ndarray) -> Tree:
    """Halve the centroids by their distance to a vantage point, the least number left, until few remain."""
    tree = Tree(centroids, [], [])

    def grow(numbers: np.ndarray) -> int:
        node = len(tree.members)
        if len(numbers) <= LEAF:
            tree.members.append(numbers.tolist())
            tree.branches.append([])
            return node
        vantage, rest = int(numbers[0]), numbers[1:]
        tree.members.append([vantage])
        tree.branches.append([])
        far = squared_distances(centroids[rest], centroids[vantage])
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        for part in (order[:half], order[half:]):
            spans = np.sqrt(far[part].astype(np.float64))
            child = grow(np.sort(rest[part]))
            tree.branches[node].append((child, float(spans[0]), float(spans[-1])))
        return node

    grow(np.arange(len(centroids)))
    return tree


def nearest(vectors: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, and how many were compared.

    All vectors of a block search side by side: in each step every unfinished vector opens the branch
    with its least lower bound.
    """
    rows, nodes = len(vectors), len(tree.members)
    most = np.iinfo(np.int64).max
    best, number = np.full(rows, most), np.full(rows, most)
    compared = np.zeros(rows, np.int64)
    open_at = np.full((rows, nodes), np.inf)
    open_at[:, 0] = 0.0
    searching = np.arange(rows)
    while len(searching):
        here = open_at[searching]
        pick = here.argmin(axis=1)
        bound = here[np.arange(len(searching)), pick]
        radius = np.sqrt(best[searching].astype(np.float64)) * (1 + _ROUNDING)
        going = (bound <= radius) & (bound < np.inf)
        searching, pick = searching[going], pick[going]
        order = np.argsort(pick, kind="stable")
        edges = np.flatnonzero(np.diff(pick[order], prepend=-1, append=nodes + 1))
        for first, upto in zip(edges[:-1], edges[1:], strict=True):
            node = int(pick[order[first]])
            these = searching[order[first:upto]]
            open_at[these, node] = np.inf
            for member in tree.members[node]:
                distance = squared_distances(vectors[these], tree.centroids[member])
                nearer = (distance < best[these]) | ((distance == best[these]) & (member < number[these]))
                best[these[nearer]], number[these[nearer]] = distance[nearer], member
            compared[these] += len(tree.members[node])
            for child, low, high in tree.branches[node]:
                # An inner node has one member: the distance to its vantage point was just taken.
                reach = np.sqrt(distance.astype(np.float64))
                lower = np.maximum(reach - high, low - reach) - _ROUNDING * (reach + high)
                open_at[these, child] = np.maximum(lower, 0.0)
    return number, best, compared


def cells(vector: Column, scale: float) -> Column:
    """Each component x as the integer floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def finite(vector: Column) -> Column:
    """The vector is there and holds neither nulls nor non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of one width as the rows of a matrix of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _blocks(batch: pa.RecordBatch, dims: int, nodes: int) -> Iterator[tuple[int, np.ndarray]]:
    vectors = matrix(batch.column("cells"), dims)
    largest = max(abs(int(vectors.min(initial=0))), abs(int(vectors.max(initial=0))))
    if dims * (2 * largest) ** 2 >= 1 << 63:
        raise ValueError(f"a component of {largest} is too large for distances in 64 bits")
    step = max(1, OPEN_BRANCHES // nodes)
    for row in range(0, len(vectors), step):
        yield row, vectors[row : row + step]


def _sums(kept: DataFrame, tree: Tree, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and component sums of each non-empty cluster, summed in each task first."""
    shared = kept.sparkSession.sparkContext.broadcast(tree)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        count = len(tree.centroids)
        sums, sizes = np.zeros((count, dims), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for _, vectors in _blocks(batch, dims, len(tree.members)):
                number, _, _ = nearest(vectors, tree)
                order = np.argsort(number, kind="stable")
                filled, starts = np.unique(number[order], return_index=True)
                sums[filled] += np.add.reduceat(vectors[order], starts, axis=0)
                sizes += np.bincount(number, minlength=count)
        filled = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(filled, dims).astype(np.int32)),
                pa.array(np.tile(np.arange(dims, dtype=np.int32), len(filled))),
                pa.array(np.repeat(sizes[filled], dims)),
                pa.array(sums[filled].ravel()),
            ],
            ["cluster", "place", "vectors", "total"],
        )

    parts = kept.select("cells").mapInArrow(add, "cluster int, place int, vectors bigint, total bigint")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    found: dict[int, tuple[int, list[int]]] = {}
    # At most MOST_COMPONENTS rows.
    for row in parts.groupBy("cluster", "place").agg(F.sum("vectors").alias("vectors"), total).collect():
        found.setdefault(row.cluster, (row.vectors, [0] * dims))[1][row.place] = int(row.total)
    return found


def _assigned(kept: DataFrame, tree: Tree, dims: int) -> DataFrame:
    shared = kept.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for row, vectors in _blocks(batch, dims, len(tree.members)):
                number, best, compared = nearest(vectors, tree)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").slice(row, len(vectors)),
                        pa.array(number.astype(np.int32)),
                        pa.array(best),
                        pa.array(compared),
                    ],
                    ["vec_id", "cluster", "distance", "compared"],
                )

    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint, compared bigint"
    return kept.select("vec_id", "cells").mapInArrow(assign, schema)


def cluster(
    vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: str = "1"
) -> Clustering:
    """Cluster ``vec_id, embedding`` rows by ``rounds`` of assignment and exact means.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; all others, null vectors
    and other columns are left out. The first centroids are the ``k`` kept vectors with the least
    SHA-256 of ``seed:vec_id``, in that order (a null id counts as an empty text; rows of one id by their
    components). With fewer kept vectors there are fewer centroids, and an empty table gives no row.
    Repeated rows and ids are vectors of their own. Means are floors of exact quotients; an empty cluster
    keeps its centroid. Components too large for distances in 64 bits are an error.
    """
    if k < 1 or k * dims > MOST_COMPONENTS:
        raise ValueError(f"k * dims must be from 1 to {MOST_COMPONENTS}")
    whole = finite(F.col("embedding")) & (F.size("embedding") == dims)
    kept = staged(vectors.filter(whole).select("vec_id", cells(F.col("embedding"), scale).alias("cells")))
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = kept.orderBy(F.sha2(text, 256), "cells").limit(k).select("cells").collect()
    centroids = [list(row.cells) for row in first]
    if not centroids:
        empty = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        return Clustering(empty.withColumn("compared", F.col("distance")), [])
    for _ in range(rounds):
        sums = _sums(kept, build_tree(np.array(centroids, np.int64)), dims)
        for number, (count, totals) in sums.items():
            centroids[number] = [total // count for total in totals]
    return Clustering(staged(_assigned(kept, build_tree(np.array(centroids, np.int64)), dims)), centroids)


def with_inertia(found: Clustering) -> DataFrame:
    """The rows with their cluster's and the whole inertia and the SHA-256 of their final centroid."""
    spark = found.rows.sparkSession
    exact = F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")
    # One row a cluster.
    of = {row.cluster: int(row.inertia) for row in found.rows.groupBy("cluster").agg(exact).collect()}
    whole = sum(of.values())
    facts = [
        (number, of.get(number, 0), whole, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for number, centroid in enumerate(found.centroids)
    ]
    schema = "number int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    facts = F.broadcast(spark.createDataFrame(facts, schema))
    return found.rows.join(facts, F.col("cluster") == F.col("number")).drop("number")
