"""Nearest neighbours by inner product through stable projections and kd-trees.

Vectors are brought to equal length by one more coordinate and projected to a few dimensions. A
kd-tree over the projections deals all vectors into blocks; in each block a finer tree gives the
projected neighbours in order, which are verified on the whole vectors until a chi-square test
says that nothing nearer is likely to follow. A query first searches its own block; the distance of
its k-th find then tells how far other blocks may lie, and it visits those that are near enough.

Equal vectors are searched as one and counted apart: of their ids only as many as an answer can
hold are carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedsift.llm import kdtree
from seedsift.llm.common import hash_sample, lookup, map_batches, settle, ship

NEIGHBOURS = 20
BLOCK_ROWS = 16_384  # distinct vectors of a block
MAX_BLOCKS = 4096  # their bounds are the only index data that is sent everywhere
SAMPLE_ROWS = 50_000  # fits the splits; every row is indexed
QUERIES = 8192  # queries that one task takes through a block
SEED = 13


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: no NULL, no component that is NULL or not finite, not
    all zeros, and as many components as most rows have."""
    given = rows.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    ).filter("id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    whole = given.filter(finite & F.exists("vec", lambda x: x != 0))
    sizes = whole.groupBy(F.size("vec").alias("d")).count()
    most = sizes.orderBy(F.desc("count"), "d").first()
    return whole.filter(F.size("vec") == (most["d"] if most else 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, dims)


def nearest_neighbours(
    rows: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    confidence: float = kdtree.CONFIDENCE,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, id, score): for every row of ``queries``, which are rows of ``rows``, the
    ``k`` nearest found among all other rows, by largest inner product in double precision; ties go
    to the smaller id. Fewer than ``k`` come only where there are fewer rows.

    Vectors that are NULL, zero, not finite or of another length than most take no part; such
    queries get no rows. A query's own row is left out once, its equals and repeated rows stay.
    Other columns are not looked at. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    vectors = usable_vectors(rows, id_col, vector_col)
    # Distinct vectors; of the ids no more than an answer can hold.
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    members = vectors.withColumn("place", place).filter(F.col("place") <= k + 1)
    distinct = members.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = settle(distinct.withColumn("key", F.monotonically_increasing_id()), "ann-vectors")
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, dims, largest = distinct.agg(
        F.count(F.lit(1)), F.max(F.size("vec")), F.max(squares)
    ).first()
    dims, largest = dims or 1, largest or 1.0

    # Queries by distinct vector.
    asked = usable_vectors(queries, id_col, vector_col)
    asked_counts = settle(asked.groupBy("vec").agg(F.count(F.lit(1)).alias("n")), "ann-asked")
    asked_counts = settle(
        asked_counts.join(distinct.select("vec", "key"), "vec").select("vec", "key", "n"),
        "ann-asked-keys",
    )
    asked_total = asked_counts.agg(F.sum("n")).first()[0] or 0

    # Splits from a bounded sample, blocks for every vector.
    blocks = 1 << max(0, math.ceil(math.log2(max(n, 1) / block_rows)))
    blocks = min(blocks, MAX_BLOCKS)
    matrix = kdtree.projection(dims + 1, seed)
    sample = hash_sample(distinct.select("key", "vec"), "key", SAMPLE_ROWS, seed)
    fitted = kdtree.raised(_matrix(sample["vec"], dims), largest) @ matrix
    splits = kdtree.Splits.of(fitted, blocks)

    def dealt(batches):
        for batch in batches:
            points = kdtree.raised(_matrix(batch.column("vec"), dims), largest) @ matrix
            block = kdtree.assign(splits, points)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(block, pa.int64())], ["key", "vec", "first", "block"]
            )

    # The smallest id of each vector decides between equal scores.
    indexed = settle(
        map_batches(
            distinct.select("key", "vec", F.get("ids", F.lit(0)).alias("first")),
            dealt,
            "key bigint, vec array<double>, first bigint, block bigint",
        ),
        "ann-blocks",
    )
    own = map_batches(
        asked_counts.select("key", "vec"),
        lambda batches: (
            pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(kdtree.assign(splits, _flat(batch, dims, matrix)), pa.int64()),
                    pa.nulls(batch.num_rows, pa.float64()),
                ],
                ["key", "vec", "block", "bound"],
            )
            for batch in batches
        ),
        "key bigint, vec array<double>, block bigint, bound double",
    )
    quantile = kdtree.chi_square_quantile(confidence)
    first = settle(_searched(indexed, own, k, dims, matrix, largest, quantile), "ann-first")

    # How far each block lies from a query, at most MAX_BLOCKS boxes.
    corners = _corners(indexed, blocks, dims, matrix, largest)

    def visits(batches):
        low, high = corners
        for batch in batches:
            points = _flat(batch, dims, matrix)
            vecs = _matrix(batch.column("vec"), dims)
            home = kdtree.assign(splits, points)
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            at, to = [], []
            for i, point in enumerate(points):
                far = kdtree.box_distance(low, high, point)
                reach = (vecs[i] ** 2).sum() + largest - 2 * bound[i]
                near = np.flatnonzero(far < quantile * max(reach, 0))
                near = near[near != home[i]]
                at += [i] * len(near)
                to += near.tolist()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(take),
                    batch.column("vec").take(take),
                    pa.array(to, pa.int64()),
                    batch.column("bound").take(take),
                ],
                ["key", "vec", "block", "bound"],
            )

    # The k-th score found so far; without k + 1 finds every block may hold an answer.
    kth = first.groupBy("query").agg(
        F.count(F.lit(1)).alias("found"), F.min("score").alias("bound")
    )
    bounded = (
        asked_counts.select("key", "vec")
        .join(kth.withColumnRenamed("query", "key"), "key", "left")
        .select(
            "key",
            "vec",
            F.when(F.col("found") > k, F.col("bound"))
            .otherwise(F.lit(float("-inf")))
            .alias("bound"),
        )
    )
    others = map_batches(
        bounded, visits, "key bigint, vec array<double>, block bigint, bound double"
    )
    second = _searched(indexed, others, k, dims, matrix, largest, quantile)

    # The best k + 1 distinct vectors of each query, then the best k + 1 rows.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "first", "key")
    found = (
        first.union(second)
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k + 1)
        .join(distinct.select("key", "ids"), "key")
        .select("query", "score", F.explode("ids").alias("id"))
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    answers = (
        found.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("a"))
    )
    answers = settle(
        answers.join(asked_counts.select(F.col("key").alias("query"), "vec", "n"), "query").select(
            "vec", "n", "a"
        ),
        "ann-answers",
    )
    asked = settle(asked, "ann-queries")
    own_place = F.array_position(F.transform("a", lambda x: x["id"]), F.col("id"))
    return (
        lookup(asked, answers, ["vec"], "n", asked_total)
        .withColumn("own", own_place)
        .select(
            F.col("id").alias("query_id"),
            F.posexplode(
                F.slice(F.filter("a", lambda x: x["place"] != F.col("own")), 1, k)
            ).alias("at", "x"),
        )
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("x.id").alias(id_col),
            F.col("x.score").alias("score"),
        )
    )


def _flat(batch: pa.RecordBatch, dims: int, matrix: np.ndarray) -> np.ndarray:
    """Projected queries: their extra coordinate is 0."""
    return _matrix(batch.column("vec"), dims) @ matrix[:dims]


def _corners(indexed: DataFrame, blocks: int, dims: int, matrix: np.ndarray, largest: float):
    """The box of each block, from all its rows."""

    def run(batches):
        low = np.full((blocks, kdtree.PROJECTED), np.inf)
        high = np.full((blocks, kdtree.PROJECTED), -np.inf)
        for batch in batches:
            points = kdtree.raised(_matrix(batch.column("vec"), dims), largest) @ matrix
            block = batch.column("block").to_numpy()
            np.minimum.at(low, block, points)
            np.maximum.at(high, block, points)
        at = np.repeat(np.arange(blocks), kdtree.PROJECTED)
        axis = np.tile(np.arange(kdtree.PROJECTED), blocks)
        real = np.isfinite(low.ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c[real]) for c in (at, axis, low.ravel(), high.ravel())],
            ["block", "axis", "low", "high"],
        )

    sides = map_batches(
        indexed.select("vec", "block"), run, "block bigint, axis bigint, low double, high double"
    )
    found = sides.groupBy("block", "axis").agg(F.min("low").alias("l"), F.max("high").alias("h"))
    low = np.full((blocks, kdtree.PROJECTED), np.inf)
    high = np.full((blocks, kdtree.PROJECTED), -np.inf)
    for row in found.collect():
        low[row["block"], row["axis"]], high[row["block"], row["axis"]] = row["l"], row["h"]
    return low, high


def _searched(
    indexed: DataFrame,
    queries: DataFrame,
    k: int,
    dims: int,
    matrix: np.ndarray,
    largest: float,
    quantile: float,
) -> DataFrame:
    """(query, key, score, first): what each query finds in the block it is sent to, at most
    ``k + 1`` distinct vectors, with the smallest id of each. A block with more than ``QUERIES`` queries is given to several tasks."""
    queries = settle(queries, "ann-visits")
    # One row per block.
    parts = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))
    left = indexed.join(F.broadcast(parts), "block").select(
        "block",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        "key",
        "vec",
        "first",
    )
    right = queries.join(F.broadcast(parts), "block").select(
        "block", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"), "key", "vec", "bound"
    )

    def run(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if candidates.num_rows and asked.num_rows:
            vectors = _matrix(candidates["vec"], dims)
            keys, ids = candidates["key"].to_numpy(), candidates["first"].to_numpy()
            block = kdtree.Block(vectors, kdtree.raised(vectors, largest) @ matrix, ids)
            vecs = _matrix(asked["vec"], dims)
            points = vecs @ matrix[:dims]
            bounds = asked["bound"].to_pylist()
            for i, query in enumerate(asked["key"].to_pylist()):
                bound = -np.inf if bounds[i] is None else bounds[i]
                base = float((vecs[i] ** 2).sum()) + largest
                rows, scores = block.nearest(vecs[i], points[i], k + 1, base, quantile, bound)
                out[0].append(np.full(len(rows), query))
                out[1].append(keys[rows])
                out[2].append(scores)
                out[3].append(ids[rows])
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        columns = [
            pa.array(np.concatenate(c) if c else (), kind) for c, kind in zip(out, kinds)
        ]
        return pa.Table.from_arrays(columns, ["query", "key", "score", "first"])

    return (
        left.groupBy("block", "part")
        .cogroup(right.groupBy("block", "part"))
        .applyInArrow(run, "query bigint, key bigint, score double, first bigint")
    )
