"""Hard negatives of anchors, by candidate lists that the anchors of a cluster share.

Anchors are clustered by direction. For a candidate at angle ``phi`` to the centre of a cluster
whose members lie within ``theta`` of it, no member is nearer to the candidate than ``phi - theta``;
so ``|candidate| cos(max(0, phi - theta))`` times the member's length bounds their inner product.
Each cluster sorts its candidates by that bound once, and every member walks this list until the
bound certifies that nothing that follows can enter its answer.

A list is dealt out in pieces of consecutive bounds. The first piece of each list is walked first;
what the members have found by then says how far down their list can matter at all, and only that
much of it is sent and walked. Positives are found like this, then the negatives of each.

Vectors are whole numbers and their inner products exact. Rows with equal vectors and labels are
searched as one, and of their ids only as many as an answer can hold are carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedsift.llm.common import hash_sample, lookup, map_batches, settle, ship

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score
SCALE = 256
CLUSTER_MEMBERS = 64  # on average
MAX_CLUSTERS = 4096  # their centres are sent everywhere; beyond, clusters get more members
SAMPLE_ROWS = 20_000  # anchors that the centres are fitted on; every anchor is assigned
PIECE_ROWS = 8192  # candidates of a piece of a list
PART_MEMBERS = 1024  # members that one task takes along a piece
STEP = 512  # candidates of a list that are compared at once
BUCKETS = 64  # of bounds, for cutting lists
SEED = 29
ANY = 1 << 62  # above any score


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int):
    """(id, label, vec) of the rows that take part; ``vec`` is floor(scale * x) of each component."""
    given = rows.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vec"),
    ).filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return given.filter(finite & (F.size("vec") > 0)).withColumn(
        "vec", F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    )


def _fitting(vectors: DataFrame, dims: int) -> DataFrame:
    """Of the common length, and so small that every inner product is below 2^62."""
    limit = min(math.isqrt((1 << 62) // max(dims, 1)), (1 << 31) - 1) - 1
    small = F.forall("vec", lambda x: (x <= limit) & (x >= -limit))
    return vectors.filter((F.size("vec") == dims) & small)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, dims)


def units(vectors: np.ndarray) -> np.ndarray:
    """Directions; that of a zero vector is the first axis."""
    vectors = vectors.astype(np.float64)
    zero = ~vectors.any(1)
    vectors[zero, 0] = 1
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def centres(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """``k`` directions around which those of the sample gather."""
    rng = np.random.default_rng(seed)
    points = units(sample)
    found = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        of = np.argmax(points @ found.T, 1)
        total = np.zeros_like(found)
        np.add.at(total, of, points)
        found = np.where(total.any(1)[:, None], units(total), found)
    return found


@dataclass(frozen=True)
class Lists:
    """The candidate lists of all clusters: how they are ordered and cut into pieces."""

    dims: int
    centres: np.ndarray
    theta: np.ndarray  # the largest angle of a member to its centre
    longest: float  # of all candidates
    parts: np.ndarray  # tasks that share the members of a cluster
    before: np.ndarray | None = None  # candidates in better buckets, by cluster and bucket
    counts: np.ndarray | None = None

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """By candidate and cluster."""
        length = np.linalg.norm(vectors.astype(np.float64), axis=1)
        phi = np.arccos(np.clip(units(vectors) @ self.centres.T, -1, 1))
        return length[:, None] * np.cos(np.maximum(phi - self.theta, 0))

    def buckets(self, bounds: np.ndarray) -> np.ndarray:
        place = (1 - bounds / max(self.longest, 1e-300)) / 2 * BUCKETS
        return np.clip(place.astype(np.int64), 0, BUCKETS - 1)

    def pieces(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Consecutive buckets share a piece; a large bucket is dealt to several by id."""
        bucket = self.buckets(bounds)
        with np.errstate(over="ignore"):
            draw = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        draw = draw.astype(np.float64) * 2.0**-53
        of = np.arange(len(self.centres))
        at = self.before[of, bucket] + draw[:, None] * self.counts[of, bucket]
        return (at / PIECE_ROWS).astype(np.int64)

    def last_piece(self, need: np.ndarray) -> np.ndarray:
        """Of each list, the last piece that may hold a bound of at least ``need``."""
        bucket = self.buckets(np.clip(need, -self.longest, self.longest))
        of = np.arange(len(self.centres))
        upto = self.before[of, bucket] + self.counts[of, bucket]
        return np.where(need > self.longest * (1 + 1e-9), -1, upto // PIECE_ROWS)

    @property
    def slack(self) -> float:
        """Covers the rounding of angles and cosines, for a member of length 1."""
        return 1e-6 * self.longest


def _counted(candidates: DataFrame, lists: Lists) -> Lists:
    def run(batches):
        counts = np.zeros((len(lists.centres), BUCKETS), np.int64)
        of = np.arange(len(lists.centres))
        for _, vectors in _chunks(batches, lists):
            bucket = lists.buckets(lists.bounds(vectors))
            np.add.at(counts, (np.broadcast_to(of, bucket.shape), bucket), 1)
        cluster, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster), pa.array(bucket), pa.array(counts[cluster, bucket])],
            ["cluster", "bucket", "n"],
        )

    found = map_batches(candidates, run, "cluster bigint, bucket bigint, n bigint")
    counts = np.zeros((len(lists.centres), BUCKETS), np.int64)
    for row in found.groupBy("cluster", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["cluster"], row["bucket"]] = row["n"]
    return replace(lists, before=np.cumsum(counts, 1) - counts, counts=counts)


def _chunks(batches, lists: Lists):
    step = max(1, (1 << 20) // len(lists.centres))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            yield batch, _matrix(batch.column("vec"), lists.dims)


LIST_SCHEMA = (
    "cluster bigint, piece bigint, part bigint,"
    " ids array<bigint>, labels array<bigint>, bounds array<double>, vecs array<int>"
)


def _sent(candidates: DataFrame, lists: Lists, need: np.ndarray | None) -> DataFrame:
    """The first piece of every list, or what comes after it down to a bound of ``need``."""

    def run(batches):
        for batch, vectors in _chunks(batches, lists):
            bounds = lists.bounds(vectors)
            ids = batch.column("id").to_numpy()
            labels = batch.column("label").to_numpy()
            piece = lists.pieces(bounds, ids)
            wanted = piece == 0 if need is None else (piece > 0) & (bounds >= need)
            row, cluster = np.nonzero(wanted)
            of = piece[row, cluster]
            order = np.lexsort((of, cluster))
            row, cluster, of = row[order], cluster[order], of[order]
            cuts = np.flatnonzero((np.diff(cluster) != 0) | (np.diff(of) != 0)) + 1
            for group in np.split(np.arange(len(row)), cuts):
                if not len(group):
                    continue
                c, at = cluster[group[0]], row[group]
                for part in range(lists.parts[c]):
                    columns = [
                        pa.array([c]),
                        pa.array([of[group[0]]]),
                        pa.array([part], pa.int64()),
                        pa.array([ids[at]], pa.list_(pa.int64())),
                        pa.array([labels[at]], pa.list_(pa.int64())),
                        pa.array([bounds[at, c]], pa.list_(pa.float64())),
                        pa.array([vectors[at].ravel().astype(np.int32)], pa.list_(pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        columns, ["cluster", "piece", "part", "ids", "labels", "bounds", "vecs"]
                    )

    return map_batches(candidates, run, LIST_SCHEMA)


class Found:
    """The ``k`` best of what one question has met: scores from ``lo`` to ``hi``, highest first,
    ties to the smaller id."""

    def __init__(self, ask: int, lo: int, hi: int, least: int, k: int):
        self.ask, self.lo, self.hi, self.k = ask, lo, hi, k
        self.least = max(lo, least)  # below this nothing can enter
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.least) & (scores <= self.hi)
        if not fits.any():
            return
        scores = np.concatenate([self.scores, scores[fits]])
        ids = np.concatenate([self.ids, ids[fits]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def walk(
    lists: Lists,
    bounds: np.ndarray,
    vectors: np.ndarray,
    ids: np.ndarray,
    labels: np.ndarray,
    members: np.ndarray,
    own: np.ndarray,
    asks: list[list[Found]],
    same: bool,
) -> int:
    """Every member's questions along one piece; returns how many inner products it took."""
    order = np.argsort(-bounds, kind="stable")
    length = np.linalg.norm(members.astype(np.float64), axis=1)
    # Whole numbers below 2^53 add up exactly as doubles.
    exact = lists.longest * max(length.max(initial=0), 1) < 2**53
    kind = np.float64 if exact else np.int64
    members = members.astype(kind)
    need = np.array([min(f.least for f in fs) for fs in asks], np.int64)
    most = np.array([max(f.hi for f in fs) for fs in asks], np.int64)
    taken = 0
    for at in range(0, len(order), STEP):
        some = order[at : at + STEP]
        live = np.flatnonzero(length * (bounds[some[0]] + lists.slack) + 1e-6 >= need)
        if not len(live):
            break
        scores = (vectors[some].astype(kind) @ members[live].T).astype(np.int64)
        taken += scores.size
        kin = labels[some][:, None] == own[live]
        fits = (kin == same) & (scores >= need[live]) & (scores <= most[live])
        for i in np.flatnonzero(fits.any(0)):
            rows = np.flatnonzero(fits[:, i])
            member = live[i]
            for found in asks[member]:
                found.add(scores[rows, i], ids[some[rows]])
            need[member] = min(f.least for f in asks[member])
    return taken


def _walked(sent: DataFrame, members: DataFrame, lists: Lists, k: int, same: bool) -> DataFrame:
    """(key, ask, score, id): what the members find in the pieces that they are sent to."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            ids, labels, bounds = (
                left[c].combine_chunks().flatten().to_numpy() for c in ("ids", "labels", "bounds")
            )
            asks = [
                [Found(a["ask"], a["lo"], a["hi"], a["least"], k) for a in own]
                for own in right["asks"].to_pylist()
            ]
            walk(
                lists,
                bounds,
                _matrix(left["vecs"], lists.dims),
                ids,
                labels,
                _matrix(right["vec"], lists.dims),
                right["label"].to_numpy(),
                asks,
                same,
            )
            for key, own in zip(right["key"].to_pylist(), asks):
                for found in own:
                    out[0].append(np.full(len(found.ids), key))
                    out[1].append(np.full(len(found.ids), found.ask))
                    out[2].append(found.scores)
                    out[3].append(found.ids)
        columns = [pa.array(np.concatenate(c) if c else (), pa.int64()) for c in out]
        return pa.Table.from_arrays(columns, ["key", "ask", "score", "id"])

    where = ("cluster", "piece", "part")
    return (
        sent.groupBy(*where)
        .cogroup(members.groupBy(*where))
        .applyInArrow(run, "key bigint, ask bigint, score bigint, id bigint")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "ask").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _answers(
    candidates: DataFrame, members: DataFrame, lists: Lists, k: int, same: bool, name: str
) -> DataFrame:
    """(key, ask, score, id, place): the ``k`` best candidates for each question of each member.

    ``members`` has (key, label, vec, cluster, part, length, asks)."""
    spark = members.sparkSession
    head = members.withColumn("piece", F.lit(0).cast("bigint"))
    first = settle(
        _best(_walked(_sent(candidates, lists, None), head, lists, k, same), k), f"{name}-first"
    )
    # What the k-th find of a question rules out.
    kth = first.groupBy("key", "ask").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    asked = members.select("key", "cluster", "length", F.explode("asks").alias("a"))
    known = asked.withColumn("ask", F.col("a.ask")).join(
        kth.filter(F.col("n") >= k).drop("n"), ["key", "ask"], "left"
    ).select(
        "key",
        "cluster",
        "length",
        F.struct(
            "a.ask", "a.lo", "a.hi", F.greatest("a.lo", F.coalesce("s", "a.lo")).alias("least")
        ).alias("a"),
    )
    known = settle(known, f"{name}-known")
    reach = (
        F.when(F.col("length") > 0, (F.col("a.least") - 1e-6) / F.col("length") - lists.slack)
        .when(F.col("a.least") <= 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    need = np.full(len(lists.centres), np.inf)
    for row in known.groupBy("cluster").agg(F.min(reach).alias("r")).toLocalIterator():
        need[row["cluster"]] = row["r"]
    last = lists.last_piece(need)
    far = spark.createDataFrame(
        pa.table({"cluster": np.arange(len(last)), "last": last.astype(np.int64)})
    )
    narrowed = known.groupBy("key").agg(F.collect_list("a").alias("asks"))
    rest = (
        members.drop("asks")
        .join(narrowed, "key")
        .join(F.broadcast(far.filter("last > 0")), "cluster")
        .withColumn("piece", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last"))))
        .drop("last")
    )
    second = _walked(_sent(candidates, lists, need), rest, lists, k, same)
    return settle(_best(first.select("key", "ask", "score", "id").union(second), k), name)


def hard_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    seed: int = SEED,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Each component x becomes floor(scale * x); scores are the inner products of what results. For
    every row of ``anchors``, which are rows of ``rows``, the ``positives`` other rows of its label
    with the highest scores are its positives; for each of them come the ``negatives`` best rows of
    other labels that score ``low`` to ``high`` percent of the positive's score, ends included.
    Higher scores come first, ties go to the smaller id. Fewer come only where there are fewer.

    Rows take no part whose id, label or vector is NULL or empty, that hold a NULL or non-finite
    component, whose vector is of another length than most, or so large that an inner product
    could leave 64 bits. Zero vectors take part. An anchor's own row is left out once, its equals
    and repeated rows stay. Other columns are not looked at. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    given = whole_vectors(rows, id_col, vector_col, label_col, scale)
    common = given.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = common["d"] if common else 0
    held = max(negatives, positives + 1)
    place = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    candidates = settle(
        _fitting(given, dims).withColumn("place", place).filter(F.col("place") <= held).drop("place"),
        "negatives-candidates",
    )
    asked = settle(
        _fitting(whole_vectors(anchors, id_col, vector_col, label_col, scale), dims), "negatives-anchors"
    )
    kinds = asked.groupBy("label", "vec").agg(F.count(F.lit(1)).alias("n"))
    kinds = settle(kinds.withColumn("key", F.monotonically_increasing_id()), "negatives-kinds")
    n_kinds, n_asked = kinds.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_kinds:
        return spark.createDataFrame(
            [],
            "anchor_id bigint, positive_id bigint, rank int, negative_id bigint,"
            " positive_score bigint, negative_score bigint",
        )

    sample = hash_sample(kinds.select("key", "vec"), "key", SAMPLE_ROWS, seed)
    k = min(max(1, math.ceil(n_kinds / CLUSTER_MEMBERS)), MAX_CLUSTERS)
    found = centres(_matrix(sample["vec"], dims), k, seed)
    clustered = settle(_clustered(kinds, found, dims), "negatives-clusters")
    theta, sizes = np.zeros(len(found)), np.zeros(len(found), np.int64)
    for row in clustered.groupBy("cluster").agg(
        F.max("angle").alias("t"), F.count(F.lit(1)).alias("n")
    ).toLocalIterator():
        theta[row["cluster"]], sizes[row["cluster"]] = row["t"], row["n"]
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    longest = math.sqrt(candidates.agg(F.max(square)).first()[0] or 0.0)
    parts = -(-sizes // PART_MEMBERS)
    lists = _counted(candidates, Lists(dims, found, theta + 1e-6, longest, parts))

    shares = spark.createDataFrame(
        pa.table({"cluster": np.arange(len(parts)), "parts": parts.astype(np.int64)})
    )
    members = clustered.join(F.broadcast(shares), "cluster").select(
        "key",
        "label",
        "vec",
        "cluster",
        F.pmod(F.xxhash64("key"), F.col("parts")).alias("part"),
        F.sqrt(square).alias("length"),
    )
    near = _answers(
        candidates,
        members.withColumn("asks", F.array(_ask(F.lit(0), F.lit(-ANY), F.lit(ANY)))),
        lists,
        positives + 1,
        True,
        "negatives-positives",
    )
    near = near.groupBy("key").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "score", "id"))),
            lambda x: F.struct(x["score"], x["id"]),
        ).alias("near")
    )
    near = settle(near, "negatives-near")
    scores = F.array_distinct(F.transform("near", lambda x: x["score"]))
    windows = F.filter(
        F.transform(F.filter(scores, lambda s: s >= 0), lambda s: _ask(s, *_window(s, low, high))),
        lambda a: a["lo"] <= a["hi"],
    )
    questions = members.join(near, "key").withColumn("asks", windows).drop("near")
    hard = _answers(
        candidates,
        settle(questions.filter(F.size("asks") > 0), "negatives-questions"),
        lists,
        negatives,
        False,
        "negatives-hard",
    )
    hard = hard.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("ask", "place", "score", "id"))).alias("hard")
    )
    table = settle(
        kinds.join(near, "key").join(hard, "key").select(
            "label", "vec", "n", "near", "hard", _own_score().alias("self")
        ),
        "negatives-table",
    )
    # Anchors whose kind has no negative at all have no rows.
    there = asked.join(table.select("label", "vec"), ["label", "vec"], "left_semi")
    itself = F.array_position("near", F.struct(F.col("self").alias("score"), F.col("id").alias("id")))
    others = F.filter("near", lambda x, i: i + 1 != itself)
    return (
        lookup(settle(there, "negatives-asked"), table, ["label", "vec"], "n", n_asked)
        .select("id", "hard", F.explode(F.slice(others, 1, positives)).alias("p"))
        .select(
            F.col("id").alias("anchor_id"),
            "p",
            F.posexplode(F.filter("hard", lambda x: x["ask"] == F.col("p.score"))).alias("at", "x"),
        )
        .select(
            "anchor_id",
            F.col("p.id").alias("positive_id"),
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("x.id").alias("negative_id"),
            F.col("p.score").alias("positive_score"),
            F.col("x.score").alias("negative_score"),
        )
    )


def _own_score() -> Column:
    return F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x * x)


def _ask(name: Column, lo: Column, hi: Column) -> Column:
    return F.struct(
        name.cast("bigint").alias("ask"),
        lo.cast("bigint").alias("lo"),
        hi.cast("bigint").alias("hi"),
        lo.cast("bigint").alias("least"),
    )


def _window(score: Column, low: int, high: int) -> tuple[Column, Column]:
    """The whole numbers from ``low`` to ``high`` percent of a score that is not negative."""

    def hundredth(x: Column) -> Column:
        return F.call_function("div", x, F.lit(100).cast("bigint"))

    hundreds, rest = hundredth(score), score % 100
    return hundreds * low + hundredth(rest * low + 99), hundreds * high + hundredth(rest * high)


def _clustered(kinds: DataFrame, found: np.ndarray, dims: int) -> DataFrame:
    """(key, label, vec, cluster, angle)"""

    def run(batches):
        for batch in batches:
            near = units(_matrix(batch.column("vec"), dims)) @ found.T
            of = np.argmax(near, 1)
            angle = np.arccos(np.clip(near[np.arange(len(of)), of], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(of), pa.array(angle)],
                ["key", "label", "vec", "cluster", "angle"],
            )

    return map_batches(
        kinds.select("key", "label", "vec"),
        run,
        "key bigint, label bigint, vec array<bigint>, cluster bigint, angle double",
    )
