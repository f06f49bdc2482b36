"""Jaccard join of shingle sets by parity sketches.

A sketch has one bit per shingle hash position, and every shingle flips its bit. Two sketches
therefore differ in at most as many bits as their sets differ in shingles. Sets whose Jaccard
similarity is at least ``t`` differ in at most ``a (1 - t) / t`` shingles, ``a`` being the size of
the smaller one, and their sizes in no more than by the factor ``1 / t``. So sizes are cut into bands
of that ratio, each band has a sketch of one more block than its sets may differ in, and by the
pigeonhole similar sets agree in some whole block: equal blocks are join keys, and no pair is missed.
Pairs that meet are discarded by the distance of a second, short sketch and the survivors verified.

Equal sets are one node. Keys that no other node has go. Then each node is compared with a few of
those that share its keys, its hubs, and what verifies makes components. Then all pairs that share a
key are compared, but only keys on which different components meet, and only pairs across them:
within a component nothing more can be learned, so a large group of near copies does not cost all
its pairs, and no link between components is lost.
"""

from __future__ import annotations

from functools import reduce
from hashlib import blake2b
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedsift.llm.common import byte_chunks, lookup, map_batches, settle, text_bytes
from seedsift.llm.graph import contract
from seedsift.llm.shingles import grouped

WORDS = 3
PERCENT = 90
SEED = 42
CHUNK_BYTES = 1 << 20  # texts whose shingles are hashed at once
BLOCK_BITS = 64
FOLD_BITS = 512  # of the short sketch
HUBS = 3  # orders in which the first of a key is its hub
SEEN = 100_000  # nodes that a task remembers, so as not to send them again
SENT_TEXTS = 1 << 17  # eight bytes each; more are not broadcast
LOWEST = 16  # keys of a node that tell at which key a pair meets


def bands(top: int, percent: int) -> list[int]:
    """The smallest size of each band, up to the band that holds ``top``. What is similar to a set
    of one band, and not smaller, lies in the same band or the next."""
    found = [1]
    while found[-1] <= top:
        found.append(found[-1] * 100 // percent + 1)
    return found


def allowed(smaller: int, percent: int) -> int:
    """How many shingles a set of this size and a similar one that is not smaller differ in at most."""
    return smaller * (100 - percent) // percent


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64 bit mix of each number."""
    with np.errstate(over="ignore"):
        x = x ^ (np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _parity(at: np.ndarray, size: int) -> np.ndarray:
    """A sketch of ``size`` bits with the bits at ``at`` flipped, as 64 bit blocks."""
    odd = (np.bincount(at, minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def block_keys(hashes: np.ndarray, band: int, blocks: int) -> np.ndarray:
    """One join key per block of the sketch that the band asks for."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bit = hashes & np.uint64(BLOCK_BITS - 1)
    found = _parity((block * np.uint64(BLOCK_BITS) + bit).astype(np.int64), blocks * BLOCK_BITS)
    place = _mixed(np.arange(blocks, dtype=np.uint64), band + 1)
    return _mixed(found ^ place, 7).view(np.int64)


def fold(hashes: np.ndarray) -> np.ndarray:
    """The short sketch, the same for all bands."""
    at = (hashes >> np.uint64(6)) & np.uint64(FOLD_BITS - 1)
    return _parity(at.astype(np.int64), FOLD_BITS).view(np.int64)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for of, hashes, counts in grouped(texts, words, SEED):
        for i, found in zip(of.tolist(), np.split(hashes, np.cumsum(counts)[:-1])):
            parts[i].append(np.unique(found))
    none = np.zeros(0, np.uint64)
    return [
        p[0] if len(p) == 1 else np.unique(np.concatenate(p)) if p else none for p in parts
    ]


def _node(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


def band_keys(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the set as the smaller one of a pair, or of equal size, and as the larger one
    that meets sets of the band below. None for a band that allows no difference."""
    lows = bands(len(hashes), percent)
    own = len(lows) - 2
    none = np.zeros(0, np.int64)
    out = [none, none]
    for i, band in enumerate((own, own - 1)):
        if band >= 0 and (d := allowed(lows[band + 1] - 1, percent)):
            out[i] = block_keys(hashes, band, d + 1)
    return out[0], out[1]


def sketch_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, t, n, node, own, less, fold): for every row the size and identity of its set, and its
    sketches unless the task has sent the same node before. ``t`` tells where its text is found."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for i, j in byte_chunks(texts, CHUNK_BYTES):
                sets = shingle_sets(texts[i:j].to_pylist(), words)
                nodes = [_node(h) for h in sets]
                rows = []
                for hashes, node in zip(sets, nodes):
                    if node in seen or not len(hashes):
                        rows.append((None, None, None))
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    rows.append((*band_keys(hashes, percent), fold(hashes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(i, j - i),
                        batch.column("t").slice(i, j - i),
                        pa.array([len(h) for h in sets], pa.int64()),
                        pa.array(nodes, pa.binary()),
                        *(pa.array(column, pa.list_(pa.int64())) for column in zip(*rows)),
                    ],
                    ["id", "t", "n", "node", "own", "less", "fold"],
                )

    schema = (
        "id bigint, t bigint, n bigint, node binary,"
        " own array<bigint>, less array<bigint>, fold array<bigint>"
    )
    return map_batches(docs.select("id", "t", "text"), run, schema)


def _sets_of(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of some nodes, from the texts of their ``t``."""
    wanted = settle(nodes.select("t").distinct(), "jaccard-texts")
    if wanted.count() <= SENT_TEXTS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "t", "left_semi").select("text")

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for i, j in byte_chunks(texts, CHUNK_BYTES):
                found = {_node(h): h.view(np.int64) for h in shingle_sets(texts[i:j].to_pylist(), words)}
                found = {node: h for node, h in found.items() if node not in seen}
                if len(seen) >= SEEN:
                    seen.clear()
                seen.update(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(found), pa.binary()),
                        pa.array(list(found.values()), pa.list_(pa.int64())),
                    ],
                    ["node", "hashes"],
                )

    sets = map_batches(texts, run, "node binary, hashes array<bigint>")
    return settle(sets.dropDuplicates(["node"]), "jaccard-sets")


def _verified(
    pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int
) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = _sets_of(
        docs, settle(nodes.select("node", "t").join(ends.distinct(), "node"), "jaccard-ends"), words
    )
    one, other = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    common = F.size(F.array_intersect("ha", "hb"))
    both = F.size("ha") + F.size("hb")
    return settle(
        pairs.join(one, "a")
        .join(other, "b")
        .filter(100 * common >= percent * (both - common))
        .select("a", "b"),
        "jaccard-links",
    )


def _shared(rows: DataFrame) -> DataFrame:
    """(key, x): the keys that several nodes have, with these nodes; most keys have one and go.

    An aggregate by key says which; then eight bytes of key and node travel for each row."""
    keyed = rows.filter("own IS NOT NULL").select(
        "x", F.explode(F.concat("own", "less")).alias("key")
    )
    met = settle(
        keyed.groupBy("key")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        .filter("lo < hi")
        .select("key"),
        "jaccard-keys",
    )
    return settle(keyed.join(met, "key").distinct(), "jaccard-shared")


def _plausible(percent: int) -> Column:
    """Of two nodes ``a`` and ``b``: neither the sizes nor the short sketches rule a link out."""

    def apart(i: int) -> Column:
        return F.bit_count(F.col("a.fold")[i].bitwiseXOR(F.col("b.fold")[i]))

    distance = reduce(add, [apart(i) for i in range(FOLD_BITS // 64)])
    sizes = F.col("a.n") + F.col("b.n")
    close = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    return close & ((100 + percent) * distance <= (100 - percent) * sizes)


def _hub_pairs(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): plausible pairs of a node and a hub of one of its keys: of all nodes of a key, one
    that comes first in some order."""
    names = [f"r{i}" for i in range(HUBS)]
    ranks = [F.xxhash64("x", F.lit(i)).alias(r) for i, r in enumerate(names)]
    hubs = shared.select("key", *ranks).groupBy("key").agg(*[F.min(r).alias(r) for r in names])
    led = shared.join(hubs, "key").select("x", F.explode(F.array(*names)).alias("r")).distinct()
    ranked = nodes.select("node", "n", "fold", F.explode(F.array(*ranks)).alias("r"))
    own = nodes.select("x", "node", "n", "fold").join(settle(led, "jaccard-led"), "x")
    pairs = own.alias("a").join(
        ranked.alias("b"), (F.col("a.r") == F.col("b.r")) & _plausible(percent)
    )
    a, b = F.col("a.node"), F.col("b.node")
    return settle(
        pairs.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
        "jaccard-hub-pairs",
    )


def _crossing_pairs(
    shared: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int
) -> DataFrame:
    """(a, b): all pairs of different components that share a key and that sizes and short sketches
    do not rule out."""
    placed = settle(
        nodes.join(roots, "node", "left").withColumn("c", F.xxhash64(F.coalesce("root", "node"))),
        "jaccard-placed",
    )
    held = shared.join(placed.select("x", "c"), "x")
    crossed = settle(
        held.groupBy("key")
        .agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        .filter("lo < hi")
        .select("key"),
        "jaccard-crossed",
    )
    # A pair that shares one of its lowest keys meets at the lowest of them only.
    rows = settle(held.join(crossed, "key"), "jaccard-crossing-keys")
    lowest = rows.groupBy("x").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LOWEST).alias("low"))
    met = rows.join(placed.drop("c").join(lowest, "x"), "x").drop("x")
    met = settle(met.select("key", "node", "n", "fold", "c", "low"), "jaccard-met")
    a, b = met.alias("a"), met.alias("b")
    common = F.array_min(F.array_intersect("a.low", "b.low"))
    return settle(
        a.join(
            b,
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.node") < F.col("b.node"))
            & (F.col("a.c") != F.col("b.c"))
            & _plausible(percent)
            & (F.coalesce(common, F.col("a.key")) == F.col("a.key")),
        )
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        .distinct(),
        "jaccard-crossing",
    )


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(id, n_shingles, component_id, component_size) for every row of ``docs``.

    A row's set holds the distinct shingles of ``words`` words, of all words where there are fewer.
    Rows link whose sets have a Jaccard similarity of at least ``percent`` hundredths;
    ``component_id`` is the smallest id that can be reached. Shingles are compared by 64 bit hashes.

    A NULL or empty text, and one without a word, has no shingle, links with nothing and is its
    own component. A NULL id is returned but names a component only where there is no other id, as
    NULL. Repeated rows each get a row. Long texts are taken in pieces. Other columns are not
    looked at. An empty table gives an empty result.
    """
    given = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    given = given.withColumn("t", F.xxhash64("text"))
    rows = settle(
        sketch_rows(given, words, percent).withColumn("x", F.xxhash64("node")), "jaccard-rows"
    )
    shared = _shared(rows)
    nodes = settle(
        rows.filter("own IS NOT NULL")
        .select("node", "x", "n", "t", "fold")
        .join(shared.select("x").distinct(), "x", "left_semi")
        .dropDuplicates(["node"]),
        "jaccard-nodes",
    )
    links = _verified(_hub_pairs(shared, nodes, percent), nodes, given, words, percent)
    crossing = _crossing_pairs(shared, nodes, contract(links), percent)
    links = links.union(_verified(crossing, nodes, given, words, percent))
    roots = contract(links)

    full = rows.filter("n > 0").select("id", "n", "node")
    counted = settle(
        full.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")),
        "jaccard-counted",
    )
    linked = counted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = linked.groupBy("root").agg(
        F.min("first").alias("component_id"), F.sum("rows").alias("component_size")
    )
    table = settle(
        linked.join(named, "root").select("node", "rows", "component_id", "component_size"),
        "jaccard-components",
    )
    total = counted.agg(F.sum("rows")).first()[0] or 0
    columns = ("id", "n", "component_id", "component_size")
    found = lookup(full, table, ["node"], "rows", total).select(*columns)
    alone = rows.filter("n = 0").select(
        "id", "n", F.col("id").alias("component_id"), F.lit(1).cast("bigint").alias("component_size")
    )
    return found.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "component_size"
    )
