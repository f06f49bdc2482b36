"""Passages that repeat anywhere in a corpus, by longest-previous-factor arrays.

Every string of ``width`` bytes, a window, has an anchor: the 64 byte string in it whose hash is
smallest. Equal windows have equal anchors at equal offsets, so only stretches of text around equal
anchors can repeat each other. A stretch is the run of windows that share one anchor.

1. Per chunk of documents, equal stretches are brought together first: one of them goes on with a
   count, so a passage of a third of all documents is one row per chunk.
2. Stretches meet by anchor in one shuffle of a few numbers each. Those whose anchor stays alone
   are dropped.
3. Where different stretches share an anchor, their bytes are fetched, one stretch of each kind,
   and the longest-previous-factor array of each group says which windows have an earlier match
   and where. A group of more kinds than ``MAX_GROUP`` (a common passage in ever new surroundings)
   is solved in parts of about that size; windows that stay alone in their part may still repeat in
   another. Which can is told by a few keys of each kind: windows that reach about as far to the
   left of the anchor form a cell, and equal windows agree on the bytes that all windows of their
   cell hold. Only windows of cells whose bytes several kinds have are counted over all parts.
4. Covered bytes are cut out of the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seedsift.llm.common import byte_chunks, map_batches, settle, text_bytes
from seedsift.llm.suffix import longest_previous_factors

WIDTH = 200
ANCHOR = 64
PLACE_BITS = 22
PIECE_BYTES = 1 << PLACE_BITS
MAX_GROUP = 1000
LPF_BYTES = 1 << 20
MIX = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * i & (1 << 64) - 1) for i in range(8)]


def _mix(*parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.uint64(0x2545F4914F6CDD1D)
        for part, factor in zip(parts, MIX):
            total = (total ^ part.astype(np.uint64, copy=False)) * factor
            total = total ^ (total >> np.uint64(29))
        return total


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes at each position; 0 where fewer are left."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    pairs = _mix(words[:-8], words[8:])
    fours = _mix(pairs[:-16], pairs[16:])
    return _mix(fours[:-32], fours[32:])


def window_hashes(anchors: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows that start at ``at``."""
    steps = [*range(0, width - ANCHOR, ANCHOR), width - ANCHOR]
    return _mix(*[anchors[at + step] for step in steps])


def stretches(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int):
    """(first window, last window, anchor hash, digest) of all stretches of the texts
    ``data[start : start + size]``, in order."""
    long = np.flatnonzero(sizes >= width)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    hashes = anchor_hashes(data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    span, left = 1, width - ANCHOR + 1
    while 2 * span <= left:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if left > span:
        best = np.minimum(best[: len(best) - (left - span)], best[left - span :])
    anchor = (best & low).astype(np.int64)
    counts = sizes[long] - width + 1
    offsets = np.cumsum(counts) - counts
    windows = np.arange(int(counts.sum())) + np.repeat(starts[long] - offsets, counts)
    at = anchor[windows]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[offsets] = True
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    first, last, where = windows[heads], windows[tails], at[heads]
    digest = _mix(
        window_hashes(hashes, first, width),
        window_hashes(hashes, last, width),
        (where - first).astype(np.uint64),
        (last - first).astype(np.uint64),
    )
    return first, last, hashes[where], digest, hashes


def _mapped(df: DataFrame, run, schema) -> DataFrame:
    """``map_batches`` in which Arrow gives memory back as soon as a batch is done with."""

    def lean(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)

    return map_batches(df, lean, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """(row, id, packed): compressed texts, for a join by row."""

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for i, j in byte_chunks(texts):
                packed = [
                    len(t).to_bytes(8, "little") + pa.compress(t, "zstd", asbytes=True)
                    for t in texts[i:j].to_pylist()
                ]
                ids = [batch.column(name).slice(i, j - i) for name in ("row", "id")]
                yield pa.RecordBatch.from_arrays(
                    [*ids, pa.array(packed, pa.binary())], ["row", "id", "packed"]
                )

    return _mapped(
        docs.select("row", "id", "text"), run, "row bigint, id bigint, packed binary"
    )


def _unpacked(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, "zstd", asbytes=True) if size else b""


ROWS = 512  # texts that are unpacked before their results go on


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of windows, sorted, joined where they touch."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1] + 1
    heads = np.flatnonzero(new)
    return lo[heads], hi[np.append(heads[1:], len(lo)) - 1] if len(lo) else hi


FOUND = (
    "row bigint, lo bigint, hi bigint, key bigint, digest bigint, n bigint, local_lo array<bigint>, "
    "local_hi array<bigint>"
)


def _local(docs: DataFrame, width: int) -> DataFrame:
    """Rows of stretches (``key`` filled), one per kind and chunk, and rows of documents with the
    windows that repeat an earlier one of their chunk."""

    def found(rows, data, starts, sizes, shifts):
        first, last, key, digest, _ = stretches(data, starts, sizes, width)
        owner = np.searchsorted(starts, first, side="right") - 1
        base = shifts[owner] - starts[owner]
        order = np.lexsort((np.arange(len(key)), digest, key))
        k, d = key[order], digest[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(order)))
        kept, others = order[heads], np.sort(order[~new])
        long = pa.int64()
        m = len(kept)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[owner[kept]], long),
                pa.array((first + base)[kept], long),
                pa.array((last + base)[kept], long),
                pa.array(key[kept].view(np.int64), long),
                pa.array(digest[kept].view(np.int64), long),
                pa.array(n, long),
                pa.nulls(m, pa.list_(long)),
                pa.nulls(m, pa.list_(long)),
            ],
            names,
        )
        # The others repeat an earlier stretch of this chunk.
        cuts = np.flatnonzero(np.diff(owner[others])) + 1
        groups = [g for g in np.split(others, cuts) if len(g)]
        ranges = [_runs((first + base)[g], (last + base)[g]) for g in groups]
        m = len(groups)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[owner[g[0]]] for g in groups], long),
                *[pa.nulls(m, long) for _ in range(5)],
                pa.array([r[0] for r in ranges], pa.list_(long)),
                pa.array([r[1] for r in ranges], pa.list_(long)),
            ],
            names,
        )

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            rows = batch.column("row").to_numpy()
            for i, j in byte_chunks(texts, PIECE_BYTES // 2):
                part = texts[i:j]
                offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset :][: j - i + 1]
                data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
                data = data[offsets[0] : offsets[-1]]
                starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
                if len(data) < PIECE_BYTES:
                    yield from found(rows[i:j], data, starts, sizes, np.zeros(j - i, np.int64))
                    continue
                # One very long text, in pieces that overlap so that each window is in one of them.
                step = PIECE_BYTES // 2
                for at in range(0, len(data) - width + 1, step):
                    piece = data[at : at + step + width - 1]
                    yield from found(
                        rows[i:j], piece, starts, np.array([len(piece)]), np.array([at])
                    )

    names = ["row", "lo", "hi", "key", "digest", "n", "local_lo", "local_hi"]
    return _mapped(docs.select("row", "text"), run, FOUND)


def _fetched(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted stretches with their bytes."""
    asked = wanted.groupBy("row").agg(
        F.collect_list(F.struct("lo", "hi", "key", "parts", "single", "cells")).alias("asked")
    )

    def run(batches):
        for batch in _slices(batches):
            out = {name: [] for name in kinds}
            for row, packed, asked in zip(
                *[batch.column(name).to_pylist() for name in ("row", "packed", "asked")]
            ):
                text = _unpacked(packed)
                for ask in asked:
                    out["row"].append(row)
                    for name in ("lo", "key", "parts", "single", "cells"):
                        out[name].append(ask[name])
                    out["bytes"].append(text[ask["lo"] : ask["hi"] + width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[name], kind) for name, kind in kinds.items()], list(kinds)
            )

    kinds = {
        "row": pa.int64(),
        "lo": pa.int64(),
        "key": pa.int64(),
        "parts": pa.int64(),
        "single": pa.bool_(),
        "cells": pa.list_(pa.int64()),
        "bytes": pa.binary(),
    }
    return _mapped(
        _packed(docs).join(asked, "row"),
        run,
        "row bigint, lo bigint, key bigint, parts bigint, single boolean, cells array<bigint>,"
        " bytes binary",
    )


def matched_windows(parts: list[bytes], width: int, keep_first: bool) -> list[np.ndarray]:
    """Per part the windows in it that also occur elsewhere in the parts (or, with
    ``keep_first``, further left), by the longest-previous-factor array of all parts."""
    # A byte that no UTF-8 text holds keeps the parts apart.
    data = np.frombuffer(b"\xff".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    length, source = longest_previous_factors(data)
    covered = np.zeros(len(data), bool)
    for start, size in zip(starts, sizes):
        stop = max(start, start + size - width + 1)
        later = start + np.flatnonzero(length[start:stop] >= width)
        covered[later] = True
        if not keep_first:
            # The only earlier place of a window's second occurrence is its first one.
            covered[source[later]] = True
    return [np.flatnonzero(covered[i : i + n]) for i, n in zip(starts, sizes)]


SENT_ROWS = 1 << 20  # eight bytes each; more are not broadcast
CELL = 17  # windows of a cell start at so many neighbouring bytes


def cell_keys(data: bytes, key: int, n_windows: int, width: int) -> tuple[int, list[int]]:
    """(offset of the anchor, keys): per cell of a stretch's windows a hash of the bytes around the
    anchor that each of them holds. ``key`` is the anchor's hash; window ``w`` of the stretch, which
    starts at its byte ``w``, lies in cell ``(offset - w) // CELL``, the first key is of the last
    window's cell. Equal windows of two stretches lie in equal cells with equal keys."""
    found = anchor_hashes(np.frombuffer(data[:width], np.uint8))
    at = int(np.flatnonzero(found == np.uint64(key & (1 << 64) - 1))[0])
    keys = []
    for cell in range((at - n_windows + 1) // CELL, at // CELL + 1):
        left = cell * CELL
        right = max(0, width - ANCHOR - (left + CELL - 1))
        around = data[at - left : at + ANCHOR + right]
        mark = hashlib.blake2b(around, digest_size=8, salt=cell.to_bytes(2, "little"))
        keys.append(int.from_bytes(mark.digest(), "little", signed=True))
    return at, keys


def _open_cells(docs: DataFrame, parted: DataFrame, width: int) -> DataFrame:
    """(row, lo, cells): of the stretches of groups that are solved in parts, the keys of cells that
    another stretch of the group has, too. Only the texts of these stretches are fetched."""
    owners = parted.select("row").distinct()
    if owners.count() <= SENT_ROWS:
        owners = F.broadcast(owners)
    fetched = _fetched(
        docs.join(owners, "row", "left_semi").withColumn("id", F.lit(None).cast("bigint")),
        parted.withColumn("cells", F.lit(None).cast("array<bigint>")),
        width,
    )

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            keys = [
                cell_keys(data, key, len(data) - width + 1, width)[1]
                for data, key in zip(rows["bytes"], rows["key"])
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "lo", "key")), pa.array(keys, pa.list_(pa.int64()))],
                ["row", "lo", "key", "cells"],
            )

    found = _mapped(
        fetched.select("row", "lo", "key", "bytes"),
        run,
        "row bigint, lo bigint, key bigint, cells array<bigint>",
    )
    cells = settle(found.select("row", "lo", "key", F.explode("cells").alias("cell")), "cells")
    shared = cells.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return settle(
        cells.join(shared, ["key", "cell"])
        .groupBy("row", "lo")
        .agg(F.collect_list("cell").alias("cells")),
        "open-cells",
    )


SOLVED = (
    "row bigint, lo bigint, hi bigint, key bigint, "
    "windows array<struct<row: bigint, lo: bigint, window: bigint, done: boolean>>"
)
PACKED_WINDOWS = 256


def _lpf(stretches: DataFrame, width: int, keep_first: bool) -> DataFrame:
    """Ranges of repeated windows (``key`` NULL), and of each group that is solved in parts the
    windows of each part that may be in others, once each, at their first place there, many in a
    row; ``done`` tells which of these need no look at other parts."""

    def distinct_windows(rows, i, j, covered):
        """Of the stretches i to j, one part of a group; of their windows those of open cells."""
        hashes, place = [], []
        for k in range(i, j):
            data = np.frombuffer(rows["bytes"][k], np.uint8)
            n = len(data) - width + 1
            offset, keys = cell_keys(rows["bytes"][k], rows["key"][k], n, width)
            is_open = np.isin(np.array(keys, np.int64), rows["cells"][k] or [])
            first_cell = (offset - n + 1) // CELL
            at = np.arange(n)
            at = at[is_open[(offset - at) // CELL - first_cell]]
            hashes.append(window_hashes(anchor_hashes(data), at, width))
            place.append(at)
        owner = np.repeat(np.arange(i, j), [len(at) for at in place])
        done = np.concatenate(
            [np.isin(at, covered[k]) | (not rows["single"][k]) for k, at in zip(range(i, j), place)]
        )
        found, first = np.unique(np.concatenate(hashes), return_index=True)
        row, lo = np.array(rows["row"][i:j]), np.array(rows["lo"][i:j])
        at = lo[owner[first] - i] + np.concatenate(place)[first]
        return row[owner[first] - i], at, found.view(np.int64), done[first]

    def solve(rows):
        groups = list(zip(rows["key"], rows["part"]))
        i, n = 0, len(groups)
        while i < n:
            j, total = i, 0
            # Whole groups up to a bounded number of bytes, but never two parts of one: within a
            # run "further left" must mean earlier in the input.
            while j < n and (j == i or groups[j][0] != groups[j - 1][0]):
                k = j
                while k < n and groups[k] == groups[j]:
                    k += 1
                size = sum(map(len, rows["bytes"][j:k]))
                if j > i and total + size > LPF_BYTES:
                    break
                j, total = k, total + size
            covered = dict(
                zip(range(i, j), matched_windows(rows["bytes"][i:j], width, keep_first))
            )
            out = ([], [], [])
            for k in range(i, j):
                if rows["single"][k] and len(covered[k]):
                    lo, hi = _runs(covered[k], covered[k])
                    out[0].extend([rows["row"][k]] * len(lo))
                    out[1].extend((lo + rows["lo"][k]).tolist())
                    out[2].extend((hi + rows["lo"][k]).tolist())
            m = len(out[0])
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(c, pa.int64()) for c in out],
                    pa.nulls(m, pa.int64()),
                    pa.nulls(m, pa.list_(one)),
                ],
                columns,
            )
            k = i
            while k < j:
                last = k
                while last < j and groups[last] == groups[k]:
                    last += 1
                if rows["parts"][k] > 1:
                    row, at, window, done = distinct_windows(rows, k, last, covered)
                    cuts = np.append(np.arange(0, len(row), PACKED_WINDOWS), len(row))
                    packed = pa.ListArray.from_arrays(
                        pa.array(cuts, pa.int32()),
                        pa.StructArray.from_arrays(
                            [pa.array(c) for c in (row, at, window, done)], fields=list(one)
                        ),
                    )
                    n_rows = len(packed)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.nulls(n_rows, pa.int64()) for _ in range(3)],
                            pa.array(np.full(n_rows, rows["key"][k]), pa.int64()),
                            packed,
                        ],
                        columns,
                    )
                k = last
            i = j

    def run(batches):
        held = {name: [] for name in names}
        for batch in batches:
            for name in names:
                held[name] += batch.column(name).to_pylist()
            groups = list(zip(held["key"], held["part"]))
            end = len(groups)
            while end and groups[end - 1] == groups[-1]:
                end -= 1
            yield from solve({name: held[name][:end] for name in names})
            held = {name: held[name][end:] for name in names}
        yield from solve(held)

    one = pa.struct(
        [("row", pa.int64()), ("lo", pa.int64()), ("window", pa.int64()), ("done", pa.bool_())]
    )
    columns = ["row", "lo", "hi", "key", "windows"]
    names = ["row", "lo", "key", "part", "parts", "single", "bytes", "cells"]
    part = F.pmod(F.xxhash64("row", "lo"), F.col("parts"))
    grouped = (
        stretches.withColumn("part", part)
        .select(*names)
        .repartition("key", "part")
        .sortWithinPartitions("key", "part", "row", "lo")
    )
    return _mapped(grouped, run, SOLVED)


def _across_parts(solved: DataFrame, keep_first: bool) -> DataFrame:
    """Windows of groups solved in parts that are alone in their part but not in the group."""
    # Spread before they are unpacked: the windows of a large group come from a few tasks.
    windows = (
        solved.filter("key IS NOT NULL")
        .repartition(F.xxhash64("key", F.col("windows")[0]))
        .select("key", F.explode("windows").alias("w"))
        .select("key", "w.row", "w.lo", "w.window", "w.done")
    )
    place = F.struct("row", "lo")
    repeated = (
        windows.groupBy("key", "window")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .filter("n > 1")
    )
    # A window has one row per part at most, so no key is large here.
    found = windows.filter("NOT done").join(repeated, ["key", "window"])
    if keep_first:
        found = found.filter(place != F.col("first"))
    return found.select("row", "lo", F.col("lo").alias("hi"))


def _cut(docs: DataFrame, spans: DataFrame, width: int, with_text: bool) -> DataFrame:
    """Every document with its removed byte ranges and the digest of what is left."""

    def run(batches):
        for batch in _slices(batches):
            out = {name: [] for name in kinds}
            for packed, lo, hi in zip(
                *[batch.column(name).to_pylist() for name in ("packed", "lo", "hi")]
            ):
                text = _unpacked(packed)
                # Windows that overlap or touch make one run of bytes.
                first, last = _runs(
                    np.array(lo or (), np.int64), np.array(hi or (), np.int64) + width - 1
                )
                last = last + 1
                edges = [0, *np.stack([first, last], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(len(text) - len(kept))
                out["removed_from"].append(first)
                out["removed_to"].append(last)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("id"),
                    *[pa.array(out[name], kind) for name, kind in kinds.items()],
                ],
                ["row", "id", *kinds],
            )

    kinds = {
        "n_bytes": pa.int64(),
        "n_removed": pa.int64(),
        "removed_from": pa.list_(pa.int64()),
        "removed_to": pa.list_(pa.int64()),
        "kept_sha256": pa.string(),
        "kept": pa.binary(),
    }
    whole = _packed(docs).join(spans, "row", "left")
    return _mapped(
        whole.select("row", "id", "packed", "lo", "hi"),
        run,
        "row bigint, id bigint, n_bytes bigint, n_removed bigint, removed_from array<bigint>, "
        "removed_to array<bigint>, kept_sha256 string, kept binary",
    )


def repeated_windows(
    docs: DataFrame, width: int = WIDTH, keep_first: bool = False, max_group: int = MAX_GROUP
) -> DataFrame:
    """(row, lo, hi): ranges of windows of ``docs`` (row, text) that occur elsewhere, too."""
    local = _local(docs, width).withColumn("part", F.coalesce("key", F.xxhash64("row")))
    kind = Window.partitionBy("part", "digest")
    met = settle(
        local.withColumn("kind_n", F.sum("n").over(kind))
        .withColumn("place", F.row_number().over(kind.orderBy("row", "lo")))
        .withColumn(
            "kinds", F.sum((F.col("place") == 1).cast("bigint")).over(Window.partitionBy("part"))
        )
        .filter("local_lo IS NOT NULL OR (key IS NOT NULL AND (kind_n > 1 OR kinds > 1))")
        .drop("part", "n"),
        "stretches",
    )
    inside = met.filter("local_lo IS NOT NULL").select(
        "row", F.explode(F.arrays_zip("local_lo", "local_hi")).alias("r")
    )
    alike = met.filter("key IS NOT NULL AND kind_n > 1")
    if keep_first:
        alike = alike.filter("place > 1")
    single = F.lit(True) if keep_first else F.col("kind_n") == 1
    wanted = met.filter("key IS NOT NULL AND place = 1 AND kinds > 1").select(
        "row",
        "lo",
        "hi",
        "key",
        single.alias("single"),
        F.ceil(F.col("kinds") / max_group).cast("bigint").alias("parts"),
    )
    parted = settle(wanted.filter("parts > 1"), "parted")
    opened = parted.join(_open_cells(docs, parted, width), ["row", "lo"], "left")
    none = F.lit(None).cast("array<bigint>")
    wanted = wanted.filter("parts = 1").withColumn("cells", none).unionByName(opened)
    solved = settle(_lpf(_fetched(docs, wanted, width), width, keep_first), "solved")
    return (
        inside.select("row", F.col("r.local_lo").alias("lo"), F.col("r.local_hi").alias("hi"))
        .union(alike.select("row", "lo", "hi"))
        .union(solved.filter("key IS NULL").select("row", "lo", "hi"))
        .union(_across_parts(solved, keep_first))
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    keep_first: bool = False,
    with_text: bool = True,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """(id, n_bytes, n_removed, removed_from, removed_to, kept_sha256, kept) for every row.

    A byte is removed when a string of ``width`` bytes that covers it also starts anywhere else in
    the given texts, in the same one included; with ``keep_first`` the first place, in the order of
    the input, is kept. Texts are bytes of UTF-8, so a cut may fall inside a letter; NULL and empty
    texts have nothing to remove. Repeated rows repeat each other, so texts of ``width`` bytes or
    more go whole. NULL ids are carried along, other columns not looked at. An empty table gives an
    empty result. Stretches count as equal when 128 bits of hash are; ``width`` is between 128 and
    256.
    """
    if not 2 * ANCHOR <= width <= 256:
        raise ValueError("width must be between 128 and 256 bytes")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).alias("text"),
    )
    spans = (
        repeated_windows(rows, width, keep_first, max_group)
        .groupBy("row")
        .agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    )
    spans = settle(spans, "repeat-spans")
    return (
        _cut(rows, spans, width, with_text).drop("row").withColumnRenamed("id", id_col)
    )
