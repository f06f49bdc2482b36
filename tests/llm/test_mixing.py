import zlib
from collections import Counter, defaultdict

import pytest

from seedsift.llm.interleave import interleaved_shards, write_shards
from seedsift.llm.mixing import mixed_documents, mixture

from .data import documents, empty, rows


@pytest.mark.parametrize("n_shards", [1, 5, 24])
def test_shards_hold_rows_and_mixture_in_proportion(spark, n_shards):
    given = rows()
    got = interleaved_shards(documents(spark), n_shards, carry=["source", "text"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in given)
    for r in got:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    counts = [len(shards[s]) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(given)
    for found in shards.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    # Interleaving keeps each source within two rows of its share of a shard.
    share = Counter(s for *_, s in given)
    for found in shards.values():
        for source, n in share.items():
            here = sum(r.source == source for r in found)
            assert abs(here - n * len(found) / len(given)) <= 2


def test_shards_are_repeatable_and_may_be_empty(spark):
    def place(rows):
        return sorted((repr(r.doc_id), r.size, r.shard, r.slot) for r in rows.collect())

    assert place(interleaved_shards(documents(spark))) == place(
        interleaved_shards(documents(spark).repartition(7))
    )
    assert interleaved_shards(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        interleaved_shards(documents(spark), 0)


def test_written_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    write_shards(documents(spark), path, 4, carry=["text"])
    back = spark.read.parquet(path)
    assert back.count() == len(rows()) and set(back.columns) >= {"shard", "slot", "text"}


def targets(sizes, share=1.5, cap=2.0):
    """Water filling, one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, budget = {}, set(names), share * sum(sizes.values())
    while left:
        level = budget / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > cap * sizes[s]}
        for s in over or left:
            target[s] = cap * sizes[s] if over else level * weight[s]
        budget -= sum(target[s] for s in over)
        left -= over or left
    return target


def test_mixture_equals_water_filling(spark):
    given = rows()
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, text, _, source in given:
        sizes[source] += size(text)
    want = targets(sizes)
    got = mixture(documents(spark)).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == Counter(
        (d, size(t), sizes[s], round(want[s], 6)) for d, t, _, s in given
    )
    assert all(r.taken == r.size * r.copies and r.copies <= 2 for r in got)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mixture(empty(spark)).count() == 0


def test_mixture_comes_near_its_targets_and_repeats(spark):
    some = [(i, "w " * (1 + i % 40), "en", "abcde"[min(i % 9, 4)]) for i in range(4000)]
    got = mixture(documents(spark, some)).collect()
    taken, want = Counter(), {}
    for (_, _, _, source), r in zip(some, sorted(got, key=lambda r: r.doc_id)):
        taken[source] += r.taken
        want[source] = r.target
    for source in want:
        assert taken[source] == pytest.approx(want[source], rel=0.08)
    again = mixture(documents(spark, some).repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    emitted = mixed_documents(documents(spark, some))
    assert emitted.columns == documents(spark, some).columns
    assert Counter(r.doc_id for r in emitted.select("doc_id").collect()) == Counter(
        {r.doc_id: r.copies for r in got if r.copies}
    )


def test_sources_without_words_take_nothing(spark):
    some = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y", "en", None)]
    got = {r.doc_id: r for r in mixture(documents(spark, some)).collect()}
    assert (got[1].target, got[1].taken, got[2].taken) == (0, 0, 0)
    assert got[3].target == pytest.approx(3)


@pytest.mark.parametrize("n_shards", [24, 7, 1])
def test_every_row_stands_where_sorting_all_rows_puts_it(spark, n_shards):
    """The placement itself, by plain sorts over all rows; only the draws come from Spark."""
    drawn = documents(spark).selectExpr(
        "doc_id",
        "octet_length(coalesce(text, '')) + 8 AS size",
        "crc32(CAST(coalesce(text, '') AS BINARY)) AS crc",
        "source",
    )
    drawn = drawn.selectExpr(
        "*", "xxhash64(doc_id, crc, CAST(size AS BIGINT), 17) AS draw"
    ).collect()

    def tail(r):
        return (r.draw, r.doc_id is not None, r.doc_id or 0, r.size, r.crc)

    sources = {}
    for r in drawn:
        sources.setdefault((r.source is None, r.source or ""), []).append(r)
    rows = []
    for source, own in sources.items():
        own.sort(key=lambda r: ((r.draw % 2**64) >> 52, tail(r)))
        rows += [((rank + 0.5) / len(own), source, tail(r), r) for rank, r in enumerate(own)]
    rows.sort(key=lambda x: x[:3])
    want = []
    for place, (*_, r) in enumerate(rows):
        shard = place * n_shards // len(rows)
        slot = place - (shard * len(rows) + n_shards - 1) // n_shards
        want.append((repr(r.doc_id), r.size, r.crc, shard, slot))
    got = interleaved_shards(documents(spark), n_shards).collect()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(want)
