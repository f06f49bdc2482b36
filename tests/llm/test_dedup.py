import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from seedsift.llm import repeats, simhash
from seedsift.llm.blockname import exact_dedup
from seedsift.llm.graph import contract
from seedsift.llm.repeats import matched_windows, remove_repeats
from seedsift.llm.simhash import close_pairs, fingerprints, simhash_components
from seedsift.llm.suffix import longest_previous_factors
from seedsift.llm.xxh64 import hash_slices

from .data import documents, empty, prose, rows


def test_xxh64_equals_the_library():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (*range(70), 200, 1000)]
    data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)
    sizes = np.array([len(p) for p in parts])
    found = hash_slices(data, np.cumsum(sizes) - sizes, sizes, 42)
    assert found.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def test_fingerprints_of_long_texts_are_counted_in_pieces(monkeypatch):
    import tracemalloc

    text = prose(4, 3000)
    monkeypatch.setattr(simhash, "CHUNK_BYTES", 500)
    some = [text.encode(), b"", b" \n", b"one", b"one two", text.upper().encode()]
    assert fingerprints(some).tolist() == [plain_fingerprint(t.decode()) for t in some]
    monkeypatch.undo()
    long = (text + " ").encode() * 2000  # 40 MB
    tracemalloc.start()
    fingerprints([long])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                root[find(b)] = find(a)
    return {k: find(k) for k in keys}


def test_simhash_equals_brute_force(spark):
    given = rows()
    got = simhash_components(documents(spark)).collect()
    prints = [(d, plain_fingerprint(t)) for d, t, *_ in given]
    roots = components({f for _, f in prints}, lambda a, b: (a ^ b).bit_count() <= 2)
    first = defaultdict(list)
    for doc, f in prints:
        if doc is not None:
            first[roots[f]].append(doc)
    want = sorted(
        (repr(d), f"{f:016x}", min(first[roots[f]], default=None)) for d, f in prints
    )
    assert sorted((repr(r[0]), r[1], r[2]) for r in got) == want
    assert len({r.component_id for r in got}) < len({r.fingerprint for r in got}) < len(got)
    assert simhash_components(empty(spark)).count() == 0


def test_fingerprint_of_few_words():
    assert fingerprints([b"", b" \n"]).tolist() == [0, 0]
    assert fingerprints([b"A  b"]).tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]


@pytest.mark.parametrize("max_bits", [1, 2, 3])
def test_no_close_pair_is_missed(spark, max_bits):
    rng = random.Random(max_bits)
    found = {rng.getrandbits(64) for _ in range(30)}
    for f in list(found):
        for _ in range(6):
            found.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [int(np.uint64(f).view(np.int64)) for f in found]
    got = close_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint"), max_bits)
    pairs = [(r.a, r.b) for r in got.collect()]
    want = {
        (a, b)
        for a in signed
        for b in signed
        if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits
    }
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and want


def test_components_of_chain_star_and_ring(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(50)]
    ring = [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    edges = spark.createDataFrame(chain + star + ring + [(5000, 5000)], "a bigint, b bigint")
    roots = {r.node: r.root for r in contract(edges).collect()}
    groups = defaultdict(set)
    for node, root in roots.items():
        groups[root].add(node)
    assert sorted(map(len, groups.values())) == [9, 51, 61]
    assert contract(edges.limit(0)).count() == 0


@pytest.mark.parametrize("block_bytes", [7, 16 << 10])
def test_exact_dedup_equals_brute_force(spark, block_bytes):
    given = rows()
    got = exact_dedup(documents(spark), block_bytes=block_bytes).collect()
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in given]
    groups = defaultdict(list)
    for (doc, text, *_), p in zip(given, plain):
        groups[p].append((-len(text or ""), doc is None, doc or 0, doc))
    want = Counter(
        (d, min(groups[p])[3], len(groups[p]), hashlib.sha256(p.encode()).hexdigest())
        for (d, *_), p in zip(given, plain)
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(empty(spark)).count() == 0


def test_longest_previous_factors():
    rng = random.Random(3)
    for letters, n in ((b"ab", 60), (b"abc", 150), (b"a", 80), (b"q", 1)):
        data = bytes(rng.choices(letters, k=n))
        length, source = longest_previous_factors(np.frombuffer(data, np.uint8))
        for i in range(n):
            best = max(
                (next((k for k in range(n - i) if data[j + k] != data[i + k]), n - i), -j)
                for j in range(i)
            )[0] if i else 0
            assert length[i] == best
            assert not best or data[source[i] :][:best] == data[i:][:best] and source[i] < i
    assert len(longest_previous_factors(np.zeros(0, np.uint8))[0]) == 0


def test_matches_do_not_cross_parts():
    text = bytes(range(1, 251))
    whole, front, back = text, text[:120], text[120:]
    assert [len(w) for w in matched_windows([front, back, whole], 200, False)] == [0, 0, 0]
    assert [len(w) for w in matched_windows([whole, whole], 200, False)] == [51, 51]
    assert [len(w) for w in matched_windows([whole, whole], 200, True)] == [0, 51]


def brute_repeats(texts, keep_first):
    count, seen, out = Counter(), set(), []
    for t in texts:
        count.update(t[i : i + 200] for i in range(len(t) - 199))
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - 199):
            w = t[i : i + 200]
            if w in seen if keep_first else count[w] > 1:
                covered[i : i + 200] = b"\1" * 200
            seen.add(w)
        runs = [m.span() for m in re.finditer(b"\1+", bytes(covered))]
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out.append((runs, kept))
    return out


@pytest.mark.parametrize("max_group", [1000, 2])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_equal_brute_force(spark, keep_first, max_group):
    given = documents(spark).filter("doc_id IS NOT NULL").repartitionByRange(3, "doc_id", "text")
    given = given.sortWithinPartitions("doc_id", "text").filter("octet_length(text) < 60000")
    local = given.select("doc_id", "text").collect()
    want = brute_repeats([(r.text or "").encode() for r in local], keep_first)
    got = remove_repeats(given, keep_first=keep_first, max_group=max_group).collect()
    found = sorted(
        (r.doc_id, list(zip(r.removed_from, r.removed_to)), bytes(r.kept), r.kept_sha256)
        for r in got
    )
    assert found == sorted(
        (r.doc_id, runs, kept, hashlib.sha256(kept).hexdigest())
        for r, (runs, kept) in zip(local, want)
    )
    assert any(runs for runs, _ in want)


@pytest.mark.parametrize("size", [150, 195, 230])
def test_a_passage_in_ever_new_surroundings(spark, monkeypatch, size):
    """Solved in many parts; windows go on only where their cells are open."""
    rng = random.Random(size)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(rng.choices(letters, k=size))
    some = []
    for i in range(400):
        before, after = ("".join(rng.choices(letters, k=150 + i % 90)) for _ in "xy")
        some.append((i, before + passage + after, "en", "a"))
    some[7] = (7, some[9][1][5:], "en", "a")
    given = documents(spark, some).repartitionByRange(3, "doc_id")
    local = given.select("doc_id", "text").collect()
    want = brute_repeats([r.text.encode() for r in local], False)
    sent = []
    across = repeats._across_parts
    monkeypatch.setattr(
        repeats,
        "_across_parts",
        lambda solved, keep_first: sent.append(
            solved.filter("key IS NOT NULL").selectExpr("sum(size(windows))").first()[0] or 0
        )
        or across(solved, keep_first),
    )
    got = remove_repeats(given, max_group=20).collect()
    assert sorted((r.doc_id, bytes(r.kept)) for r in got) == sorted(
        (r.doc_id, kept) for r, (_, kept) in zip(local, want)
    )
    if size == 150:  # no window of 200 bytes lies in the passage
        assert sent[0] < 1000  # of 55,000


def test_repeats_in_long_null_and_no_texts(spark):
    from .data import prose

    passage = prose(5, 50)
    long = prose(6, 800_000)
    assert len(long.encode()) > 4 << 20
    given = documents(
        spark,
        [
            (1, long[:3_000_000] + passage + long[3_000_000:], "en", "a"),
            (2, "A" + passage, "en", "a"),
            (3, None, "en", "a"),
        ],
    )
    got = {r.doc_id: r for r in remove_repeats(given).collect()}
    assert bytes(got[2].kept) == b"A"
    assert got[1].n_removed == len(passage.encode()) and bytes(got[1].kept) == long.encode()
    assert (got[3].n_bytes, got[3].n_removed, got[3].removed_from) == (0, 0, [])
    assert remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(given, width=100)
