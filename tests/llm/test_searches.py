"""The searches and joins against brute force."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from seedsift.llm import lexical, parity, shingles
from seedsift.llm import negatives as hard
from seedsift.llm.lexical import ranked_search

from .data import documents, empty, prose, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Ranked lexical search -------------------------------------------------------------------------


def items(spark):
    given = [
        (1, prose(9, 30)),
        (2, "Word word WORD"),
        (3, None),
        (4, ""),
        (5, " .,; "),
        (6, "x" * 70_000 + " 日本語 don't"),
        (7, prose(25, 400)),
        (7, prose(25, 400)),
        (None, "ab word"),
    ]
    return given, spark.createDataFrame(given, "item_id bigint, text string").selectExpr(
        "*", "'clash' AS id", "'clash' AS item", "1 AS score"
    )


def plain_ranking(texts, item, k):
    terms = [(d, TERM.findall(lower(t))) for d, t in texts]
    terms = [(d, t) for d, t in terms if t]
    docs, length = len(terms), sum(len(t) for _, t in terms)
    df = Counter(t for _, own in terms for t in set(own))
    found = []
    for d, own in terms:
        tf, m = Counter(own), 75 + (25 * len(own) * docs) // length
        score = 0
        for t in TERM.findall(lower(item)):
            if tf[t]:
                w = math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
        if score > 0:
            found.append((-score, d is None, d))
    found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
    return [(n + 1, d, -s) for n, (s, _, d) in enumerate(found[:k])]


@pytest.mark.parametrize("block_terms", [100_000, 20])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "FULL", 50)
    given, frame = items(spark)
    got = ranked_search(documents(spark), frame, 6, block_terms=block_terms).collect()
    texts = [(d, t) for d, t, *_ in rows()]
    want = Counter((i, *row) for i, t in given for row in plain_ranking(texts, t, 6))
    assert Counter(map(tuple, ((r.item_id, r.rank, r.doc_id, r.score) for r in got))) == want
    assert {i for i, *_ in want} == {1, 2, 6, 7, None}


def test_ranked_search_of_nothing(spark):
    _, frame = items(spark)
    assert ranked_search(empty(spark), frame).count() == 0
    assert ranked_search(documents(spark), frame.limit(0)).count() == 0
    assert ranked_search(documents(spark), frame.filter("item_id = 5")).count() == 0


def test_pieces_cut_between_terms():
    text = ("ab12 é-日本語\tXy " + "q" * 700 + " . " + "w" * 300).encode() * 3
    whole = lexical.terms_of(text)
    for size in (1, 2, 7, 64, 1000):
        cut = [t for p, n in lexical.pieces(text, size) for t in p.split(b"\0") if t]
        assert cut == whole
        assert sum(n for _, n in lexical.pieces(text, size)) == len(whole)
    assert len(whole) == len(TERM.findall(text.decode()))


def test_long_texts_take_little_memory():
    text = (prose(3, 4000) + " ").encode() * 1500  # 40 MB
    finder = lexical.automaton([b"an", b"qu"])
    tracemalloc.start()
    n, hits = lexical.scan(text, finder)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4000 * 1500 and peak < 60 << 20
    assert hits[0] == 1500 * prose(3, 4000).split().count("an")


# Hard negatives --------------------------------------------------------------------------------


def embedded(spark, given):
    frame = spark.createDataFrame(given, "vec_id bigint, embedding array<double>, label int")
    return frame.selectExpr("*", "'clash' AS id", "'clash' AS key", "0 AS cluster").repartition(3)


def vectors(n, dims, seed, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dims))
    found = middle[rng.integers(6, size=n)] + spread * rng.normal(size=(n, dims))
    return found / 4


def plain_negatives(given, is_anchor, positives=5, negatives=10, scale=256):
    """Repeated rows and ties included; by row, since ids may repeat."""
    whole = []
    for row, (i, v, label) in enumerate(given):
        if i is None or v is None or label is None or len(v) != DIMS:
            continue
        if any(x is None or not math.isfinite(x) or abs(x) > 1e8 for x in v):
            continue
        whole.append((row, i, np.array([math.floor(scale * x) for x in v], object), label))
    out = []
    for row, i, v, label in whole:
        if not is_anchor(i):
            continue
        scored = sorted((-int((v * w).sum()), j, other != label) for r, j, w, other in whole if r != row)
        kin = [(j, -s) for s, j, differs in scored if not differs][:positives]
        for p, ps in kin:
            fits = [(j, -s) for s, j, differs in scored if differs and 30 * ps <= -100 * s <= 90 * ps]
            out += [(i, p, n + 1, j, ps, s) for n, (j, s) in enumerate(fits[:negatives])]
    return Counter(out)


DIMS = 6


def awkward_vectors():
    found = [(i, v.tolist(), i % 4) for i, v in enumerate(vectors(160, DIMS, 1, 0.3))]
    found += [(200 + i, v.tolist(), i % 3) for i, v in enumerate(vectors(60, DIMS, 2, 3.0))]
    same = found[3][1]
    found += [(300 + i, same, i % 2) for i in range(50)]  # a common vector in two labels
    found += [(300, same, 0), (300, same, 0), (300, found[5][1], 0)]
    found += [(400 + i, [0.0] * DIMS, i % 2) for i in range(4)]
    found += [(500, None, 1), (510, same, None), (None, same, 1), (520, [1.0] * 5, 1), (530, [], 1)]
    found += [(540, [None, *same[1:]], 1), (550, [math.nan, *same[1:]], 1), (560, [math.inf, *same[1:]], 0)]
    found += [(570, [1e300, *same[1:]], 0), (580, [-x for x in same], 1), (590, [-x for x in same], 0)]
    found += [(600, [5000.0] * DIMS, 2), (610, [5000.0] * DIMS, 3), (620, [4000.0] * DIMS, 3)]
    found += [(700, [1.0, *[0.0] * 5], 77)]  # the only row of its label
    return found


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # many lists, pieces and parts
        for name, size in (("CLUSTER_MEMBERS", 4), ("PIECE_ROWS", 16), ("PART_MEMBERS", 2), ("STEP", 4)):
            monkeypatch.setattr(hard, name, size)
    given = awkward_vectors()
    frame = embedded(spark, given)
    got = hard.hard_negatives(frame, frame.filter("vec_id % 10 = 0")).collect()
    want = plain_negatives(given, lambda i: i % 10 == 0)
    assert Counter(map(tuple, got)) == want and len({w[0] for w in want}) > 20


def test_hard_negatives_of_few_rows(spark):
    frame = embedded(spark, awkward_vectors())
    assert hard.hard_negatives(frame.limit(0), frame.limit(0)).count() == 0
    assert hard.hard_negatives(frame, frame.limit(0)).count() == 0
    given = [(0, [1.0] * DIMS, 1), (1, [0.9] * DIMS, 1), (2, [0.5] * DIMS, 2)]
    frame = embedded(spark, given)
    got = hard.hard_negatives(frame, frame.filter("vec_id = 0")).collect()
    assert Counter(map(tuple, got)) == plain_negatives(given, lambda i: i == 0) and len(got) == 1


def test_shared_lists_end_before_they_are_read_through():
    """Clustered members stop where the bound certifies that nothing can follow."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=40)
    middle /= np.linalg.norm(middle)
    members = np.floor(256 * (middle + 0.01 * rng.normal(size=(20, 40)))).astype(np.int64)
    others = rng.normal(size=(5000, 40))
    near = middle + 0.05 * rng.normal(size=(200, 40))
    vecs = np.floor(256 * np.concatenate([others / np.linalg.norm(others, axis=1)[:, None], near]))
    vecs = vecs.astype(np.int64)
    centre = hard.centres(members, 1, 0)
    angle = np.arccos(np.clip(hard.units(members) @ centre[0], -1, 1)).max()
    lists = hard.Lists(40, centre, np.array([angle + 1e-6]), np.linalg.norm(vecs, axis=1).max(), np.ones(1, int))
    bounds = lists.bounds(vecs)[:, 0]
    scores = vecs @ members.T
    lengths = np.linalg.norm(members, axis=1)
    assert (bounds[:, None] * lengths + 1e-6 * lists.longest * lengths >= scores).all()
    ids, labels = np.arange(len(vecs)), np.zeros(len(vecs), np.int64)
    asks = [[hard.Found(0, -hard.ANY, hard.ANY, -hard.ANY, 6)] for _ in members]
    taken = hard.walk(lists, bounds, vecs, ids, labels, members, np.zeros(20, np.int64), asks, True)
    for m, (found,) in enumerate(asks):
        best = np.lexsort((ids, -scores[:, m]))[:6]
        assert found.ids.tolist() == best.tolist()
    assert taken < scores.size / 4


# Jaccard join ----------------------------------------------------------------------------------


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def plain_components(given, percent=90):
    sets = {s: None for _, s in given if s}
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    order = list(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                root[find(a)] = find(b)
    first = {}
    for d, s in given:
        if s and d is not None:
            r = find(s)
            first[r] = min(first.get(r, d), d)
    return Counter((d, len(s), first.get(find(s)) if s else d) for d, s in given)


def edited(seed, text, share):
    rng = random.Random(seed)
    return " ".join(prose(rng.random(), 1) if rng.random() < share else w for w in text.split())


def near_copies():
    """Chains and groups in which similar pairs abound, but not all pairs are similar."""
    found = list(rows())
    n = 1000
    for words in (1, 2, 3, 9, 10, 12, 19, 20, 21, 40, 200, 900):
        base = prose(words, words)
        for i in range(14):
            text = edited(n, base, (0.0, 0.01, 0.03, 0.06)[i % 4])
            found.append((n, text if i % 5 else text.upper() + " \t", "en", "a"))
            n += 1
    text = prose(5, 300)
    for i in range(40):  # a chain: neighbours are similar, ends are not
        words = text.split()
        words[7 * i + 3] = "changed"
        text = " ".join(words)
        found.append((n, text, "en", "a"))
        n += 1
    return found


def test_jaccard_components_equal_brute_force(spark, monkeypatch):
    given = near_copies()
    want = plain_components([(d, plain_set(t)) for d, t, *_ in given])
    for hubs in (3, 1):
        monkeypatch.setattr(parity, "HUBS", hubs)
        monkeypatch.setattr(parity, "SEEN", 10 * hubs)
        monkeypatch.setattr(parity, "SENT_TEXTS", 50 if hubs == 1 else 1 << 20)
        monkeypatch.setattr(parity, "LOWEST", hubs)
        got = parity.jaccard_components(documents(spark, given)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert max(Counter(c for *_, c in want).values()) >= 20
    assert parity.jaccard_components(empty(spark)).count() == 0


def test_other_thresholds(spark):
    given = [r for r in near_copies() if r[0] and r[0] >= 1000]
    for percent in (75, 100):
        want = plain_components([(d, plain_set(t)) for d, t, *_ in given], percent)
        got = parity.jaccard_components(documents(spark, given), percent=percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_components_need_no_hubs(spark, monkeypatch):
    """The comparison across components finds by itself every link there is."""
    monkeypatch.setattr(
        parity, "_hub_pairs", lambda shared, nodes, percent: nodes.selectExpr("node AS a", "node AS b").limit(0)
    )
    given = near_copies()
    got = parity.jaccard_components(documents(spark, given)).collect()
    want = plain_components([(d, plain_set(t)) for d, t, *_ in given])
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (10, 50, 400):
        base = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        band = len(parity.bands(size, 90)) - 2
        d = parity.allowed(parity.bands(size, 90)[band + 1] - 1, 90)
        for gone in range(d + 1):
            other = np.unique(np.concatenate([base[gone:], base[:0]]))
            apart = np.bitwise_count(parity.fold(base).view(np.uint64) ^ parity.fold(other).view(np.uint64))
            assert apart.sum() <= gone
            keys = (parity.block_keys(x, band, d + 1) for x in (base, other))
            assert (np.equal(*keys)).any()
    lows = parity.bands(5000, 90)
    assert all(high > (low - 1) / 0.9 for low, high in zip(lows[1:], lows[2:]))


def test_pieces_of_a_text_hold_every_shingle_once():
    for text in (prose(1, 500), "a b", "one", "", " \n ", "x" * 300 + " y", prose(2, 40) + " " * 200):
        for size in (1, 5, 64, 1000):
            for words in (1, 2, 3, 5):
                whole = text.lower().encode().split()
                want = [b" ".join(whole[i : i + words]) for i in range(max(1, len(whole) - words + 1))]
                got = []
                for piece in shingles.pieces(text.encode(), words, size):
                    own = piece.split()
                    got += [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
                assert got == (want if whole else [])


def test_sets_of_long_texts_take_little_memory():
    text = (prose(3, 4000) + " ").encode() * 1500  # 40 MB
    tracemalloc.start()
    (found,) = parity.shingle_sets([text], 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(plain_set(prose(3, 4000) + " " + prose(3, 4000))) and peak < 250 << 20
