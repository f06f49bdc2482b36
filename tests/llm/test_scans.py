import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seedsift.llm import bpe, kdtree, licences
from seedsift.llm.intmap import IntMap
from seedsift.llm.neighbours import nearest_neighbours

from .data import documents, empty, prose, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "<|endoftext|>",
    "a<|endoftext|> b  \n\n c\t  x",
    "don't we'll 'S 1234²½ ⅷ\u0085z",
    "x" * 3000,
    "a" * 60 + " " * 70,
    "\x1c\x1d \x00 q ᠎​\xa0é",
    "日本語テキスト 🎉🎉 אבג",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(2)
    noise = ["".join(chr(rng.choice((32, 97, 98, 233, 8364, 33, 10))) for _ in range(60)) for _ in range(40)]
    return [t or "" for _, t, *_ in rows()] + ODD + noise + [prose(i, 40) for i in range(30)]


def test_encoding_equals_the_library(library):
    for text, ids in zip(texts(), bpe.encode_texts(texts(), PATH)):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.codec(PATH).decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_short_and_long_merging_agree():
    c = bpe.codec(PATH)
    pieces = [prose(i, 1).encode() * (1 + i % 3) for i in range(200)] + [b"a" * 40, b"abab" * 10]
    assert c.merged(pieces) == [c._merged_long(p) for p in pieces]


def test_speculation_is_mostly_verified_not_merged(monkeypatch):
    c = bpe.Codec(PATH)
    merged = []
    original = c._merged_short
    monkeypatch.setattr(c, "_merged_short", lambda p: merged.extend(p) or original(p))
    pieces = [b" the", b" of", b" and", b" house", b"ing", b" water"]
    assert c.encode_pieces(pieces) == original(pieces) and not set(pieces) & set(merged)


def test_encoding_job(spark, library):
    docs = documents(spark)
    encoded = bpe.bpe_encode(docs, PATH)
    back = bpe.bpe_decode(encoded, PATH).collect()
    by_text = {}
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect():
        by_text.setdefault(r.doc_id, []).append(r.t)
    assert len(back) == len(rows())
    assert all(r.decoded in by_text[r.doc_id] for r in back)
    got = bpe.bpe_digests(docs, PATH).collect()
    want = sorted(
        (
            repr(d),
            len(ids := library.encode(t or "", add_special_tokens=False).ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest(),
        )
        for d, t, *_ in rows()
    )
    assert sorted((repr(r[0]), *r[1:]) for r in got) == want
    assert bpe.bpe_digests(empty(spark), PATH).count() == 0


def test_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 5)
    first = bpe.digests(["a b c d e f g h", "h g f"], PATH)
    assert first == bpe.digests(["a b c d e f g h", "h g f"], PATH)


def test_intmap():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    found = IntMap(keys, np.arange(len(keys)), -7)
    assert (found.get(keys) == np.arange(len(keys))).all()
    assert (found.get(keys + (1 << 41)) == -7).all() and len(found.get(keys[:0])) == 0


def brute_best(words, threshold):
    own = licences.bigrams(words)
    found = [
        (licences.dice(own, licences.bigrams(licences.normalised(t))), name)
        for name, t in licences.TEMPLATES.items()
    ]
    score = max(s for s, _ in found)
    return (min(n for s, n in found if s == score), score) if score >= threshold else None


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_size_bounds_lose_no_template(threshold):
    rng = random.Random(4)
    table = licences.Templates(licences.TEMPLATES, threshold)
    for text in licences.TEMPLATES.values():
        for _ in range(12):
            words = licences.normalised(text)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = rng.choices(["x", "the", "license"], k=rng.randint(0, 2))
                words = words or ["x"]
            assert table.best(words) == brute_best(words, threshold)


def test_licence_scan(spark):
    mit = licences.TEMPLATES["MIT notice"]
    some = [
        (1, f"{prose(1, 200)}\nReleased under the MIT License.\n{prose(2, 50)}", "en", "a"),
        (2, "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70)), "en", "a"),
        (3, f"{prose(3, 30)}\n\n{mit[:300]}\n{mit[300:]}\n\n{prose(4, 30)}", "en", "a"),
        (4, "Licensed under CC BY-NC 4.0.", "en", "a"),
        (5, None, "en", "a"),
        (6, "", "en", "a"),
        (7, prose(7, 3000), "en", "a"),
        (None, "RELEASED under  the 'MIT' license", None, None),
    ]
    got = {r.doc_id: r for r in licences.licence_scan(documents(spark, some)).collect()}
    assert (got[1].licence, got[1].unit, got[1].unit_number) == ("MIT", "line", 1)
    assert (got[2].licence, got[2].unit) == ("MIT notice", "text")
    assert (got[3].licence, got[3].unit, got[3].unit_number) == ("MIT notice", "paragraph", 1)
    assert (got[4].licence, got[4].dice) == ("CC-BY-NC-4.0", 1.0)
    assert got[None].licence == "MIT"
    assert [(got[i].licence, got[i].n_matches) for i in (5, 6, 7)] == [(None, 0)] * 3
    assert licences.licence_scan(empty(spark)).count() == 0
    assert licences.licence_scan(documents(spark)).count() == len(rows())


def brute_window(words, templates, threshold):
    """The best coefficient of any template and any run of words."""
    grams = [licences.bigrams(licences.normalised(t)) for t in templates.values()]
    best = max(
        (
            licences.dice(licences.bigrams(words[i:j]), g)
            for i in range(len(words))
            for j in range(i + 1, len(words) + 1)
            for g in grams
        ),
        default=0,
    )
    return best if best >= threshold else None


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_windows_lose_no_run_of_words(threshold):
    templates = {"a": "a b c a b d a b", "b": "b c d e f", "c": "a b", "d": "c", "e": "e f e f e f e"}
    rng = random.Random(9)
    for chosen in (templates, {k: v for k, v in templates.items() if k in "be"}):
        table = licences.Templates(chosen, threshold)
        for _ in range(60):
            words = rng.choices("abcdefgh", k=rng.randint(0, 25))
            found = table.windows(words)
            assert (found[0][1] if found else None) == brute_window(words, chosen, threshold)
            spans = sorted((i, j) for _, _, i, j in found)
            assert all(j <= i for (_, j), (i, _) in zip(spans, spans[1:]))
            for name, score, i, j in found:
                own = licences.bigrams(licences.normalised(chosen[name]))
                assert score == licences.dice(licences.bigrams(words[i:j]), own)


def test_licences_inside_longer_lines_and_paragraphs(spark):
    apache = licences.TEMPLATES["Apache-2.0 notice"]
    comment = "\n".join(f"# {apache[i : i + 60]}" for i in range(0, len(apache), 60))
    code = "\n".join(f"import module_{i}" for i in range(400))
    short = "Licensed under the Apache License, Version 2.0."
    some = [
        (1, f"Copyright 2020 The Foo Authors. {short}", "en", "a"),
        (2, "Copyright 2020 Foo. Released under the MIT License.", "en", "a"),
        (3, f"{prose(1, 5)} {short}", "en", "a"),
        (4, f"{prose(2, 900)} {licences.TEMPLATES['MIT notice']} {prose(3, 900)}", "en", "a"),
        (5, f"{code}\n{comment}\n{code}", "en", "a"),
        (6, f"{prose(5, 40)} Licensed under\nthe Apache License,\nVersion 2.0. {prose(6, 40)}", "en", "a"),
        (7, prose(7, 500), "en", "a"),
    ]
    got = {r.doc_id: r for r in licences.licence_scan(documents(spark, some)).collect()}
    assert [got[i].licence[:3] for i in range(1, 7)] == ["Apa", "MIT", "Apa", "MIT", "Apa", "Apa"]
    assert all(got[i].dice >= 0.8 and got[i].unit == "window" for i in range(1, 7))
    before = len(licences.normalised(prose(2, 900)))
    assert (got[4].unit_number, got[7].licence) == (before, None)


@pytest.mark.parametrize(
    "text, licence",
    [
        ("Licensed under the MIT License.", "MIT"),
        ("This project is licensed under the MIT License.", "MIT"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("Licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("You may use it under the BSD 3-Clause License.", "BSD-3-Clause"),
        ("This is released under CC0 1.0.", "CC0-1.0"),
        (licences.TEMPLATES["AGPL-3.0 program"], "AGPL-3.0"),
        (licences.TEMPLATES["LGPL-2.1 library"], "LGPL-2.1"),
        (licences.TEMPLATES["Unlicense notice"], "Unlicense"),
        ("Released under the MIT License.", "MIT"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        *[(f"{prose(8, 50)}\n{t}\n{prose(9, 50)}", n[:-5]) for n, t in licences.FULL_TEXTS.items()],
    ],
)
def test_common_licences_are_known(text, licence):
    found = licences.scan(text, licences.Templates(licences.default_templates(), 0.8))
    best = min(found, key=lambda f: (-f[1], f[0]))
    assert best[0].split()[0] == licence and best[1] >= 0.8


def brute_neighbours(data, k):
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


def vectors(spark, data):
    return spark.createDataFrame(
        [(i, v, "clash", "clash") for i, v in data],
        "vec_id bigint, embedding array<float>, key string, block string",
    ).repartition(3)


def test_chi_square():
    assert kdtree.chi_square(kdtree.chi_square_quantile(0.9)) == pytest.approx(0.9)
    rng = np.random.default_rng(0)
    drawn = (rng.normal(size=(20000, kdtree.PROJECTED)) ** 2).sum(1)
    assert kdtree.chi_square(np.quantile(drawn, 0.5)) == pytest.approx(0.5, abs=0.02)


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[:200] *= 3  # lengths differ
    x[700:900] = x[700]  # one vector many times
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    rows = vectors(spark, data)
    got = {}
    found = nearest_neighbours(rows, rows.filter("vec_id % 20 = 0"), block_rows=256).collect()
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_neighbours([(i, np.float32(v)) for i, v in data], 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    by_id = {i: np.asarray(v, np.float64) for i, v in data}
    for q, answers in got.items():
        assert len(answers) == 20 and q not in {i for i, _ in answers}
        assert answers == sorted(answers, key=lambda a: (-a[1], a[0]))
        for i, score in answers:
            assert score == (by_id[q] * by_id[i]).sum()


@pytest.mark.parametrize("block_rows", [16_384, 300])
def test_ties_go_to_the_smaller_id(spark, block_rows):
    """Vectors of -1 and 1 have few different scores: most lists end within a tie."""
    rng = np.random.default_rng(8)
    x = rng.choice([-1.0, 1.0], size=(1500, 16))
    ids = rng.permutation(1500).tolist()
    data = [(i, v.tolist()) for i, v in zip(ids, x)]
    rows = vectors(spark, data)
    # So sure a test that nothing is left out: what differs then is the order of ties.
    found = nearest_neighbours(
        rows, rows.filter("vec_id % 20 = 0"), confidence=0.999999, block_rows=block_rows
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_neighbours(data, 20)


def test_neighbours_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.0]),
        (0, [1.0, 0.0]),
        (1, [0.5, 0.5]),
        (20, None),
        (40, [0.0, 0.0]),
        (60, [nan, 1.0]),
        (80, [inf, 1.0]),
        (100, [None, 1.0]),
        (120, [1.0]),
        (140, [0.0, 2.0]),
        (None, [1.0, 1.0]),
    ]
    rows = vectors(spark, data)
    got = nearest_neighbours(rows, rows.filter("vec_id % 20 = 0")).collect()
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)
    own = [(0, 1, 0, 1.0), (0, 2, 1, 0.5), (0, 3, 140, 0.0)]
    other = [(140, 1, 1, 1.0), (140, 2, 0, 0.0), (140, 3, 0, 0.0)]
    assert found == sorted(own * 2 + other)
    assert nearest_neighbours(rows.limit(0), rows.limit(0)).count() == 0
