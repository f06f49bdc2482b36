import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedsift.llm import mixer, network, wordvectors
from seedsift.llm.classifier import held_out, keep_quality, score_quality, train_quality
from seedsift.llm.lm import score_texts, train_model

from .data import documents, empty, prose, rows


def junk(seed, words):
    rng = random.Random(seed)
    if seed % 2:
        return " ".join(w.upper() + "!!" for w in prose(seed, words).split())
    return " ".join(" ".join([w] * rng.randint(8, 20)) for w in prose(seed, words // 10).split())


def labelled(spark, n=700):
    some = [
        (i, (junk if i % 5 == 0 else prose)(i, 60 + i % 90), "en", "a") for i in range(n)
    ]
    labels = spark.createDataFrame(
        [(i, int(i % 5 != 0), 0) for i in range(n)] + [(None, 1, 0), (3, None, 1), (10**9, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    return some, documents(spark, some), labels


def test_quality_on_the_held_out_fold(spark):
    some, docs, labels = labelled(spark)
    model = train_quality(docs, labels)
    got = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert len(got) == len(some)
    aside = [i for i, *_ in some if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == set(aside)
    right = sum(got[i].predicted == int(i % 5 != 0) for i in aside)
    assert right / len(aside) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    kept = keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {
        i for i, r in got.items() if r.predicted
    }
    # The same text gets the same score, whatever its row.
    twin = docs.withColumn("doc_id", F.col("doc_id") + 5000).withColumn("source", F.lit(None))
    again = {r.doc_id: r.score for r in score_quality(twin, model).collect()}
    assert again == {i + 5000: r.score for i, r in got.items()}


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(4, 1), (7, 0), (9, 1), (11, 0)], "doc_id bigint, quality int")
    model = train_quality(docs, labels)
    got = score_quality(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in rows())
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert score_quality(empty(spark), model).count() == 0
    nothing = train_quality(empty(spark), labels.limit(0))
    assert {r.score for r in score_quality(docs, nothing).collect()} == {0.5}


def test_words_and_pooling():
    texts = [b"", b"ab, ab", b" ", "é1".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bucket, text = wordvectors.words(data, np.cumsum([len(t) for t in texts]))
    assert text.tolist() == [1, 1, 1, 3, 3] and bucket[0] == bucket[2] != bucket[1]
    vectors = np.random.default_rng(0).normal(size=(1 << wordvectors.BUCKETS_LOG2, wordvectors.DIMS))
    found = wordvectors.pooled(vectors.astype(np.float32), bucket, text, 4)
    assert not found[0].any() and not found[2].any()
    assert np.allclose(found[1, : wordvectors.DIMS], vectors[bucket[:3]].mean(0), atol=1e-5)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = (x[:, 0] + rng.normal(size=3000) > 0).astype(float)
    aside = np.arange(3000) % 5 == 0
    net = network.fit(x, y, aside)
    z = net.logits(x[aside])
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - y[aside] * z / t)
    assert loss(net.temperature) <= loss(1.0)


def plain_base(given):
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in given}
    aside = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not aside[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        i: (
            aside[i],
            len(ws),
            sum(w in counts for w in ws),
            n,
            sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws),
        )
        for i, ws in tokens.items()
    }


def test_language_model_base_equals_counting(spark):
    given = [r for r in {r[0]: r for r in rows()}.values() if r[0] is not None]
    docs = documents(spark, given)
    got = score_texts(docs, train_model(docs)).collect()
    want = plain_base(given)
    assert len(got) == len(given)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_language_model_of_awkward_tables(spark):
    docs = documents(spark)
    got = score_texts(docs, train_model(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in rows())
    assert score_texts(empty(spark), train_model(docs)).count() == 0
    blank = train_model(empty(spark))
    assert all(r.base_score == 0 and r.n_known == 0 for r in score_texts(docs, blank).collect())


def small_tables(texts):
    counts = Counter(w for t in texts for w in [*t.lower().split(), mixer.END])
    head = {w: n for w, n in counts.items() if n > 1}
    rest = sum(n for n in counts.values() if n == 1)
    h = mixer.Head.of(list(head), list(head.values()), rest)
    code = mixer.Code.of(np.ones(256))
    tokens = mixer.Tokens(texts, h)
    a, b = np.zeros(mixer.HEAD_COUNTERS, np.int64), np.zeros(mixer.LETTER_COUNTERS, np.int64)
    mixer.add_head_counts(a, h, tokens)
    mixer.add_letter_counts(b, h, tokens, code)
    return mixer.Tables(h, code, a, b)


def test_mixer_learns_and_decides_without_looking_ahead():
    texts = [prose(i % 7, 120).encode() for i in range(60)]
    tables = small_tables(texts)
    learned = mixer.learn_mixer(tables, texts[:30])
    new = [prose(3, 120).encode(), b"never seen 42", b""]
    before = mixer.log_probabilities(tables, mixer.Mixer(), mixer.Tokens(new, tables.head))
    after = mixer.log_probabilities(tables, learned, mixer.Tokens(new, tables.head))
    assert after[0] > before[0] and (after < 0).all()
    # A text's probability does not depend on what else is in the chunk, and falls as it goes on.
    alone = [
        mixer.log_probabilities(tables, learned, mixer.Tokens([t], tables.head))[0] for t in new
    ]
    assert np.allclose(alone, after, rtol=1e-4)


def test_each_text_moves_its_own_weights_for_words_and_letters():
    texts = [prose(i % 7, 120).encode() for i in range(60)]
    tables = small_tables(texts)
    learned = mixer.learn_mixer(tables, texts[:30])
    strange = " ".join(f"{a}zq{b}xj" for a, b in zip(prose(500, 400).split(), prose(501, 400).split()))
    new = [strange.encode(), prose(3, 300).encode(), f"{prose(4, 100)} {strange[:900]}".encode()]
    got = mixer.log_probabilities(tables, learned, mixer.Tokens(new, tables.head))
    for text, score in zip(new, got):
        tokens = mixer.Tokens([text], tables.head)
        stream = mixer.Stream(tables, tokens)
        weights = [w.astype(np.float64) for w in learned.weights]
        bends = [c.astype(np.float64) for c in learned.correction]
        want = 0.0
        for i in range(0, len(tokens.ids), mixer.BLOCK_TOKENS):
            parts = stream.of(i, min(i + mixer.BLOCK_TOKENS, len(tokens.ids)))
            for w, c, part in zip(weights, bends, parts):
                w_step, c_step = np.zeros_like(w), np.zeros_like(c)
                for x, gate, sign in zip(*part):
                    z = w[gate] @ x
                    level = mixer._level(z * sign)
                    lost = np.exp(-(z + c[gate, level] * sign))
                    want -= np.log1p(lost)
                    w_step[gate] += mixer.RATE * lost / (1 + lost) * x
                    c_step[gate, level] += mixer.RATE * lost / (1 + lost) * sign
                w += w_step
                c += c_step
        assert score == pytest.approx(want, rel=2e-5)


def test_first_weights_are_one_newton_step_over_all_decisions():
    texts = [prose(i % 7, 90).encode() for i in range(40)]
    tables = small_tables(texts[:20])
    total = np.zeros(mixer.MOMENTS, np.int64)
    for some in (texts[20:23], texts[23:]):
        mixer.add_moments(total, tables, mixer.Tokens(some, tables.head))
    got = mixer.first_mixer(total.astype(np.float64))
    tokens = mixer.Tokens(texts[20:], tables.head)
    parts = mixer.Stream(tables, tokens).of(0, len(tokens.ids))
    for start, found, (x, gate, _) in zip(mixer.Mixer().weights, got.weights, parts):
        for g, w in enumerate(start.astype(np.float64)):
            rows = x[gate == g].astype(np.float64)
            error = 1 / (1 + np.exp(rows @ w))
            curve = (rows * (error * (1 - error))[:, None]).T @ rows
            step = np.linalg.solve(curve + mixer.RIDGE * np.eye(len(w)), error @ rows)
            assert found[g] == pytest.approx(w + step, abs=1e-3)


def test_long_texts_teach_the_first_weights_too(spark):
    texts = [prose(i, 4000) for i in range(6)]
    assert min(map(len, texts)) > 16 << 10  # a sample of shorter texts taught them before
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    learned = train_model(docs).mixer.weights
    assert any(not np.allclose(w, s, atol=1e-3) for w, s in zip(learned, mixer.Mixer().weights))


def test_words_of_a_chunk_are_those_between_white_space():
    texts = [b"", b" ", b"A b", b"\n a\t\tB\x0b\x0cb\r", "É é\x85x\u00a0y".encode(), b"a\x1cb\x00c \xff a"]
    tokens = mixer.Tokens(texts)
    words, ids = tokens.words.to_pylist(), tokens.ids.tolist()
    assert len(set(words)) == len(words)
    for text, first, n in zip(texts, tokens.starts, tokens.sizes):
        assert [words[i] for i in ids[first : first + n]] == [*text.lower().split(), mixer.END]
    assert len(mixer.Tokens([]).ids) == 0


def test_first_weights_look_up_what_repeats_once(monkeypatch):
    texts = [f"{prose(1, 30)} rare words once ".encode() * 50] * 4
    tables = small_tables([prose(i % 7, 90).encode() for i in range(20)])
    looked, found = [], mixer.head_slots

    def counted(*given):
        looked.append(len(found(*given)[0]))
        return found(*given)

    monkeypatch.setattr(mixer, "head_slots", counted)
    tokens = mixer.Tokens(texts, tables.head)
    mixer.add_moments(np.zeros(mixer.MOMENTS, np.int64), tables, tokens)
    assert sum(looked) < len(tokens.ids)


def test_scores_hold_the_letters_of_a_long_text_piece_by_piece(monkeypatch):
    tables = small_tables([prose(i % 7, 90).encode() for i in range(20)])
    held, build = [], mixer.Letters.__init__

    def measured(self, *given):
        build(self, *given)
        held.append(len(self.bit))

    monkeypatch.setattr(mixer.Letters, "__init__", measured)
    text = b" ".join(b"xq%dzj" % i for i in range(100_000))
    mixer.log_probabilities(tables, mixer.Mixer(), mixer.Tokens([text], tables.head))
    assert max(held) < sum(held) / 4


def test_token_probabilities_add_up_to_one():
    tables = small_tables([b"a b a b a c c", b"a b d d"])
    head = tables.head
    # All paths of the head code, other words included, from one and the same context.
    total = 0.0
    for k in range(len(head.size)):
        tokens = mixer.Tokens([b"a"], head)
        tokens.place[:] = k
        x, gate, sign, _ = tables.head_inputs(tokens, np.array([0]))
        z = (mixer.Mixer().weights[0][gate] * x).sum(1)
        total += np.exp(-np.log1p(np.exp(-z)).sum())
    assert total == pytest.approx(1, rel=1e-6)


def test_held_out_rule(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id bigint")
    for row in ids.select("doc_id", held_out("doc_id").alias("h")).collect():
        want = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 4 == 2
        assert row.h == want
