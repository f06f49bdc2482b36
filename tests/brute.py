"""Plain Python versions of the semantics, for small fixtures only."""

from __future__ import annotations

import math
from collections import Counter


def log(x):
    return math.log(x) if x > 0 else (-math.inf if x == 0 else math.nan)


def div(a, b):
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)


def xlogx(x):
    return x * log(x)


def gain(p, n, nc, total):
    pc, pt = div(nc, total), div(p + n, total)
    return (
        -xlogx(pc)
        - xlogx(1 - pc)
        + pt * (xlogx(div(p, p + n)) + xlogx(div(n, p + n)))
        + (1 - pt)
        * (
            xlogx(div(nc - p, total - (p + n)))
            + xlogx(div(total - (nc + n), total - (p + n)))
        )
    )


def java_hash(term):
    h = 0
    for ch in term:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h


def table_order(keys):
    """Keys in the order of a Java hash table they were put into one after the other."""
    keys = list(keys)
    capacity = 16
    while len(keys) > 0.75 * capacity:
        capacity *= 2
    slot = {k: (java_hash(k) ^ (java_hash(k) >> 16)) & (capacity - 1) for k in keys}
    return sorted(keys, key=lambda k: slot[k])  # stable: insertion order inside a slot


def table_places(texts, labels):
    """(klass, term, place): the order in which such a table hands out the terms of each class."""
    found = []
    for klass, docs in labels.items():
        keys = dict.fromkeys(t for d in sorted(docs) for t in texts[d].split(" "))
        found += [(klass, t, i) for i, t in enumerate(table_order(keys))]
    return found


def learn(texts, labels, mode="local", order=sorted):
    """{klass: {term: (total, log_likelihood, gain)}} from {doc: text} and {klass: [doc, ...]}."""
    pos = {k: Counter() for k in labels}
    for klass, docs in labels.items():
        for doc in sorted(docs):
            pos[klass].update(texts[doc].split(" "))
    every = sum(pos.values(), Counter())
    start = running = sum(len(d) for d in labels.values())
    model = {}
    for klass in sorted(labels):
        model[klass] = {}
        for term in order(pos[klass]):
            if len(term) < 3:
                continue
            p, n, nc = pos[klass][term], every[term] - pos[klass][term], len(labels[klass])
            unseen = n == 0
            running += unseen
            total = running if mode == "sequential" else start + unseen
            n, nc = n + unseen, nc + unseen
            ll = log(p) - log(nc) - log(n) + log(total - nc)
            model[klass][term] = (total, ll, gain(p, n, nc, total))
    return model


def ranking(model):
    """Terms by score, NaN first, ties by term."""

    def key(term):
        score = model[term][2]
        return (0, 0, term) if math.isnan(score) else (1, -score, term)

    return sorted(model, key=key)


def posting_scores(texts, model, n):
    best = ranking(model)[:n]
    scores = {}
    for doc, text in texts.items():
        hits = [model[t][1] for t in best if t in set(text.split())]
        if hits:
            scores[doc] = 0.0
            for hit in hits:  # plain additions, in the order of the ranks
                scores[doc] += hit
    return scores


def break_even(golds, n_gold):
    """(p, r, f1) of a ranked list of gold flags, by walking along it."""
    tp, at = 0, None
    p = r = f1 = 0.0
    for position, gold in enumerate(golds, 1):
        tp += gold
        p, r = div(tp, position), div(tp, n_gold)
        f1 = 2 * tp / (position + n_gold) if tp else math.nan
        if r != 0 and r >= p and at is None:
            at = (p, r, f1)
    if at is None:
        p, r = div(tp, len(golds)), div(tp, n_gold)
        at = (p, r, 2 * tp / (len(golds) + n_gold) if tp else math.nan)
    return at


def active_learning(texts, ids, gold, seeds, n_features, key, batch, nan_last=False):
    """Rounds of one class: [(n_train, n_pos, n_neg, p, r, f1)]."""
    labelled = dict(seeds)
    tests = [d for d in texts if ids[d].startswith("test/")]
    n_gold = sum(gold[d] for d in tests)
    rounds = []
    while True:
        classes = {0: [d for d in labelled if labelled[d]], 1: [d for d in labelled if not labelled[d]]}
        model = learn(texts, classes)[0]
        scores = posting_scores(texts, model, n_features)
        ranked = sorted((d for d in tests if d in scores), key=lambda d: (-scores[d], ids[d]))
        at = break_even([gold[d] for d in ranked], n_gold)
        rounds.append((len(labelled), len(classes[0]), len(classes[1]), *at))
        free = [d for d in scores if ids[d].startswith("training/") and d not in labelled]
        if not free:
            return rounds
        free.sort(key=lambda d: (key(scores[d]), ids[d]))
        for d in free[: len(labelled) if batch == "double" else batch]:
            labelled[d] = gold[d]
