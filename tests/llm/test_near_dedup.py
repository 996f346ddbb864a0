"""op2: signatures estimate (weighted) Jaccard; classes equal those of brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from gleanspark.llm import near_dedup as nd


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    return out


def classes(texts, threshold=0.8):
    s, parent = sets(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= threshold:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed, groups, copies, edits):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    texts = [None, "", "  \n", "one two", "one two", "ONE  two", "x"]
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, copies)):
            new = list(base)
            for _ in range(rng.randint(0, edits)):
                new[rng.randrange(len(new))] = word()
            texts.append(" ".join(new + passage * rng.choice((0, 0, 1))))
    return texts


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    a, b = np.arange(1, 401, dtype=np.uint64), np.arange(101, 501, dtype=np.uint64)
    wa, wb = rng.uniform(0.1, 4, 400), rng.uniform(0.1, 4, 400)
    for x, y in (((a, np.ones(400)), (b, np.ones(400))), ((a, wa), (b, wb)), ((a[:7], wa[:7]), (a[2:9], wb[:7]))):
        w = [dict(zip(k.tolist(), v.tolist(), strict=True)) for k, v in (x, y)]
        keys = w[0].keys() | w[1].keys()
        true = sum(min(w[0].get(k, 0), w[1].get(k, 0)) for k in keys) / sum(max(w[0].get(k, 0), w[1].get(k, 0)) for k in keys)
        s = nd.signatures(np.concatenate([x[0], y[0]]), np.array([0, len(x[0]), len(x[0]) + len(y[0])]), 2000, 5, np.concatenate([x[1], y[1]]))
        assert abs((s[0] == s[1]).mean() - true) < 0.05


def test_signature_does_not_depend_on_neighbours():
    e = np.arange(1, 300, dtype=np.uint64)
    both = nd.signatures(np.concatenate([e[:9], e]), np.array([0, 9, 9 + len(e)]), 64)
    assert np.array_equal(both[0], nd.signatures(e[:9], np.array([0, 9]), 64)[0])
    assert np.array_equal(both[1], nd.signatures(e, np.array([0, len(e)]), 64)[0])


@pytest.mark.parametrize(("small", "broadcast_nodes"), [(32, 1000), (2, 0)])
def test_equals_brute_force(spark, small, broadcast_nodes):
    texts = corpus(1, 25, 9, 5) + corpus(2, 1, 90, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(4)
    got = {r.doc_id: r.class_id for r in nd.near_classes(docs, small=small, broadcast_nodes=broadcast_nodes).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def test_dedup_keeps_one_row(spark):
    rows = [(1, "a b c d e f", "p"), (1, "a b c d e f", "q"), (None, "a b c d e f", "r"), (2, None, "s"), (2, None, "s"), (3, "z", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string")
    got = nd.near_dedup(docs).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == [(1, "a b c d e f"), (3, "z")]
    assert sum(r.text is None for r in got) == 2 and set(got[0].asDict()) == {"doc_id", "text", "first"}
    assert nd.near_dedup(docs.limit(0)).count() == 0
