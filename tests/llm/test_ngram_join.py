"""The n-gram join against brute force."""

import random
import re

import numpy as np
import pytest

from beaconry.llm import ngram_join
from beaconry.llm.ngram_join import SignatureTree, keep_one, similar_groups

SCHEMA = "doc_id long, text string, lang string, n long, h1 string"


def shingles(text, k):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, s):
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}
    find = lambda i: i if parent[i] == i else find(parent[i])
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= s * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(a), None if i is None else find(i)) for i, a in sets), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "x" * 300]
    line = " ".join(rng.choices(words, k=12))
    docs = []
    for _ in range(60):
        docs.append(" ".join(rng.choices(words, k=rng.randint(1, 60))) + (f"\n{line}" if rng.random() < 0.5 else ""))
    for _ in range(60):  # copies with edits, so that chains of links form
        t = rng.choice(docs[-40:]).split(" ")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        docs.append(" ".join(t))
    docs += ["", None, "  \t", "one", "ONE", "one two", "One two", docs[3], docs[3].upper(), " ".join(words * 40), " ".join(words * 40) + " end"]
    return [(i * 3, t) for i, t in enumerate(docs)] + [(None, docs[3]), (9, docs[3])]


@pytest.mark.parametrize("k, s", [(3, 90), (5, 80), (2, 60)])
def test_groups_equal_brute_force(spark, k, s):
    docs = corpus(k)
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in docs], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(df, k, s).collect()), key=str)
    assert got == brute(docs, k, s)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    docs = corpus(9)
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in docs], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(df, 3, 80).collect()), key=str)
    assert got == brute(docs, 3, 80)


def test_one_of_each_group_stays(spark):
    docs = [(i, t) for i, t in corpus(2)[:-2]]
    df = spark.createDataFrame([(i, t, "en", i, "x") for i, t in docs] + [(0, docs[0][1], "en", 0, "x")], SCHEMA)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(docs, 5, 80)})


def test_empty_table(spark):
    assert similar_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_finds_what_pairs_find():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 62, 50, dtype=np.uint64) for _ in range(12)]
    sets = []
    for _ in range(150):
        b = base[rng.integers(12)].copy()
        edits = int(rng.integers(0, 12))
        b[rng.choice(50, edits, replace=False)] = rng.integers(0, 1 << 62, edits, dtype=np.uint64)
        sets.append(np.unique(b))
    tree = SignatureTree(sets, 80)
    tree.join(list(range(len(sets))))
    other = SignatureTree(sets, 80)
    for i in range(len(sets)):
        for j in range(i):
            if other.similar(i, j):
                other.links.join(i, j)
    assert [tree.links.find(i) for i in range(len(sets))] == [other.links.find(i) for i in range(len(sets))]
