"""The n-gram Jaccard join against brute force."""

import re

import pytest
from tallyspark.llm.jaccard import jaccard_components

SCHEMA = "doc_id long, text string, sig string, tokens int"


def shingle_set(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * len(sets[i] | sets[j]):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, step):
    return " ".join(w if i % step else w + "x" for i, w in enumerate(words))


@pytest.fixture()
def rows():
    import random

    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(400)]
    texts = [None, "", "  \n\t", "One", "one", "one two three", "ONE Two three", "one two three four five", "é à É", "é à é"]
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([8, 30, 200, 600]))
        texts += [" ".join(base)] * 2
        for cut in (17, 29, 60, 200):
            texts += [edited(base, cut), edited(base[3:], cut), " ".join(base[:-cut // 10])]
    texts.append(" ".join(rng.choices(vocab, k=60000)))
    return list(enumerate(texts))


def test_components_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_chain_is_one_component(spark):
    words = ["t%d" % i for i in range(500)]
    rows = [(i, " ".join(words[i * 10:i * 10 + 300])) for i in range(20)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) == 1


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "a b c d e", None, None)] * 3 + [(3, "a b c d e", None, None), (None, "z y", None, None)], SCHEMA)
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(docs).where("doc_id IS NOT NULL").collect())
    assert got == [(3, 2, 3), (7, 2, 3), (7, 2, 3), (7, 2, 3)]
    assert jaccard_components(docs.limit(0)).count() == 0
