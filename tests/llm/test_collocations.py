"""Phrase mining against brute force, the double array against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import collocations as C

SCHEMA = "doc_id long, lang string, text string, n int, phrase string"


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", text)]


def brute(rows, least=30, top=2000, longest=4):
    out = {}
    f = {}
    total = Counter()
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for p in pieces(text):
            total[lang or "und"] += len(p)
            for k in range(1, longest + 1):
                own.update(tuple(p[i:i + k]) for i in range(len(p) - k + 1))
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {q[i:i + k] for q, b in cand.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * b >= 80 * cand[q[i:i + k]]}
        best = []
        for p, a in cand.items():
            if p not in gone:
                score, _, le, r = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), le, r))
        for i, (s, a, p, le, r) in enumerate(sorted(best)[:top]):
            out[lang, i + 1] = (p.decode(), -a, le, r, total[lang], -s)
    return out


def result(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def corpus():
    rng = random.Random(5)
    rows = [(None, None), ("en", None), ("en", ""), (None, "a b\tc  d"), ("x", ".,;:!?\n\r\x0b\x0c")]
    idioms = ["New York City council", "as well as", "la la la la la", "état de l'art", "x y z", "in IN In in"]
    vocab = [f"w{i}" for i in range(25)]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 40)):
            words.append(rng.choice(idioms) if rng.random() < 0.3 else rng.choice(vocab))
            words.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]))
        rows.append((rng.choice(["en", "en", "fr", None]), "".join(words)))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"TRIE_PHRASES": 7, "DICTIONARY": 9}])
@pytest.mark.parametrize("least,top", [(5, 2000), (30, 3)])
def test_equals_brute_force(spark, monkeypatch, sizes, least, top):
    for name, value in sizes.items():
        monkeypatch.setattr(C, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(i, lang, t, 0, "clash") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    got, want = result(C.collocations(docs, least, top)), brute(rows, least, top)
    assert len(want) >= (6 if top == 3 else 40) and got == want


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()])
    got = result(C.collocations(docs))
    assert len(want) > 100 and got == want


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, "en", "only once here", 0, "")], SCHEMA)).count() == 0


def test_longer_phrases_hide_shorter_ones(spark):
    rows = [("en", "red green blue sky") for _ in range(40)] + [("en", "green blue") for _ in range(10)]
    got = result(C.collocations(spark.createDataFrame([(i, *r, 0, "") for i, r in enumerate(rows)], SCHEMA)))
    assert [v[0] for v in got.values()] == ["red green blue sky"]  # 40 of 50 is eighty in a hundred


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_trie_equals_dictionary(depth):
    rng = np.random.default_rng(depth)
    phrases = np.unique(rng.zipf(1.4, (4000, depth)) % 900 + 1, axis=0).astype(np.int32)
    text = (rng.zipf(1.4, 60000) % 900 + 1) * (rng.random(60000) < 0.9)
    at, row = C.Trie(phrases).walk(text.astype(np.int32))
    index = {tuple(p): i for i, p in enumerate(phrases.tolist())}
    want = [(i, index[t]) for i in range(len(text) - depth + 1) if (t := tuple(text[i:i + depth].tolist())) in index]
    assert list(zip(at.tolist(), row.tolist())) == want


def test_words_and_squeeze():
    words, opens, at = C.words_of(pa.array(["Aé  b,c", None, "", " D.\n e"]))
    assert words.to_pylist() == ["aé", "b", "c", "d", "e"] and opens.tolist() == [True, False, True, True, True]
    assert at.tolist() == [0, 3, 3, 3, 5]
    assert C.squeeze(np.array([5, 6, 7, 0, 8, 9, 3]), np.array([1, 0, 1, 0, 0, 0, 1], bool)).tolist() == [5, 6, 0, 8, 9, 0]
