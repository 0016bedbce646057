"""Benchmark decontamination: planted items, changed slots, clean text."""

import random

import pytest
from tallyspark.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item_id string, windows int"
ITEM = ("A train leaves Boston at 9 and travels 120 miles toward Chicago while another train leaves Chicago at 11"
        " and travels toward Boston; how many hours pass before both trains meet near the river")


@pytest.fixture(scope="module")
def filler():
    rng = random.Random(1)
    vocab = ["%s%s" % (a, b) for a in "ba ke li no pu ra so ti ve wo".split() for b in "n r s t l m".split()]
    return lambda n: " ".join(rng.choices(vocab, k=n)).capitalize() + "."


def found(spark, texts, items, **kw):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    rows = dc.benchmark_matches(docs, bench, **kw).collect()
    kept = {r.doc_id for r in dc.decontaminate(docs, bench, **kw).collect()}
    assert kept == set(range(len(texts))) - {r.doc_id for r in rows}
    return {(r.doc_id, r.item_id): r for r in rows}


def test_verbatim_and_reparameterised(spark, filler):
    other = ITEM.replace("Boston", "Oslo").replace("Chicago", "New York").replace("120", "75.5").replace("miles", "km").replace("9", "four")
    mixed = ITEM.replace("toward Boston", "toward Paris")  # one name, two values: not this question
    texts = [filler(80) + " " + ITEM + " " + filler(50), filler(30) + "\n" + other + "\n" + filler(20), filler(9) + " " + mixed,
             filler(500), ITEM.upper()[:40], None, ""]
    got = found(spark, texts, [ITEM, filler(30), "", None, filler(40)])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0].changed == 0 and got[0, 0].matched == got[0, 0].windows
    assert got[1, 0].changed >= 6 and got[1, 0].slots >= 9


def test_short_items_and_passes(spark, filler, monkeypatch):
    monkeypatch.setattr(dc, "PASS_WINDOWS", 40)
    items = [filler(30) for _ in range(6)] + ["gravity pulls apples down"]
    texts = [filler(10) + " " + t + " " + filler(10) for t in items] + [filler(300), items[0] + " " + items[1]]
    got = found(spark, texts, items)
    assert set(got) == {(i, i) for i in range(7)} | {(8, 0), (8, 1)}


def test_share_of_an_item(spark, filler):
    item = filler(60)
    part = lambda n: " ".join(item.split()[:n])
    got = found(spark, [part(45) + " " + filler(20), part(20) + " " + filler(20), item * 40], [item])
    assert set(got) == {(0, 0), (2, 0)}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM, "x", 1), (1, ITEM, "x", 1), (None, ITEM, "x", 1)], SCHEMA)
    bench = spark.createDataFrame([(None, ITEM), (5, ITEM)], "item_id long, text string")
    assert dc.benchmark_matches(docs, bench).count() == 6
    assert dc.decontaminate(docs, bench).count() == 0
    assert dc.benchmark_matches(docs, bench.limit(0)).count() == 0 and dc.decontaminate(docs, bench.limit(0)).count() == 3
    assert dc.benchmark_matches(docs.limit(0), bench).count() == 0


def edited(rng, item, put, replaced):
    words = item.split()
    for _ in range(replaced):
        words[rng.randrange(len(words))] = "changed"
    for _ in range(put):
        words.insert(rng.randint(1, len(words) - 1), "added")
    return " ".join(words)


@pytest.mark.parametrize(("put", "replaced", "share"), [(1, 0, 0.98), (2, 0, 0.95), (0, 1, 0.98), (0, 2, 0.95), (1, 1, 0.95)])
def test_edited_items_of_the_given_benchmark(spark, filler, put, replaced, share):
    rng = random.Random(put * 10 + replaced)
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").collect()]
    texts = [filler(60) + " " + edited(rng, t, put, replaced) + " " + filler(40) for t in items]
    got = found(spark, texts, items)
    assert sum((i, i) in got for i in range(len(items))) >= share * len(items)
    assert all(texts[d] and items[i] == items[d] for d, i in got)


def test_chains_equal_a_plain_search():
    import functools

    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(150):
        item = rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64)
        text = np.concatenate([rng.integers(0, 4, 3), item[:5], rng.integers(0, 9, rng.integers(0, 3)), item[5:], [1, 2]]).astype(np.uint64)
        run, shift = min(dc.RUN, len(item)), int(rng.integers(-3, 6))

        @functools.cache
        def most(i, j):
            """Most places of chains of runs from item place i and text place j on."""
            if i >= len(item) or j >= len(text):
                return 0
            out = max(most(i + 1, j), most(i, j + 1))
            n = 0
            while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and abs(j - i - shift) <= dc.DRIFT:
                n += 1
                if n >= run:
                    out = max(out, n + most(i + n, j + n))
            return out

        at, to = dc.align(item, text, shift)
        assert len(at) == most(0, 0)
        assert (np.diff(at) > 0).all() and (np.diff(to) > 0).all() and (item[at] == text[to]).all()
        assert (np.abs(to - at - shift) <= dc.DRIFT).all()
