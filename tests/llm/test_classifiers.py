"""Quality field and toxicity machine: held-out accuracy, exact inference, edge cases."""

import itertools
import zlib

import numpy as np
import pytest
from tallyspark.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, label int, quality int, toxic int"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 5, 8])
    unary, link = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, z = quality.chain(unary, link, first)
    pairs = np.zeros((2, 2))
    for k in range(3):
        part = unary[first[k]:first[k + 1]]
        weights, seen, both = [], np.zeros(len(part)), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=len(part)):
            w = np.exp(sum(u * s for u, s in zip(part, states)) + sum(link[a, b] for a, b in zip(states, states[1:])))
            weights.append(w)
            seen += w * np.array(states)
            for a, b in zip(states, states[1:]):
                both[a, b] += w
        assert np.allclose(good[first[k]:first[k + 1]], seen / sum(weights))
        assert np.isclose(z[k], np.log(sum(weights)))
        pairs += both / sum(weights)
    assert np.allclose(pair, pairs)


def test_lines_of_texts():
    texts = [b"", b"ab\n\ncd\n", b"x", b"\n"]
    offsets = np.cumsum([0, *map(len, texts)])
    x, size, first = quality.line_features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert first.tolist() == [0, 1, 4, 5, 6] and size.tolist() == [1, 3, 1, 3, 1, 1] and len(x) == 6


@pytest.mark.parametrize(("module", "column", "least"), [("quality", "quality", 0.97), ("toxicity", "toxic", 0.94)])
def test_held_out_accuracy(spark, module, column, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    score = quality.quality_scores if module == "quality" else toxicity.toxicity_scores
    rows = score(docs, labels).join(labels, "doc_id").where("held_out").select("doc_id", "predicted", column).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r[column] for r in rows]) >= least


def test_pairs_weigh_more_than_their_terms():
    """Only insult and group together are toxic; each alone is common."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(3000):
        terms = set(rng.integers(100, 400, 20).tolist())
        insult, group = rng.random(2) < 0.4
        terms |= ({1} if insult else set()) | ({2} if group else set())
        rows.append(np.array(sorted(terms), np.uint64))
        labels.append(int(insult and group))
    model = toxicity.fit(rows[:2000], np.array(labels[:2000]))
    z = np.array([model.margins(1, np.zeros(len(r), int), r)[0] for r in rows[2000:]])
    assert np.mean((z > 0) == (np.array(labels[2000:]) == 1)) > 0.97
    i, j = np.searchsorted(model.terms, [1, 2])
    assert model.factor[i] @ model.factor[j] > 0.1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, module):
    docs = spark.createDataFrame([(1, None, "s", 1, 1, 1), (1, None, "s", 1, 1, 1), (None, "", "s", 1, 1, 1), (3, "word " * 50000, "s", 1, 1, 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    score = module.quality_scores if module is quality else module.toxicity_scores
    rows = score(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert score(docs.limit(0), labels).count() == 0
    assert {r.score for r in score(docs, labels.limit(0)).collect()} == {0.5}
