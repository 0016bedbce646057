"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their first five bytes, as 64-bit hashes; ASCII marks
separate words and A-Z count as a-z. The score is the logistic of
    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>
over the terms the model knows, so a pair such as an insult and a group can weigh more or less than
its two terms. The model learns terms whose share of toxic
documents differs beyond chance; linear weights are kept sparse by soft thresholding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import words
from tallyspark.llm.store import small_batches
from tallyspark.llm.training import fold, labelled_sample

#: Bytes of a prefix term; documents a term must occur in to be learnt.
PREFIX, LEAST_DOCS = 5, 3
#: Deviations from the mean share at which a term is learnt; terms of a model.
LEAST_Z, MOST_TERMS = 3.5, 8192
_SALT = np.uint64(0x5851F42D4C957F2D)


def term_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For blocks of texts: how many, and the (text number, term) pairs, with repeats."""
    data, offsets = words.utf8(column)
    for i, j in words.blocks(offsets):
        lo = offsets[i]
        part, at = data[lo:offsets[j]], offsets[i:j + 1] - lo
        starts, ends, first = words.word_spans(part, at, words.MARKS)
        owner = np.repeat(np.arange(j - i), np.diff(first))
        long = ends - starts > PREFIX
        head = words.span_hashes(part, starts[long], starts[long] + PREFIX) ^ _SALT
        yield j - i, np.concatenate([owner, owner[long]]), np.concatenate([words.span_hashes(part, starts, ends), head])


@dataclass(frozen=True)
class Machine:
    """A trained machine: sorted term hashes with linear weights and factors."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margins(self, n: int, owner: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Log-odds of n texts from (text number, term) pairs."""
        if not len(self.terms):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        pairs = np.unique(owner[known] * len(self.terms) + at[known])
        owner, at = pairs // len(self.terms), pairs % len(self.terms)
        v = self.factor[at]
        cross = np.zeros(n)
        for k in range(v.shape[1]):
            total = np.bincount(owner, v[:, k], n)
            cross += total * total - np.bincount(owner, v[:, k] ** 2, n)
        return self.bias + np.bincount(owner, self.weight[at], n) + cross / 2


def choose(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms whose share of toxic documents differs from that of the others beyond chance, sorted.

    Pairs are learnt among these: a term that matters in a pair shows by itself too, if less.
    """
    if not rows:
        return np.zeros(0, np.uint64)
    terms, at, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    toxic = np.bincount(at, np.repeat(labels, [len(r) for r in rows]), len(terms))
    p = labels.mean()
    z = (toxic - count * p) / np.sqrt(np.maximum(count * p * (1 - p) * (1 - count / (len(rows) + 1)), 1e-9))
    strong = np.flatnonzero((count >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z))
    strong = strong[np.argsort(-np.abs(z[strong]), kind="stable")[:MOST_TERMS]]
    return np.sort(terms[strong])


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 8, epochs: int = 60, rate: float = 0.5,
        sparse: float = 1e-4, decay: float = 1e-4, batch: int = 256, seed: int = 7) -> Machine:
    """Train on each document's distinct term hashes by minibatch AdaGrad."""
    labels = np.asarray(labels, float)
    terms = choose(rows, labels)
    p = (labels.sum() + 1) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    bias, gbias = float(np.log(p / (1 - p))), 1e-6
    n = len(terms)
    w, gw = np.zeros(n), np.full(n, 1e-3)  # a start above zero holds terms still that hardly matter
    v, gv = rng.normal(0, 0.01, (n, factors)), np.full((n, factors), 1e-2)
    if not n:
        return Machine(terms, bias, w, v)
    known = []
    for r in rows:
        at = np.minimum(np.searchsorted(terms, r), n - 1)
        known.append(at[terms[at] == r])
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), batch):
            take = order[i:i + batch]
            at = np.concatenate([known[k] for k in take])
            owner = np.repeat(np.arange(len(take)), [len(known[k]) for k in take])
            own, spot = np.unique(at, return_inverse=True)
            x = v[at]
            sums = np.stack([np.bincount(owner, x[:, k], len(take)) for k in range(factors)], axis=1)
            squares = np.stack([np.bincount(owner, x[:, k] ** 2, len(take)) for k in range(factors)], axis=1)
            z = bias + np.bincount(owner, w[at], len(take)) + (sums ** 2 - squares).sum(axis=1) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]) / len(take)
            slope = np.bincount(spot, g[owner], len(own))
            gw[own] += slope ** 2
            step = rate / np.sqrt(gw[own])
            moved = w[own] - step * slope
            w[own] = np.sign(moved) * np.maximum(np.abs(moved) - step * sparse, 0)
            pull = g[owner][:, None] * (sums[owner] - x)
            slope = np.stack([np.bincount(spot, pull[:, k], len(own)) for k in range(factors)], axis=1) + decay * v[own]
            gv[own] += slope ** 2
            v[own] -= rate * 0.3 * slope / np.sqrt(gv[own])
            gbias += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gbias)
    return Machine(terms, bias, w, v)


def train(docs: DataFrame, labels: DataFrame, limit: int = 12000) -> Machine:
    """Fit on at most `limit` labelled documents outside fold 0; their terms are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, owner, terms in term_rows(batch.column("text")):
                order = np.argsort(owner, kind="stable")
                out += [np.unique(x).view(np.int64) for x in np.split(terms[order], np.searchsorted(owner[order], np.arange(1, n)))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "label", "terms"])

    sample = labelled_sample(docs, labels, "toxic", limit).mapInArrow(run, "doc_id long, label int, terms array<long>")
    rows = sample.toArrow().sort_by("doc_id")
    terms = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in rows.column("terms")]
    return fit(terms, rows.column("label").to_numpy())


def toxicity_scores(docs: DataFrame, labels: DataFrame, limit: int = 12000, threshold: float = 0.5) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    docs: doc_id, text and others, which are never inputs. Null and empty texts get the score of no
    known term; repeated rows and null ids (held out) stay. With no labels every score is 0.5. An empty
    table gives an empty table. The model is broadcast with the task: its terms are bounded by `limit`.
    """
    small_batches(docs.sparkSession)
    model = train(docs, labels, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [model.margins(*block) for block in term_rows(batch.column("text"))]
            z = np.concatenate(margins) if margins else np.zeros(0)
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
