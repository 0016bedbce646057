"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of letters, capitals, digits, marks and
bars, word lengths, repeated neighbouring words and the like, of itself and of its two neighbours.
Forward-backward gives each line its probability of being good; these, weighted by line length, and
a logistic step on their mean give the document's score.

Labels are of documents, so lines start with their document's label; lines of bad documents that the
field itself takes for good are then learnt as good (the worst line of a bad document stays bad).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm import words
from tallyspark.llm.store import small_batches
from tallyspark.llm.training import fold, labelled_sample

#: Kinds of bytes that are counted, two to a 64-bit lookup.
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?", b"!", b"|<>{}[]", b"#$%&*+=@^_~/\\`", b" ", bytes(range(128, 256))]
_PAIRS = [np.zeros(256, np.uint64) for _ in range(4)]
for _k, _set in enumerate(_KINDS):
    _PAIRS[_k // 2][list(_set)] += np.uint64(1) << np.uint64(32 * (_k % 2))


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their weights in bytes, and each text's first line; every text has a line at least."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.union1d(breaks, offsets[:-1])
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    # texts without bytes still have one line
    empty = np.flatnonzero(np.diff(offsets) == 0)
    owner = np.concatenate([np.searchsorted(offsets, starts, "right") - 1, empty])
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    ends = np.minimum(ends, offsets[1:][owner[:len(starts)]])
    starts = np.concatenate([starts, offsets[empty]]).astype(np.int64)
    ends = np.concatenate([ends, offsets[empty]]).astype(np.int64)
    order = np.lexsort((starts, owner))
    starts, ends, owner = starts[order], ends[order], owner[order]
    size = ends - starts
    counts = np.zeros((len(starts), len(_KINDS)))
    full = size > 0
    if full.any():
        for k, table in enumerate(_PAIRS):
            both = np.add.reduceat(table[data], starts[full])
            counts[full, 2 * k] = both & np.uint64(0xFFFFFFFF)
            counts[full, 2 * k + 1] = both >> np.uint64(32)
    spans, stops, _ = words.word_spans(data, np.append(starts[full], len(data)))
    h = words.span_hashes(data, spans, stops)
    line = np.searchsorted(starts[full], spans, "right") - 1
    n = np.bincount(line, minlength=int(full.sum()))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    long = stops - spans
    total = np.zeros((4, len(starts)))
    total[0, full] = n
    total[1, full] = np.bincount(line, same, int(full.sum()))
    total[2, full] = np.bincount(line, long, int(full.sum()))
    total[3, full] = np.bincount(line, long > 18, int(full.sum()))
    word = np.maximum(total[0], 1)
    body = np.maximum(size, 1)
    x = np.column_stack([
        counts[:, 0] / body, counts[:, 1] / body, counts[:, 2] / word, counts[:, 3] / word, counts[:, 4] / word,
        counts[:, 5] / word, counts[:, 6] / body, counts[:, 7] / body, total[1] / word, total[2] / word / 8, total[3] / word,
        np.log1p(total[0]) / 5, size == 0, total[0] <= 2,
    ])
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    head = np.append(True, owner[1:] != owner[:-1])
    tail = np.append(owner[1:] != owner[:-1], True)
    before[head] = 0
    after[tail] = 0
    first = np.searchsorted(owner, np.arange(len(offsets)))
    return np.column_stack([x, before, after, head, tail]), np.maximum(size, 1), first


def blocks_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = words.utf8(column)
    for i, j in words.blocks(offsets):
        yield line_features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def chain(unary: np.ndarray, link: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once: P(good) of each line, sums of pair marginals, log partitions.

    unary: log-odds of good for each line; link[a, b]: log-weight of state a before b (0 bad, 1 good);
    chains are lines first[k] to first[k + 1], one at least.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    base = first[:-1][order]
    live = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), "left")  # chains longer than t
    score = np.column_stack([np.zeros(len(unary)), unary])
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    for t in range(len(live)):
        at = base[:live[t]] + t
        if t == 0:
            forward[at] = score[at]
        else:
            prev = forward[at - 1]
            forward[at] = score[at] + np.logaddexp(prev[:, :1] + link[0], prev[:, 1:] + link[1])
    for t in range(len(live) - 2, -1, -1):
        at = base[:live[t + 1]] + t
        nxt = backward[at + 1] + score[at + 1]
        backward[at] = np.logaddexp(nxt[:, :1] + link[:, 0], nxt[:, 1:] + link[:, 1])
    end = forward[first[1:] - 1]
    z = np.logaddexp(end[:, 0], end[:, 1])
    zline = np.repeat(z, length)
    good = np.exp(forward[:, 1] + backward[:, 1] - zline)
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    later = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair[a, b] = np.exp(forward[later - 1, a] + link[a, b] + score[later, b] + backward[later, b] - zline[later]).sum()
    return good, pair, z


@dataclass(frozen=True)
class Field:
    """A trained field: feature scale, weights, transitions, and the logistic step to a document's score."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    link: np.ndarray
    step: tuple[float, float]

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        unary = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight[1:] + self.weight[0]
        return chain(unary, self.link, first)[0]

    def documents(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.step[0] + self.step[1] * shares(self.lines(x, first), size, first)
        return 1 / (1 + np.exp(-z))


def shares(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities, document by document."""
    return np.add.reduceat(good * size, first[:-1]) / np.add.reduceat(size, first[:-1])


def _descend(gradient, w: np.ndarray, rounds: int, rate: float = 0.1) -> np.ndarray:
    """Adam."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = 60, relabel: int = 2) -> Field:
    """Train on documents given by their lines; labels are 1 for good documents."""
    if not len(labels):
        return Field(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1), np.zeros((2, 2)), (0.0, 0.0))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    u = np.column_stack([np.ones(len(x)), ((x - mean) / scale).clip(-8, 8)])
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    state = labels[doc].astype(float)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    later = np.flatnonzero(inner)
    w = np.zeros(u.shape[1] + 4)
    for turn in range(relabel + 1):
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[later - 1].astype(int), state[later].astype(int)), 1)

        def gradient(w: np.ndarray) -> np.ndarray:
            good, pair, _ = chain(u @ w[:-4], w[-4:].reshape(2, 2), first)
            g = np.concatenate([u.T @ (good - state), (pair - seen).ravel()]) / len(labels)
            return g + 1e-3 * w

        w = _descend(gradient, w, rounds)
        good = chain(u @ w[:-4], w[-4:].reshape(2, 2), first)[0]
        if turn < relabel:
            worst = np.minimum.reduceat(good, first[:-1])[doc]
            state = np.where(labels[doc] == 1, 1.0, ((good > 0.5) & (good > worst)).astype(float))
    field = Field(mean, scale, w[:-4], w[-4:].reshape(2, 2), (0.0, 0.0))
    share = shares(good, size, first)

    def slope(s: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(s[0] + s[1] * share, -30, 30)))
        return np.array([(p - labels).mean(), ((p - labels) * share).mean()]) + 1e-4 * s

    s = _descend(slope, np.zeros(2), 600)
    return Field(field.mean, field.scale, field.weight, field.link, (float(s[0]), float(s[1])))


def train(docs: DataFrame, labels: DataFrame, limit: int = 2000) -> Field:
    """Fit on at most `limit` labelled documents outside fold 0; line features are made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, sizes = [], []
            for x, size, first in blocks_of(batch.column("text")):
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    xs.append(x[a:b].astype(np.float32).tobytes())
                    sizes.append(size[a:b])
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("label"), pa.array(xs, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))],
                names=["doc_id", "label", "x", "size"])

    sample = labelled_sample(docs, labels, "quality", limit).mapInArrow(run, "doc_id long, label int, x binary, size array<long>")
    rows = sample.toArrow().sort_by("doc_id")
    sizes = [s.values.to_numpy(zero_copy_only=False) for s in rows.column("size")]
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    x = np.frombuffer(b"".join(v.as_py() for v in rows.column("x")), np.float32).reshape(-1, width).astype(float)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(np.int64)
    return fit(x, np.concatenate(sizes) if sizes else np.zeros(0), first, rows.column("label").to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, limit: int = 2000, threshold: float = 0.3) -> DataFrame:
    """Score every whole text: all columns of docs, and held_out, score, predicted.

    Only text is an input of a score. Null and empty texts are one empty line; repeated rows and null
    ids (held out) stay; without labels every score is 0.5; an empty table gives an empty table;
    columns named held_out, score or predicted are replaced. The field is a few dozen numbers.
    """
    small_batches(docs.sparkSession)
    field = train(docs, labels, limit)
    own = docs.drop("held_out", "score", "predicted")
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [field.documents(*block) for block in blocks_of(batch.column("text"))]
            yield batch.append_column("score", pa.array(np.concatenate(score) if score else np.zeros(0)))

    return own.mapInArrow(run, schema).withColumns({
        "held_out": fold() == 0, "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})
