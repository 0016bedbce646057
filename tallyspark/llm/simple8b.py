"""Token files in Simple-8b: varying counts of ids per 64-bit word.

A word's low 4 bits select how many ids it holds and how wide they are; the other 60 bits hold
them, first id lowest. Selector 15 is the escape: the next word is one raw 64-bit value. Ids are
cut into runs of RUN ids; each run starts a new word and its word offset is stored, so that runs can
be decoded apart and a whole block at once with array operations.

A file is one partition of a Parquet table; each row is a block of whole documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import encoder
from tallyspark.llm.store import saved, small_batches

#: Selector -> (ids in the word, bits of each).
MODES = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
#: Ids of one separately decodable run, and of one block of documents at least.
RUN, BLOCK = 4096, 1 << 16
_COUNT = np.array([n for n, _ in MODES] + [0, 1], np.int64)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of values (uint64), and the word offset at which each run of RUN values starts."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    big = np.flatnonzero(values >= np.uint64(1) << np.uint64(50))  # where rounding could matter
    width[big] = [int(v).bit_length() for v in values[big]]
    left = RUN - np.arange(n) % RUN
    left = np.minimum(left, n - np.arange(n))
    best = np.full(n, ESCAPE, np.uint8)
    peak, have = width.copy(), 1
    for mode in range(len(MODES) - 1, -1, -1):  # from few wide ids to many narrow ones; the last that fits wins
        size, bits = MODES[mode]
        while have < size:
            step = min(have, size - have)
            wider = np.full(n, 64, np.uint8)
            if n > step:
                wider[:n - step] = np.maximum(peak[:n - step], peak[step:])
            peak, have = wider, have + step
        best[(peak <= bits) & (left >= size)] = mode
    step = _COUNT[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    kind = best[starts]
    place = np.cumsum(1 + (kind == ESCAPE)) - 1 - (kind == ESCAPE)
    words = np.zeros(len(starts) + int((kind == ESCAPE).sum()), np.uint64)
    words[place] = kind
    for mode, (size, bits) in enumerate(MODES):
        own = np.flatnonzero(kind == mode)
        for k in range(size if len(own) else 0):
            words[place[own]] |= values[starts[own] + k] << np.uint64(4 + k * bits)
    own = np.flatnonzero(kind == ESCAPE)
    words[place[own] + 1] = values[starts[own]]
    return words, place[np.searchsorted(starts, np.arange(0, n, RUN))]


def unpack(words: np.ndarray) -> np.ndarray:
    """Values of words; may start at the word offset of any run."""
    words = np.ascontiguousarray(words, np.uint64)
    kind = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kind == ESCAPE).tolist():  # an escaped value may itself look like an escape
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, _COUNT[kind])
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for mode, (size, bits) in enumerate(MODES):
        own = np.flatnonzero((kind == mode) & ~raw)
        for k in range(size if len(own) else 0):
            out[at[own] + k] = (words[own] >> np.uint64(4 + k * bits)) & np.uint64((1 << bits) - 1)
    own = np.flatnonzero((kind == ESCAPE) & ~raw)
    out[at[own]] = words[own + 1]
    return out


_FILE = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("words", pa.binary()),
])
FILE_COLUMNS = (
    "shard int, block int, first long, n_ids long, doc_ids array<long>, counts array<long>, offsets array<long>, words binary"
)


def _writer(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, shard, block, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        docs: list = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, offsets = pack(np.concatenate(parts))
            return pa.record_batch(
                [pa.array([x], t.type) for x, t in zip(
                    (shard, block, first, size, docs, counts, offsets, words.astype("<u8").tobytes()), _FILE)], schema=_FILE)

        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            ids, n = codec.encode(texts)
            at = 0
            for doc, k in zip(batch.column("doc_id").to_pylist(), n.tolist()):
                parts += [ids[at:at + k], np.array([end_id])]
                at += k
                docs.append(doc)
                counts.append(k + 1)
                size += k + 1
                if size >= BLOCK:
                    yield flush()
                    block, first = block + 1, first + size
                    docs, counts, parts, size = [], [], [], 0
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode documents in ascending doc_id order into a token table in the shared folder, and open it.

    docs: doc_id, text and others, which are left out. A null text is empty and gives the end id
    alone; null ids come first; equal doc_ids stay, ordered by text. Every partition is one file,
    written by one task that holds a block of ids at most besides the current batch.
    """
    small_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(_writer(tokenizer, end_id), FILE_COLUMNS))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, first, docs, counts, words in zip(*(batch.column(c) for c in ("shard", "first", "doc_ids", "counts", "words"))):
            ids = unpack(np.frombuffer(words.as_py(), "<u8")).astype("<u4")
            n = counts.values.to_numpy(zero_copy_only=False)
            stop = np.cumsum(n)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip((stop - n).tolist(), stop.tolist())]
            yield pa.record_batch(
                [docs.values, pa.array(np.full(len(n), shard.as_py(), np.int32)), pa.array(first.as_py() + stop - n),
                 pa.array(n), pa.array(crc, pa.int64())],
                names=["doc_id", "shard", "local", "n_tokens", "ids_crc32"])


def token_index(tokens: DataFrame) -> DataFrame:
    """Decode a token table: doc_id, start (ids before the document), n_tokens and ids_crc32.

    Starts add the totals of earlier files, one row per file, to the place within the file.
    """
    total = tokens.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    totals = total.groupBy().agg(F.array_sort(F.collect_list(F.struct("shard", "ids"))).alias("all"))  # a row per file
    bases = totals.select(F.explode(F.expr(
        "transform(all, (x, i) -> struct(x.shard, aggregate(slice(all, 1, i), 0L, (s, y) -> s + y.ids) AS base))"
    )).alias("x")).select("x.shard", "x.base")
    rows = tokens.select("shard", "first", "doc_ids", "counts", "words").mapInArrow(
        _reader, "doc_id long, shard int, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
