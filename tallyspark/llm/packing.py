"""Packing of whole documents into token sequences of a fixed capacity by minimum bin slack.

Whole windows are cut from the front of documents that are longer than a sequence. What remains of each
document is an item; items of many documents are held as counts by length. A sequence starts with the longest
item, and a subset-sum over the other lengths, whose reachable sums are the bits of one whole number, finds
the items that fill the rest of the window closest; walking the sums back gives how often each length is used.
A slack that no set of items closes is filled with the front of the longest item left. The last tokens
of a partition, fewer than a sequence, are cut into sequences whose lengths are powers of two.

Every partition packs the documents it reads, so no document is shuffled and no hot source or group of copies
matters; a worker holds the items of at most GROUP_IDS ids besides its current batch.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.llm.store import small_batches
from tallyspark.llm.wordbpe import word_encoder

CAPACITY = 4096
#: Ids that are packed together at most.
GROUP_IDS = 1 << 22
#: Sequence numbers of a partition start at its number times this.
PART = 1 << 40


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each length, at most counts[length] times, so that the sum is the largest up to room.

    Lengths are offered from long to short in lots of 1, 2, 4, ... pieces, until room itself is reached.
    """
    mask, bits, lots = (1 << room + 1) - 1, 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:
            lot = min(lot, left)
            lots.append((length, lot, bits))
            bits |= bits << length * lot & mask
            left, lot = left - lot, lot * 2
        if bits >> room & 1:
            break
    total, take = bits.bit_length() - 1, defaultdict(int)
    for length, lot, before in reversed(lots):
        if not before >> total & 1:
            take[length] += lot
            total -= length * lot
    return dict(take)


class Packer:
    """Items by length, and the sequences made of them; an item is (document, start) with its ids kept outside."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: dict[int, list] = defaultdict(list)
        self.counts: dict[int, int] = {}
        self.total = 0

    def add(self, item, start: int, length: int) -> None:
        self.items[length].append((item, start))
        self.counts[length] = self.counts.get(length, 0) + 1
        self.total += length

    def _pop(self, length: int):
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.total -= length
        return self.items[length].pop()

    def _front(self, size: int):
        """The first `size` tokens of the longest item; the rest stays an item."""
        length = max(self.counts)
        item, start = self._pop(length)
        size = min(size, length)
        if length > size:
            self.add(item, start + size, length - size)
        return item, start, size

    def sequences(self, last: bool) -> Iterator[list]:
        """Full sequences of (item, start, length); with last also those of the tail, all of power-of-two length."""
        while self.total >= self.capacity:
            longest = max(self.counts)
            out = [(*self._pop(longest), longest)]
            room = self.capacity - longest
            for length, n in closest_fill(self.counts, room).items():
                out += [(*self._pop(length), length) for _ in range(n)]
                room -= n * length
            while room:
                out.append(self._front(room))
                room -= out[-1][2]
            yield out
        while last and self.total:
            room, out = 1 << self.total.bit_length() - 1, []
            for length, n in closest_fill(self.counts, room).items():
                out += [(*self._pop(length), length) for _ in range(n)]
                room -= n * length
            while room:
                out.append(self._front(room))
                room -= out[-1][2]
            yield out


_FIELDS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack(tokenizer: str, end_id: int, capacity: int, group_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sequence = word_encoder(tokenizer), TaskContext.get().partitionId() * PART
        packer, kind = Packer(capacity), None
        docs: list = []  # of the current output
        rows: list[tuple[int, ...]] = []

        def place(pieces: list) -> None:
            nonlocal sequence
            at = 0
            for (doc, tokens, shift, ids), start, length in pieces:
                docs.append(doc)
                part = ids[start - shift:start - shift + length]
                rows.append((start, length, zlib.crc32(part), tokens, sequence, at))
                at += length
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(_FIELDS)
            batch = pa.record_batch([pa.array(docs, kind), *columns], names=["doc_id", *_FIELDS])
            docs.clear()
            rows.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids, counts = codec.encode(batch.column("text").fill_null("").to_pylist())
            ids = ids.astype("<u4")
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                at += n
                whole = len(own) // capacity * capacity
                for start in range(0, whole, capacity):
                    place([((doc, len(own), 0, own), start, capacity)])
                if len(own) > whole:
                    packer.add((doc, len(own), whole, own[whole:].copy()), whole, len(own) - whole)
            if packer.total >= group_ids:
                for pieces in packer.sequences(last=False):
                    place(pieces)
            if rows:
                yield out()
        for pieces in packer.sequences(last=True):
            place(pieces)
        if rows:
            yield out()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, group_ids: int = GROUP_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text and others, which are left out. Each row of docs is a document of its own, repeated rows
    and null ids too; its ids end with end_id, so a null or empty text is that id alone. Every id lies in
    one piece, sequences hold at most `capacity` (a power of two) tokens without gaps, and are full or of power-of-two
    length, so nothing is padded. Sequence numbers are unique and rise within a partition. An
    empty table gives an empty table. Texts of any length are packed whole.
    """
    small_batches(docs.sparkSession)
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in _FIELDS]])
    return docs.select("doc_id", "text").mapInArrow(_pack(tokenizer, end_id, capacity, group_ids), out)
