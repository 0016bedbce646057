"""BPE encoding and decoding with content-defined chunks.

A rolling hash over the last WINDOW characters cuts texts into chunks at places that depend on
content alone, so passages that documents share yield the same chunks wherever they stand. Chunks
that occur more than once in the corpus are encoded once, by the document that has their first copy;
the others are encoded where they stand.

A chunk is encoded on its own from its first to its last sure boundary: a space between two letters,
before which every piece of the pre-tokenizer ends, whatever surrounds it. The joins between these
bodies are repaired by encoding the text from the last sure boundary of one chunk to the first of a
later one, over as many chunks as it takes. The ids therefore equal those of the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import encoder
from tallyspark.llm.store import saved, small_batches
from tallyspark.llm.words import mix

#: Characters the rolling hash sees; a chunk ends where its low bits are zero: every 2**BITS characters on average.
WINDOW, BITS = 48, 9
_WEIGHTS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(chars: np.ndarray) -> np.ndarray:
    """Hashes of all runs of WINDOW characters, by doubling."""
    n, out, have = len(chars), mix(chars.astype(np.uint64)), 1
    power = _BASE
    while have * 2 <= WINDOW:
        out = out[:-have] * power + out[have:]
        power, have = power * power, have * 2
    rest = WINDOW - have  # the last step overlaps
    return mix(out[:n - WINDOW + 1] * power + out[rest:rest + n - WINDOW + 1])


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text, its own end included."""
    n = len(text)
    if n <= WINDOW:
        return [n] if n else []
    with np.errstate(over="ignore"):
        h = _windows(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    found = np.flatnonzero((h & np.uint64((1 << BITS) - 1)) == 0) + WINDOW
    return [*found[found < n].tolist(), n]


def chunk_key(chunk: str) -> bytes:
    """128 bits, so that no two chunks of a large corpus share a key."""
    return hashlib.blake2b(chunk.encode(), digest_size=16).digest()


def sure(chunk: str) -> tuple[int, int]:
    """First and last sure boundary of a chunk, (0, 0) if it has none.

    Letters are a-z and A-Z here: their class is beyond doubt, and the first boundary only has to be sure.
    """
    first, i = -1, chunk.find(" ", 1)
    while 0 < i < len(chunk) - 1:
        if chunk[i - 1].isascii() and chunk[i - 1].isalpha() and chunk[i + 1].isascii() and chunk[i + 1].isalpha():
            first = i
            break
        i = chunk.find(" ", i + 1)
    if first < 0:
        return 0, 0
    i = chunk.rfind(" ", first, len(chunk) - 1)
    while not (chunk[i - 1].isascii() and chunk[i - 1].isalpha() and chunk[i + 1].isascii() and chunk[i + 1].isalpha()):
        i = chunk.rfind(" ", first, i)
    return first, i


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids as 16-bit integers if all fit, else 32-bit; the first byte says which."""
    wide = len(ids) > 0 and int(ids.max()) >= 1 << 16
    return bytes([4 if wide else 2]) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int32)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk: its key, document and number in the document."""
    for batch in batches:
        keys, owner, at = [], [], []
        for i, text in enumerate(batch.column("text").fill_null("").to_pylist()):
            ends = cuts(text)
            keys += [chunk_key(text[a:b]) for a, b in zip([0, *ends], ends)]
            owner += [i] * len(ends)
            at += range(len(ends))
        owner = pa.array(owner, pa.int32())
        yield pa.record_batch(
            [pa.array(keys, pa.binary()), batch.column("doc").take(owner), batch.column("row").take(owner), pa.array(at, pa.int32())],
            names=["key", "doc", "row", "at"])


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data = [press.compress(t.encode()) for t in batch.column("text").fill_null("").to_pylist()]
        yield pa.record_batch([batch.column("doc"), batch.column("row"), pa.array(data, pa.binary())], names=["doc", "row", "packed"])


def _pieces(packed: pa.Array) -> Iterator[tuple[str, list[int]]]:
    plain = zstandard.ZstdDecompressor()
    for data in packed:
        text = plain.decompress(data.as_py()).decode()
        yield text, cuts(text)


def _encode_owned(tokenizer: str):
    """Bodies of the chunks that documents own, encoded: key, ids; documents that own none are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        for batch in batches:
            keys, bodies = [], []
            batch = batch.filter(pc.is_valid(batch.column("owned")))
            for (text, ends), owned in zip(_pieces(batch.column("packed")), batch.column("owned").to_pylist()):
                starts = [0, *ends]
                for x in owned:
                    chunk = text[starts[x["at"]]:ends[x["at"]]]
                    lo, hi = sure(chunk)
                    keys.append(x["key"])
                    bodies.append(chunk[lo:hi])
            ids, n = codec.encode(bodies)
            stop = np.cumsum(n)
            data = [pack_ids(ids[a:b]) for a, b in zip((stop - n).tolist(), stop.tolist())]
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["key", "ids"])

    return run


def encode_document(text: str, ends: list[int], known: dict[int, np.ndarray], codec) -> tuple[list, list]:
    """Parts of a document in order: ids of known bodies, and texts to encode, as (kind, value)."""
    kinds, parts, start, open_at = [], [], 0, 0
    for k, end in enumerate(ends):
        if k in known:
            lo, hi = sure(text[start:end])
            if hi:
                kinds += [False, True]
                parts += [text[open_at:start + lo], known[k]]
                open_at = start + hi
        start = end
    return [*kinds, False], [*parts, text[open_at:]]


def _assemble(tokenizer: str, full: bool):
    """Ids of whole documents from bodies of shared chunks and what stands between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        for batch in batches:
            out, plans, todo = [], [], []
            for (text, ends), shared in zip(_pieces(batch.column("packed")), batch.column("shared").to_pylist()):
                known = {x["at"]: unpack_ids(x["ids"]) for x in shared or []}
                kinds, parts = encode_document(text, ends, known, codec)
                plans.append((kinds, parts))
                todo += [p for kind, p in zip(kinds, parts) if not kind]
            ids, n = codec.encode(todo)
            stop = np.cumsum(n)
            fresh = iter(zip((stop - n).tolist(), stop.tolist()))
            for kinds, parts in plans:
                row = np.concatenate([p if kind else ids[slice(*next(fresh))] for kind, p in zip(kinds, parts)])
                text = codec.decode(row)
                out.append((row, text))
            hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
            columns = [
                batch.column("doc_id"), pa.array([len(r) for r, _ in out], pa.int64()),
                pa.array([hashed(",".join(map(str, r.tolist()))) for r, _ in out], pa.string()),
                pa.array([hashed(t) for _, t in out], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array([r.astype(np.int32) for r, _ in out], pa.list_(pa.int32())), pa.array([t for _, t in out], pa.string())]
                names += ["ids", "decoded"]
            yield pa.record_batch(columns, names=names)

    return run


def bpe_round_trip(docs: DataFrame, tokenizer: str, full: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256 (full: also ids, decoded).

    docs: doc_id, text and others, which are left out. Null and empty texts have no ids; equal or
    null doc_ids are rows of their own; an empty table gives an empty table. Special-token strings in a
    text become their ids, as in the library.
    """
    small_batches(docs.sparkSession)
    # a row is named by its doc_id and the hash of its text: one doc_id may have several texts
    named = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("row"), "text")
    row = ["doc", "row"]
    occurs = saved(named.mapInArrow(_list, "key binary, doc long, row long, at int"))
    owners = (
        occurs.groupBy("key").agg(F.min(F.struct(*row, "at")).alias("own"), F.count("*").alias("n")).where("n > 1")
        .select("key", "own.*")
    )
    texts = named.mapInArrow(_press, "doc long, row long, packed binary")
    owned = owners.groupBy(row).agg(F.collect_list(F.struct("key", "at")).alias("owned"))
    # a left join, so that both uses of the texts have the same plan and share one shuffle
    bodies = texts.join(owned, row, "left").select("packed", "owned").mapInArrow(_encode_owned(tokenizer), "key binary, ids binary")
    shared = occurs.join(bodies.dropDuplicates(["key"]), "key").groupBy(row).agg(F.collect_list(F.struct("at", "ids")).alias("shared"))
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return texts.join(shared, row, "left").select(
        F.when(F.col("doc") != -(1 << 63), F.col("doc")).alias("doc_id"), "packed", "shared"
    ).mapInArrow(_assemble(tokenizer, full), columns)
