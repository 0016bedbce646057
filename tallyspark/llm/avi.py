"""Media columns as AVI motion-JPEG: write, parse by the RIFF index, decode intra frames, find shots.

A frame is a baseline grayscale JPEG of 192 x 192 pixels whose 576 blocks of 8 x 8 are flat: block i
holds sample i in its DC term (quantiser 8, so that the term is the sample minus 128), its AC part is
one end-of-block bit. Decoding gives the samples back exactly, in any baseline decoder. Entropy
decoding runs over all frames of a batch at once, block by block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.store import small_batches
from tallyspark.llm.words import utf8

#: Samples of a frame, its width and height in blocks, and frames a second.
SAMPLES, SIDE, FPS = 576, 24, 25
#: Code lengths of the standard luminance DC table, for 0 to 11 magnitude bits: a fixed value of the format.
DC_COUNTS, DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
#: Frames that are coded or decoded together.
GROUP = 2048
#: Histogram bins; frames on each side a difference is held against; the least difference of a cut, in samples.
BINS, NEAR, LEAST = 16, 8, 58


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


HEAD = (
    b"\xff\xd8" + _segment(0xDB, b"\0" + b"\x08" * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE * 8, SIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\0" + DC_COUNTS + DC_SYMBOLS) + _segment(0xC4, b"\x10\x01" + bytes(15) + b"\0")
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, size)
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(1)
def _coding() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255 to 255: code, magnitude bits and end of block, aligned left in 16 bits; and the length."""
    word, size = np.zeros(511, np.uint16), np.zeros(511, np.uint8)
    table = _codes(DC_COUNTS, DC_SYMBOLS)
    for diff in range(-255, 256):
        bits = abs(diff).bit_length()
        code, n = table[bits]
        low = diff if diff >= 0 else diff + (1 << bits) - 1
        size[diff + 255] = n + bits + 1
        word[diff + 255] = ((code << bits | low) << 1) << (16 - (n + bits + 1))
    return word, size


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of frames, samples being (frames, 576) bytes."""
    out = []
    word, size = _coding()
    for i in range(0, len(samples), GROUP):
        part = samples[i:i + GROUP].astype(np.int16)
        diff = np.diff(part, axis=1, prepend=np.int16(128)) + 255
        n = np.concatenate([size[diff], np.zeros((len(part), 1), np.uint8)], axis=1)
        total = n.sum(axis=1, dtype=np.int64)
        n[:, -1] = -total % 8  # the last byte is filled with ones
        code = np.concatenate([word[diff], np.full((len(part), 1), 0xFFFF, np.uint16)], axis=1)
        bits = np.unpackbits(code.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
        data = np.packbits(bits[np.arange(16) < n.reshape(-1, 1)])
        ends = np.cumsum((total + 7) // 8)
        full = np.flatnonzero(data == 0xFF)
        ends += np.searchsorted(full, ends)
        data = np.insert(data, full + 1, 0).tobytes()
        out += [HEAD + data[a:b] + b"\xff\xd9" for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames with its index."""
    side, most = SIDE * 8, max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1000000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", side * side, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    sizes = np.array([len(f) for f in frames], np.int64)
    index = np.zeros(len(frames), [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["size"] = b"00dc", 0x10, sizes
    index["at"] = 4 + np.cumsum(8 + sizes + sizes % 2) - (8 + sizes + sizes % 2)
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", f) for f in frames))
    return _chunk(b"RIFF", b"AVI " + head + movi + _chunk(b"idx1", index.tobytes()))


def read_avi(data: bytes) -> list[bytes]:
    """Frames of an AVI file, found by its index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at:at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8:at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("the file has no frames or no index")
    return [data[movi + a + 8:movi + a + 8 + n] for a, n in index[:, 2:].tolist()]


@lru_cache(16)
def _tables(head: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """From a frame's header: blocks, and for the next 16 bits the bits one block takes and its DC difference."""
    at, tables, blocks, quant = 2, {}, 0, 0
    while at < len(head):
        mark, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4:at + 2 + size]
        if mark == 0xDB:
            quant = body[1]
        elif mark == 0xC0:
            high, wide, parts = struct.unpack_from(">xHHB", body)
            blocks = (high + 7) // 8 * ((wide + 7) // 8) * (parts == 1)
        elif mark == 0xC4:
            tables[body[0]] = _codes(body[1:17], body[17:])
        at += 2 + size
    if not blocks or quant != 8 or set(tables.get(0x10, {})) != {0}:
        raise ValueError("a frame is not gray, baseline and flat by blocks")
    end = tables[0x10][0][1]
    length, diff = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int16)
    for bits, (code, n) in tables[0].items():
        if n + bits + end > 16:
            continue
        value = np.arange(1 << bits)
        signed = np.where(value >= (1 << bits) >> 1, value, value - (1 << bits) + 1) if bits else value
        run = 1 << (16 - n - bits)
        length[code << (16 - n):(code + 1) << (16 - n)] = n + bits + end
        diff[code << (16 - n):(code + 1) << (16 - n)] = np.repeat(signed, run)
    return blocks, length, diff


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Samples (frames, blocks) of JPEG images that share one header."""
    if not frames:
        return np.zeros((0, SAMPLES), np.uint8)
    stop = frames[0].index(b"\xff\xda")
    stop += 2 + struct.unpack_from(">H", frames[0], stop + 2)[0]
    head = frames[0][:stop]
    if any(not f.startswith(head) or not f.endswith(b"\xff\xd9") for f in frames):
        raise ValueError("frames of one file differ in their headers")
    blocks, length, diff = _tables(head)
    out = np.empty((len(frames), blocks), np.uint8)
    for i in range(0, len(frames), GROUP):
        part = [f[stop:-2] for f in frames[i:i + GROUP]]
        data = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum([len(p) for p in part])
        stuffed = np.flatnonzero((data[1:] == 0) & (data[:-1] == 0xFF)) + 1
        at = np.concatenate([[0], ends[:-1]])
        at -= np.searchsorted(stuffed, at)
        data = np.concatenate([np.delete(data, stuffed), np.zeros(4, np.uint8)]).astype(np.uint32)
        three = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        spot, diffs = at * 8, np.empty((blocks, len(part)), np.int16)
        last = len(three) - 1
        for k in range(blocks):
            now = (three[np.minimum(spot >> 3, last)] >> (8 - (spot & 7)).astype(np.uint32)) & 0xFFFF
            diffs[k] = diff[now]
            spot += length[now]
        out[i:i + GROUP] = (np.cumsum(diffs, axis=0, dtype=np.int32) + 128).astype(np.uint8).T
    return out


def shots(samples: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and each frame's histogram difference from the one before.

    A cut is a difference of LEAST samples or more, twice the mean of its neighbours or more, and
    the highest among them (the first of equals).
    """
    n = len(samples)
    cell = (samples >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    hist = np.bincount(cell.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.zeros(n, np.int64)
    diff[1:] = np.abs(np.diff(hist, axis=0)).sum(axis=1) // 2
    cuts = [0]
    for i in np.flatnonzero(diff >= LEAST).tolist():
        near = np.concatenate([diff[max(1, i - NEAR):i], diff[i + 1:i + 1 + NEAR]])
        if len(near) == 0 or (diff[i] * len(near) >= 2 * near.sum() and diff[i] > diff[max(1, i - NEAR):i].max(initial=0) and diff[i] >= near.max()):
            cuts.append(i)
    return cuts, diff


def payload(text: bytes) -> np.ndarray:
    """A text's bytes, filled with 255 up to a positive multiple of a frame."""
    n = max(1, -(-len(text) // SAMPLES)) * SAMPLES
    out = np.full(n, 255, np.uint8)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out


def _files(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """For each text: its length, the stored file, and the samples read back from the file.

    Texts are taken together up to some GROUPs of frames.
    """
    data, offsets = utf8(batch.column("text"))
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] < SAMPLES * GROUP * 2:
            j += 1
        loads = [payload(data[a:b].tobytes()) for a, b in zip(offsets[i:j].tolist(), offsets[i + 1:j + 1].tolist())]
        counts = [len(x) // SAMPLES for x in loads]
        frames = iter(encode_frames(np.concatenate(loads).reshape(-1, SAMPLES)))
        files = [write_avi([next(frames) for _ in range(k)]) for k in counts]
        back = [read_avi(f) for f in files]
        samples = decode_frames([f for part in back for f in part])
        at = 0
        for k, (file, part) in enumerate(zip(files, back)):
            yield int(offsets[i + k + 1] - offsets[i + k]), file, samples[at:at + len(part)]
            at += len(part)
        i = j


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for size, file, samples in _files(batch):
            back = samples.tobytes()
            cuts, diff = shots(samples)
            seen = ",".join(map(str, cuts))
            feature = f"frames={len(samples)};shots={len(cuts)};cuts={zlib.crc32(seen.encode())};change={int(diff.sum())};light={int(samples.sum())}"
            rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
        columns = list(zip(*rows)) or [()] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, file in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
            samples = decode_frames(read_avi(file.as_py())) if file.is_valid else np.zeros((0, SAMPLES), np.uint8)
            cuts, diff = shots(samples)
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(samples)]) if len(samples) else ()):
                rows.append((doc, k, a / FPS, b / FPS, b - a, int(diff[a]), float(samples[a:b].mean())))
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                              names=["doc_id", "clip", "start_s", "end_s", "frames", "cut", "light"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = [f for _, f, _ in _files(batch)]
        yield pa.record_batch([batch.column("doc_id"), pa.array(files, pa.binary())], names=["doc_id", "media"])


def to_avi(docs: DataFrame) -> DataFrame:
    """Store every whole text (null: empty) as an AVI file: doc_id, media. Other columns are left out."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of AVI files (doc_id, media): clip, start_s, end_s, frames, cut, light. A null file has none."""
    small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(
        _clips, "doc_id long, clip int, start_s double, end_s double, frames long, cut long, light double")


def avi_digest(docs: DataFrame) -> DataFrame:
    """Store every whole text as AVI, read the file back and describe it, one row per document.

    docs: doc_id, text and others, which are left out. A null or empty text is one frame of 255;
    texts of any length are split into frames; equal texts have equal values; repeated rows and null
    ids stay; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,"
        " media_sha256 string, feature string")
