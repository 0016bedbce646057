"""AVI files: lossless round trip, index, clips."""

import hashlib
import zlib

import numpy as np
import pytest
from tallyspark.llm import avi

SCHEMA = "doc_id long, text string, media string, n_bytes int"


def test_frames_are_lossless():
    rng = np.random.default_rng(0)
    samples = np.concatenate([
        rng.integers(0, 256, (3000, 576)), np.zeros((2, 576)), np.full((2, 576), 255), np.tile([0, 255], (2, 288)), np.tile([255, 0], (2, 288)),
    ]).astype(np.uint8)
    frames = avi.read_avi(avi.write_avi(avi.encode_frames(samples)))
    assert (avi.decode_frames(frames) == samples).all()


def test_index_and_bad_files():
    frames = avi.encode_frames(np.arange(1152, dtype=np.uint8).reshape(2, 576))
    file = avi.write_avi(frames)
    assert avi.read_avi(file) == frames and len(file) == 8 + int.from_bytes(file[4:8], "little")
    for bad in (b"", b"RIFF1234WAVE", file[:200]):
        with pytest.raises(ValueError):
            avi.read_avi(bad)
    with pytest.raises(ValueError):
        avi.decode_frames([frames[0].replace(b"\xff\xdb\x00\x43\x00\x08", b"\xff\xdb\x00\x43\x00\x01")])


def test_shots():
    rng = np.random.default_rng(1)
    scene = [np.clip(rng.normal(m, 8, (20, 576)), 0, 255) for m in (40, 200, 90)]
    assert avi.shots(np.concatenate(scene).astype(np.uint8))[0] == [0, 20, 40]
    assert avi.shots(np.full((5, 576), 7, np.uint8))[0] == [0]


def test_digest(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "line\n" * 30000, "x" * 577]
    docs = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(texts)] + [(None, "n", "m", 1)], SCHEMA).repartition(3)
    rows = {r.doc_id: r for r in avi.avi_digest(docs).collect()}
    assert len(rows) == 8
    for i, text in enumerate(texts):
        data = (text or "").encode()
        full = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(full), hashlib.sha256(full).hexdigest())
        assert r.tail_crc32 == zlib.crc32(full[-32:])
    assert rows[4][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]
    media = {r.doc_id: bytes(r.media) for r in avi.to_avi(docs).collect()}
    assert {i: hashlib.sha256(m).hexdigest() for i, m in media.items()} == {i: r.media_sha256 for i, r in rows.items()}
    clips = avi.clips(avi.to_avi(docs)).collect()
    assert sum(r.frames for r in clips) == sum(r.payload_bytes for r in rows.values()) // 576
    assert avi.avi_digest(docs.limit(0)).count() == 0 and avi.clips(avi.to_avi(docs.limit(0))).count() == 0
