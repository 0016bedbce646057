"""Token files and chunked encoding against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tallyspark.llm import chunks, simple8b
from tallyspark.llm.bpe import Encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, n_tokens int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    odd = "abc '  \n\t.,1٣éñ中😀x—sdtmlrve’ "
    words = ["the", "and", "thintion", "Été", "don't", "12", "x.y", "  ", "we'll", "\n", "<|endoftext|>", "日本"]
    shared = " ".join(rng.choices(words[:7], k=900))
    out = ["".join(rng.choices(odd, k=rng.randint(0, 80))) for _ in range(150)]
    out += [" ".join(rng.choices(words, k=300)) + shared[i:] + " ".join(rng.choices(words, k=50)) for i in range(0, 60, 7)]
    return [*out, None, "", " ", "'s", "''s", "a" * 5000, "no space" * 3000, "x y " * 20000, shared, shared]


def expected(texts):
    lib = Tokenizer.from_file(PATH)
    return [lib.encode(t or "", add_special_tokens=False).ids for t in texts], lib


def test_encoder_equals_library(texts):
    want, lib = expected(texts)
    codec = Encoder(PATH)
    for _ in range(2):  # with a cold and a warm cache
        ids, n = codec.encode([t or "" for t in texts])
        assert n.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
    for w in want:
        assert codec.decode(np.array(w, np.int64)) == lib.decode(w, skip_special_tokens=False)


@pytest.mark.parametrize("values", [
    [], [0], [1] * 500, list(range(300)), [2**60 - 1, 2**60, 2**64 - 1, 15, 0, 2**63 + 15, 15], [2**31] * 9 + [1] * 70 + [50256] * 4097,
])
def test_simple8b_round_trip(values):
    words, offsets = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(words).tolist() == values
    for k, at in enumerate(offsets.tolist()):
        assert simple8b.unpack(words[at:]).tolist() == values[k * simple8b.RUN:]


def test_simple8b_random():
    rng = np.random.default_rng(1)
    for top in (1, 4, 12, 16, 33, 60, 64):
        values = rng.integers(0, 2**top, 20000, dtype=np.uint64, endpoint=False) if top < 64 else rng.integers(0, 2**64, 5000, dtype=np.uint64)
        values[rng.random(len(values)) < 0.5] >>= np.uint64(top // 2)
        assert (simple8b.unpack(simple8b.pack(values)[0]) == values).all()


def test_token_files(spark, texts):
    want, _ = expected(texts)
    docs = spark.createDataFrame([(i * 3, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(6)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in simple8b.token_index(simple8b.write_tokens(docs, PATH)).collect()}
    start = 0
    for i, w in enumerate(want):
        ids = np.array([*w, 0], "<u4")
        assert got[i * 3] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_token_files_repeated_null_and_empty(spark):
    docs = spark.createDataFrame([(5, "b", "", 1), (5, "a", "", 1), (None, "n", "", 1), (5, "a", "", 1)], SCHEMA)
    rows = simple8b.token_index(simple8b.write_tokens(docs, PATH)).collect()
    assert sorted(r.start for r in rows) == [0, 2, 4, 6] and [r.start for r in rows if r.doc_id is None] == [0]
    assert simple8b.token_index(simple8b.write_tokens(docs.limit(0), PATH)).count() == 0


def test_chunked_round_trip(spark, texts):
    want, lib = expected(texts)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA).repartition(6)
    got = {r.doc_id: r for r in chunks.bpe_round_trip(docs, PATH, full=True).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        text = lib.decode(w, skip_special_tokens=False)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (w, len(w), text)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, w)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_chunked_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b " * 900, "", 1)] * 3 + [(1, "c d " * 900, "", 1), (None, None, "", 1)], SCHEMA)
    assert sorted(r.n_tokens for r in chunks.bpe_round_trip(docs, PATH).collect())[0] == 0
    assert chunks.bpe_round_trip(docs, PATH).count() == 5
    assert chunks.bpe_round_trip(docs.limit(0), PATH).count() == 0


def test_chunks_do_not_depend_on_position():
    rng = random.Random(2)
    body = " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=3000))
    tails = []
    for lead in ("", "some words before ", "x" * 777):
        text = lead + body
        tails.append([text[a:b] for a, b in zip(chunks.cuts(text), chunks.cuts(text)[1:])][2:])
    assert set(tails[0][3:]) <= set(tails[1]) and set(tails[0][3:]) <= set(tails[2])
