"""Packing against its contract, the subset-sum against all subsets, the encoder against the library."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm.packing import Packer, closest_fill, pack_documents
from tallyspark.llm.wordbpe import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "Don't STOP", "we'LL they've I'd x's 's's ''s 'tis '", "a b c\td\r\ne", "It costs $12.50 — 3€ (½, ²)",
       "ÀÉÎ straße İstanbul ŒUVRE ŉ", "é combining", "日本語 text", "🎉 party", "<|endoftext|> x", "<|startoftext|>", "\x00\x1c\x85 q",
       "ﬁ ligature ΑΣ Ω", "aaaa" * 900, "x.y,z!!! ... 's", "１２３ 42", "ſ'ſ", "﻿bom", "'", "'s", "a'", "tab\x0bfeed\x0c", "Ǆ ǅ", "­soft"]


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library(spark):
    rng = random.Random(2)
    letters = "abcXYZéÀñß'’ .,;!\n\t0159$%-–€sdtmrvel"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(400)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    codec = WordEncoder(PATH)
    assert codec.plain
    ids, counts = codec.encode(texts)
    stops = np.cumsum(counts)
    for text, a, b, want in zip(texts, stops - counts, stops, library(texts)):
        assert ids[a:b].tolist() == want, text


def test_encoder_cache_starts_anew():
    codec = WordEncoder(PATH)
    codec.at, codec.size = codec.at[:40], codec.size[:40]
    texts = [f"alpha{i} beta gamma {i}" for i in range(200)]
    ids, counts = codec.encode(texts)
    assert np.split(ids, np.cumsum(counts)[:-1])[150].tolist() == library(texts)[150]


def test_closest_fill_is_best():
    rng = random.Random(6)
    for _ in range(300):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(0, 9)))
        room = rng.randint(1, 90)
        take = closest_fill(counts, room)
        assert all(0 < n <= counts[k] for k, n in take.items())
        flat = list(counts.elements())
        sums = {sum(c) for r in range(len(flat) + 1) for c in itertools.combinations(flat, r)}
        assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= room)


def test_packer_prefers_whole_items():
    packer = Packer(64)
    for n in [40, 24, 60, 3, 1, 33, 31, 20, 20, 24]:
        packer.add(n, 0, n)
    got = list(packer.sequences(last=True))
    assert all(start == 0 for s in got for _, start, _ in s) and [sum(p[2] for p in s) for s in got] == [64] * 4


def check(rows, got, capacity):
    """Every id in one piece, no gaps, full or power-of-two sequences, right ids."""
    ids = [x + [2] for x in library([t or "" for _, t in rows])]
    want, have = defaultdict(Counter), defaultdict(Counter)
    for (doc, _), own in zip(rows, ids):
        want[doc][tuple(own)] += 1
    by_length = {(doc, len(own)): own for (doc, _), own in zip(rows, ids)}
    copies = Counter((doc, len(own)) for (doc, _), own in zip(rows, ids))
    covered = defaultdict(Counter)
    sequences = defaultdict(list)
    for r in got:
        own = by_length[r.doc_id, r.doc_tokens]
        part = own[r.start:r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r.doc_id, r.doc_tokens].update(range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, n in copies.items():
        assert covered[key] == Counter({i: n for i in range(key[1])})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0
    return len(sequences)


SCHEMA = "doc_id long, text string, start string, length int"


@pytest.mark.parametrize("group_ids", [1, 1 << 22])
def test_contract(spark, group_ids):
    rng = random.Random(9)
    vocab = [f"word{i}" for i in range(99)]
    rows = [(i, t) for i, t in enumerate([None, *ODD])]
    rows += [(100 + i, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 60, 700])))) for i in range(150)]
    rows += [(500, " ".join(rng.choices(vocab, k=30000))), (None, "no id"), (None, None), (600, "same row"), (600, "same row")]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA).repartition(3)
    result = pack_documents(docs, PATH, group_ids=group_ids)
    assert result.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(rows, result.collect(), 4096)


def test_little_is_cut(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = pack_documents(docs, PATH).collect()
    used = check(rows, got, 4096)
    tokens = sum(r.length for r in got)
    need = -(-tokens // 4096)
    assert need <= used <= need + 12 * docs.rdd.getNumPartitions()
    cuts = len(got) - sum(-(-r.doc_tokens // 4096) for r in got if r.start == 0)
    assert cuts <= 0.03 * len(rows)


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
