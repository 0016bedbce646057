"""Phrase collocation mining: counts of frequent phrases by broadcast double-array tries.

Words are counted first; frequent ones get numbers, and the texts are rewritten once as runs of
numbers in which every other word and every end of a piece is 0. A phrase can only be frequent if
its first and its last words but one are. So for each length the frequent phrases found so far become a
trie, laid out as a double array over numbered words; all positions of a block of text step through it
together, one array operation a level. Positions that end in an accepting state are counted by bincount, and
those followed by another frequent word (with a frequent phrase from the second word on) give the candidates of the
next length. Spark sums the shards. A trie holds at most TRIE_PHRASES phrases, a dictionary at most
DICTIONARY words; larger sets are dealt out by hash over several passes, so no broadcast grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.store import drop, saved, small_batches
from tallyspark.llm.words import utf8, word_spans

#: Phrases of one trie, words of one dictionary and bytes of its words, at most.
TRIE_PHRASES, DICTIONARY, DICTIONARY_BYTES = 1 << 19, 1 << 19, 1 << 24
#: Bytes of text, and numbers of rewritten text, that are taken together.
TEXT_BYTES, BLOCK, TOGETHER = 1 << 22, 1 << 13, 1 << 19
#: Candidates that are gathered before they are counted, and rows of one batch.
KEYS, _ROWS = 1 << 21, 1 << 16
_CUT = np.zeros(256, bool)
_CUT[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of texts, whether each starts a piece, and the number of each text's first word (and the end)."""
    data, offsets = utf8(texts)
    data, offsets = _LOWER[data[offsets[0]:offsets[-1]]], offsets - offsets[0]
    starts, ends, at = word_spans(data, offsets, _GAP)
    place = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data[~_GAP[data]])])
    piece = np.cumsum(_CUT[data], dtype=np.int32)[starts] if len(data) else np.zeros(0, np.int32)
    opens = np.ones(len(starts), bool)
    opens[1:] = piece[1:] != piece[:-1]
    opens[at[:-1][at[:-1] < len(starts)]] = True
    return words, opens, at


def _by_lang(batches: Iterator[pa.RecordBatch], size: int = TEXT_BYTES) -> Iterator[tuple[str, pa.Table]]:
    """(lang, its rows) of several batches at a time."""
    held, have = [], 0

    def parts() -> Iterator[tuple[str, pa.Table]]:
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table["lang"]).to_pylist():
            yield lang, table.filter(pc.equal(table["lang"], lang))

    for batch in batches:
        held.append(batch)
        have += batch.nbytes
        if have >= size:
            yield from parts()
            held, have = [], 0
    if held:
        yield from parts()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, rows in _by_lang(batches):
        words, _, _ = words_of(rows["text"].combine_chunks())
        found = pc.value_counts(words)
        for i in range(0, len(found), _ROWS):
            part = found.slice(i, _ROWS)
            yield pa.record_batch([pa.array([lang] * len(part), pa.string()), part.field("values").cast(pa.string()), part.field("counts")],
                                  names=["lang", "word", "n"])


def squeeze(numbers: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Numbers with a 0 before each piece; runs of zeros are one, and numbers alone between zeros go."""
    place = np.arange(len(numbers)) + np.cumsum(opens)
    out = np.zeros(len(numbers) + int(opens.sum()) + 2, np.int32)  # a zero at either end
    out[place] = numbers
    alone = np.flatnonzero((out[1:-1] > 0) & (out[:-2] == 0) & (out[2:] == 0)) + 1
    out[alone] = 0
    keep = out > 0
    keep[1:] |= out[:-1] > 0
    return out[keep]


def _blocks(numbers: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about BLOCK numbers, each with whole runs and a 0 at its end."""
    zeros = np.flatnonzero(numbers == 0) + 1
    start = 0
    while start < len(numbers):
        i = np.searchsorted(zeros, start + BLOCK)
        stop = int(zeros[min(i, len(zeros) - 1)])
        yield numbers[start:stop]
        start = stop


def _rewrite(shared, known: bool, last: bool) -> Callable:
    """Numbers of the words that a dictionary knows; the last pass leaves the blocks alone, others keep the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        for lang, rows in _by_lang(batches):
            words, opens, at = words_of(rows["text"].combine_chunks())
            vocabulary, ids = dictionary.get(lang, (pa.array([], pa.large_string()), np.zeros(0, np.int32)))
            spot = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            numbers = np.append(ids, np.int32(0))[spot]
            if known:
                numbers = np.maximum(numbers, np.frombuffer(b"".join(rows["numbers"].to_pylist()), "<i4"))
            if last:
                for block in _blocks(squeeze(numbers, opens)):
                    yield pa.record_batch([pa.array([block.astype("<i4").tobytes()])], names=["numbers"])
            else:
                own = [numbers[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield from rows.select(["lang", "text"]).append_column("numbers", pa.array(own, pa.binary())).to_batches()

    return run


class Trie:
    """A double array over phrases of equal length: state s goes by word c to t = base[s] + c if check[t] is s."""

    def __init__(self, phrases: np.ndarray, seed: int = 1):
        """phrases: one row of word numbers (above 0) each, all different; the base of a final state is its row."""
        count, self.depth = phrases.shape
        self.alphabet, local, often = np.unique(phrases, return_inverse=True, return_counts=True)
        self.width = len(self.alphabet) + 1
        self.code = np.zeros(self.width - 1, np.int32)  # frequent words have low codes, so that children lie close
        self.code[np.argsort(-often, kind="stable")] = np.arange(1, self.width)
        local = self.code[local.reshape(phrases.shape)].astype(np.int64)
        self.rng = np.random.default_rng(seed)
        self.base = np.zeros(0, np.int32)
        self.check = np.zeros(0, np.int32)
        self._grow(2 * self.width + count)
        self.check[0] = -2  # the root is state 0
        state = np.zeros(count, np.int64)
        for level in range(self.depth):
            edge, owner = np.unique(state << 32 | local[:, level], return_inverse=True)
            state = self._place(edge >> 32, edge & 0xFFFFFFFF)[owner]
        self.base[state] = np.arange(count)

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        self.base = np.append(self.base, np.zeros(more, np.int32))
        self.check = np.append(self.check, np.full(more, -1, np.int32))

    def _place(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """States of the children (parent, word), sorted by both; parents of many children are placed first."""
        out = np.zeros(len(words), np.int64)
        own, first, size = np.unique(parents, return_index=True, return_counts=True)
        weight = np.frexp(size.astype(float))[1]
        for w in sorted(set(weight.tolist()), reverse=True):
            todo, tries = np.flatnonzero(weight == w), 0
            while len(todo):
                root = own[todo] == 0
                base = np.where(root, 0, self.rng.integers(1, len(self.base) - self.width, len(todo)))
                n = size[todo]
                at = np.repeat(first[todo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                slot = np.repeat(base, n) + words[at]
                _, winner = np.unique(slot, return_index=True)
                good = np.zeros(len(slot), bool)
                good[winner] = True
                good &= self.check[slot] == -1
                fits = np.logical_and.reduceat(good, np.cumsum(n) - n)
                took = np.repeat(fits, n)
                self.check[slot[took]] = np.repeat(own[todo], n)[took]
                self.base[own[todo[fits]]] = base[fits]
                out[at[took]] = slot[took]
                todo, tries = todo[~fits], tries + 1
                if len(todo) and tries % 40 == 0:
                    self._grow(len(self.base) * 5 // 4)
        return out

    def walk(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a phrase starts, and its row: all positions step together, level by level."""
        spot = np.searchsorted(self.alphabet, numbers).astype(np.int32)
        spot[spot == len(self.alphabet)] = 0
        local = np.where(self.alphabet[spot] == numbers, self.code[spot], 0)
        at = np.arange(len(numbers) - self.depth + 1, dtype=np.int32)
        state = np.zeros(len(at), np.int32)
        for level in range(self.depth):
            word = local[at + level]
            step = self.base[state] + word
            alive = (word > 0) & (self.check[step] == state)
            at, state = at[alive], step[alive]
        return at, self.base[state]


def _packed(phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A phrase of up to four numbers as two 64-bit numbers; absent words are 0."""
    wide = np.zeros((len(phrases), 4), np.int64)
    wide[:, :phrases.shape[1]] = phrases
    return wide[:, 0] << 32 | wide[:, 1], wide[:, 2] << 32 | wide[:, 3]


def _step(shared, depth: int, extend: bool, whole: bool) -> Callable:
    """Counts of the phrases of a trie (size = depth), and candidates one word longer (size = depth + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, phrases = shared.value if shared else (None, None)
        counts = np.zeros(len(phrases) if shared else 0, np.int64)
        keys: list[np.ndarray] = []

        def rows(size: int, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(n), size, np.int32)), *map(pa.array, (*_packed(ids), n))], names=["size", "a", "b", "n"])

        def longer() -> Iterator[pa.RecordBatch]:
            own = np.concatenate(keys)
            keys.clear()
            own, n = np.unique(own, return_counts=True)
            for i in range(0, len(own), _ROWS):
                key = own[i:i + _ROWS]
                before = phrases[key >> 32] if shared else (key >> 32)[:, None]
                yield rows(depth + 1, np.hstack([before, (key & 0xFFFFFFFF)[:, None]]), n[i:i + _ROWS])

        def scan(numbers: np.ndarray) -> None:
            if shared:
                at, row = trie.walk(numbers)
                counts[:] += np.bincount(row, minlength=len(counts))
            else:
                at = np.flatnonzero(numbers)
                row = numbers[at].astype(np.int64)
            if extend:
                starts = np.zeros(len(numbers) + 1, bool)
                starts[at] = True
                after = numbers[np.minimum(at + depth, len(numbers) - 1)]
                going = (after > 0) & (at + depth < len(numbers)) & (starts[at + 1] | (not whole))
                keys.append(row[going].astype(np.int64) << 32 | after[going])

        held, have = [], 0
        for batch in batches:
            for x in batch.column("numbers"):
                held.append(np.frombuffer(x.as_buffer(), "<i4"))
                have += len(held[-1])
                if have >= TOGETHER:
                    scan(np.concatenate(held))
                    held, have = [], 0
                    if sum(map(len, keys)) >= KEYS:
                        yield from longer()
        if held:
            scan(np.concatenate(held))
        if keys:
            yield from longer()
        found = np.flatnonzero(counts)
        for i in range(0, len(found), _ROWS):
            yield rows(depth, phrases[found[i:i + _ROWS]], counts[found[i:i + _ROWS]])

    return run


def _shards(df: DataFrame, keys: list[str], most: int) -> Iterator[DataFrame]:
    """df in parts of about `most` rows, dealt by hash."""
    n = -(-df.count() // most)
    for i in range(n):
        yield df if n == 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)


def _numbered(counts: DataFrame, least: int) -> DataFrame:
    """(lang, word, n, id) of frequent words; ids are int, from 1, each lang's words have their own."""
    words = counts.where(F.col("n") >= least)
    parts = 64 * max(1, -(-words.count() // DICTIONARY))
    dealt = words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)))
    row = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    return saved(dealt.select("lang", "word", "n", (F.col("part") + parts * (row - 1) + 1).cast("int").alias("id")))


def _rewritten(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks of word numbers of all texts."""
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b")).first()
    passes = max(1, -(-size["n"] // DICTIONARY), -(-size["b"] // DICTIONARY_BYTES))
    state = texts
    for i in range(passes):
        dictionary = {}
        rows = words.where(F.pmod(F.xxhash64("lang", "word"), F.lit(passes)) == i).select("lang", "word", "id").toArrow()
        for lang in pc.unique(rows["lang"]).to_pylist():
            own = rows.filter(pc.equal(rows["lang"], lang))
            dictionary[lang] = own["word"].combine_chunks().cast(pa.large_string()), own["id"].to_numpy().astype(np.int32)
        shared, last = texts.sparkSession.sparkContext.broadcast(dictionary), i == passes - 1
        after = saved(state.mapInArrow(_rewrite(shared, i > 0, last), "numbers binary" if last else "lang string, text string, numbers binary"))
        shared.unpersist()
        drop(state)
        state = after
    return state


def phrase_counts(blocks: DataFrame, least: int, longest: int = 4) -> DataFrame:
    """(size, a, b, n): exact counts of all frequent phrases of 2 to `longest` numbers; a and b hold the numbers."""
    spark = blocks.sparkSession
    out, schema = [], "size int, a long, b long, n long"
    enough = lambda df, size: df.groupBy("size", "a", "b").agg(F.sum("n").alias("n")).where(
        (F.col("size") < size) | (F.col("n") >= least))
    found = saved(enough(blocks.mapInArrow(_step(None, 1, True, True), schema), 2))
    for size in range(2, longest + 1):
        last = size == longest
        parts = list(_shards(found.where(F.col("size") == size), ["a", "b"], TRIE_PHRASES))
        steps = []
        for part in parts:
            rows = part.select("a", "b").toArrow()
            a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
            phrases = np.stack([a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF], axis=1)[:, :size].astype(np.int32)
            shared = spark.sparkContext.broadcast((Trie(phrases), phrases))
            steps.append(saved(enough(blocks.mapInArrow(_step(shared, size, not last, len(parts) == 1), schema), size + 1)))
            shared.unpersist()
        if not steps:
            break
        found = reduce(DataFrame.unionByName, steps)
        out.append(found.where(F.col("size") == size))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)


def _parts(numbers: str, low: int) -> Column:
    """All runs of `low` or more neighbouring numbers that are shorter than the phrase."""
    return F.expr(f"flatten(transform(sequence({low}, size({numbers}) - 1),"
                  f" k -> transform(sequence(1, size({numbers}) - k + 1), i -> slice({numbers}, i, k))))")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, longest: int = 4) -> DataFrame:
    """The best phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    docs: lang, text and others, which are left out. A null text is empty, a null lang is 'und'; each row counts,
    repeated ones too; a lang without candidates has no rows, an empty table gives an empty one. Words, pieces,
    counts and scores are as the query's contract says; `longest` is 2 to 4. Texts of any length are taken whole.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = saved(texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    words = _numbered(counts, least)
    blocks = _rewritten(texts, words)
    found = phrase_counts(blocks, least, longest)
    number = [F.shiftright("a", 32), F.col("a").bitwiseAND(0xFFFFFFFF), F.shiftright("b", 32), F.col("b").bitwiseAND(0xFFFFFFFF)]
    phrases = saved(found.select(F.slice(F.array(*[x.cast("int") for x in number]), F.lit(1), F.col("size")).alias("numbers"), F.col("n").alias("a")))
    known = phrases.unionByName(words.select(F.array("id").alias("numbers"), F.col("n").alias("a")))

    cuts = phrases.select("numbers", "a", F.explode(F.expr("sequence(1, size(numbers) - 1)")).alias("k")).select(
        "numbers", "a", "k", F.expr("slice(numbers, 1, k)").alias("left"), F.expr("slice(numbers, k + 1, size(numbers) - k)").alias("right"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = (
        cuts.join(known.select(F.col("numbers").alias("left"), F.col("a").alias("l")), "left")
        .join(known.select(F.col("numbers").alias("right"), F.col("a").alias("r")), "right")
        .withColumns({"a_": wide("a"), "l_": wide("l"), "r_": wide("r")})
        .withColumn("score", F.expr("2000000 * a_ div (l_ + r_)").cast("long"))
        .groupBy("numbers", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    longer = phrases.where(F.size("numbers") > 2).select(F.explode(_parts("numbers", 2)).alias("numbers"), "a").groupBy("numbers").agg(F.max("a").alias("longer"))
    free = scored.join(longer, "numbers", "left").where(
        F.col("longer").isNull() | (100 * wide("longer") < 80 * wide("a"))).select("numbers", "a", "cut.l", "cut.r", "cut.score")
    spelled = (
        free.select("*", F.posexplode("numbers").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
        .groupBy("numbers", "a", "l", "r", "score").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
        .select("lang", F.array_join("w.word", " ").alias("phrase"), "a", "l", "r", "score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
