"""Benchmark decontamination by templates.

Words become a template: numbers, names (capitalised words) and units turn into typed placeholders,
neighbouring numbers or names into one. Windows of WINDOW template tokens are hashed, and a document's
windows are looked up among those of the benchmark, so a question with other numbers or names is found
as well as a verbatim one. Where windows of an item gather, item and text are aligned token by token over
neighbouring diagonals, so words may be put in, left out or replaced between runs of equal tokens. Along
that chain the slots are compared: one item value must always stand for one document value and the
other way round, else the match is chance.
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

#: Template tokens of a window; an item with fewer is one window.
WINDOW = 5
#: Tokens of an item that must stand in a text at least (all of a shorter item); tokens of a run that counts.
LEAST_TOKENS, RUN = 8, 3
#: Words put in or left out that an alignment can bridge, to either side of where it starts.
DRIFT = 8
#: Plain words a benchmark window needs, if its item has such a window at all.
PLAIN = 3
#: Benchmark windows that are looked up in one pass; a larger benchmark takes several passes.
PASS_WINDOWS = 1 << 20
NUMBER, UNIT, NAME = 1, 2, 3
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    " nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half third quarter"
    " twice double triple dozen"
)
UNIT_WORDS = (
    "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles"
    " mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l liter liters litre litres gallon gallons cup cups"
    " second seconds minute minutes hour hours day days week weeks month months year years"
    " cent cents dollar dollars euro euros percent degree degrees mph kmh watt watts volt volts"
)
_MARK = words.mix(np.arange(101, 105, dtype=np.uint64))
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return np.sort(words.words(data, np.array([0, len(data)]))[0])


_NUMBERS, _UNITS = _hashes(NUMBER_WORDS), _hashes(UNIT_WORDS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of all texts, their kinds (0 plain), what stood in their place, each text's first token."""
    starts, ends, at = words.word_spans(data, offsets, words.MARKS)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), at
    h = words.span_hashes(data, starts, ends)
    size = ends - starts
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    capitals = np.concatenate([[0], np.cumsum(_UPPER[data])])
    second = data[np.minimum(starts + 1, len(data) - 1)]
    first = _UPPER[data[starts]] | ((data[starts] == 0xC3) & (size > 1) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    shout = (capitals[ends] - capitals[starts] == size) & (size > 1)
    kind = np.zeros(len(h), np.int8)
    kind[first & ~shout] = NAME
    kind[_among(h, _UNITS)] = UNIT
    kind[(digits[ends] > digits[starts]) | _among(h, _NUMBERS)] = NUMBER
    keep = np.ones(len(h), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] != NUMBER) & (kind[1:] != NAME))
    keep[at[:-1][np.diff(at) > 0]] = True
    spot = np.flatnonzero(keep)
    run = np.arange(len(h)) - np.repeat(spot, np.diff(np.append(spot, len(h))))
    value = words.mix(np.add.reduceat(h * (2 * run.astype(np.uint64) + np.uint64(1)), spot))
    kind = kind[spot]
    token = np.where(kind == 0, h[spot], _MARK[kind])
    return token, kind, value, np.searchsorted(spot, at)


@dataclass(frozen=True)
class Items:
    """Benchmark items of one pass: windows sorted by hash with their item and place, and slots by item."""

    sizes: list[int]
    window: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    ids: list
    tokens: list[np.ndarray]
    kinds: list[np.ndarray]
    values: list[np.ndarray]
    windows: list[np.ndarray]


def index(ids: list, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Items:
    """Index items given by (tokens, kinds, values)."""
    found: dict[int, list] = {}
    windows = []
    for i, (tokens, kinds, _) in enumerate(rows):
        size = min(WINDOW, len(tokens))
        windows.append(np.zeros(0, np.int64))
        if not size:
            continue
        grams = words.shingles(tokens, size)
        plain = np.convolve(kinds == 0, np.ones(size, int), "valid")
        use = np.flatnonzero(plain >= PLAIN) if (plain >= PLAIN).any() else np.arange(len(grams))
        windows[i] = use
        found.setdefault(size, []).append((grams[use], np.full(len(use), i), use))
    window = {}
    for size, parts in found.items():
        h, item, place = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(h, kind="stable")
        window[size] = h[order], item[order], place[order]
    return Items(sorted(window), window, ids, *([r[k] for r in rows] for k in range(3)), windows)


def _consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether equal values of either side always meet equal values of the other."""
    pairs = len(np.unique(np.stack([a, b]), axis=1).T)
    return pairs == len(np.unique(a)) == len(np.unique(b))


def align(item: np.ndarray, text: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of item and text that stand for each other, rising in both, near the diagonal text = item + shift.

    Only runs of RUN neighbours or more count; of all such chains within DRIFT diagonals one with most places is taken.
    """
    m, width, run = len(item), 2 * DRIFT + 1, min(RUN, len(item))
    spots = np.arange(m)[:, None] + shift + np.arange(-DRIFT, DRIFT + 1)
    inside = (spots >= 0) & (spots < len(text))
    equal = inside & (text[np.clip(spots, 0, len(text) - 1)] == item[:, None])
    best = np.zeros((m + 1, width), np.int32)  # most places of chains before row and diagonal
    ends = np.zeros((m + 1, width), np.int32)  # the same, of chains whose last run ends just there; 0 for none
    length = np.zeros(width, np.int32)
    for i in range(1, m + 1):
        length = np.where(equal[i - 1], length + 1, 0)
        start = np.where(length >= run, best[i - run] + run, 0) if i >= run else 0
        ends[i] = np.maximum(start, np.where((length > run) & (ends[i - 1] > 0), ends[i - 1] + 1, 0))
        above = np.append(best[i - 1, 1:], 0)
        best[i] = np.maximum.accumulate(np.maximum(np.maximum(ends[i], above), best[i - 1]))
    rows, diagonals = [], []
    i, k = m, width - 1
    while i > 0 and best[i, k] > 0:
        if ends[i, k] == best[i, k]:
            while True:  # back along the run to where it began
                if ends[i - 1, k] > 0 and ends[i, k] == ends[i - 1, k] + 1:
                    rows.append(i - 1)
                    diagonals.append(k)
                    i -= 1
                    continue
                rows += range(i - 1, i - 1 - run, -1)
                diagonals += [k] * run
                i -= run
                break
        elif k and best[i, k - 1] == best[i, k]:
            k -= 1
        elif k + 1 < width and best[i - 1, k + 1] == best[i, k]:
            i, k = i - 1, k + 1
        else:
            i -= 1
    own = np.array(rows[::-1], np.int64)
    return own, own + shift + np.array(diagonals[::-1], np.int64) - DRIFT


def _clusters(places: np.ndarray, shifts: np.ndarray, least: int) -> Iterator[int]:
    """Diagonals around which at least `least` windows gather, most first; each hit is used once."""
    while len(shifts):
        order = np.argsort(shifts, kind="stable")
        places, shifts = places[order], shifts[order]
        upto = np.searchsorted(shifts, shifts + DRIFT, "right")
        i = int(np.argmax(upto - np.arange(len(shifts))))
        part = slice(i, int(upto[i]))
        if len(np.unique(places[part])) < least:
            if part.stop - part.start < least:
                return
        else:
            values, count = np.unique(shifts[part], return_counts=True)
            yield int(values[np.argmax(count)])
        places, shifts = np.delete(places, part), np.delete(shifts, part)


def matches(items: Items, tokens: np.ndarray, kinds: np.ndarray, values: np.ndarray, share: float) -> list[tuple]:
    """Items found in one text: (item number, windows, matched, slots, changed slots, first token, tokens, covered)."""
    hits = []
    for size in items.sizes:
        grams = words.shingles(tokens, size)
        h, item, place = items.window[size]
        low = np.searchsorted(h, grams, "left")
        own = np.flatnonzero((low < len(h)) & (h[np.minimum(low, len(h) - 1)] == grams))
        if len(own):
            count = np.searchsorted(h, grams[own], "right") - low[own]
            spot = np.repeat(low[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            hits.append(np.stack([item[spot], np.repeat(own, count) - place[spot], place[spot]]))
    if not hits:
        return []
    out = []
    hits = np.concatenate(hits, axis=1)
    hits = hits[:, np.argsort(hits[0], kind="stable")]
    found, first = np.unique(hits[0], return_index=True)
    for i, mine in zip(found.tolist(), np.split(hits, first[1:], axis=1)):
        item, use = items.tokens[i], items.windows[i]
        plain = items.kinds[i] == 0
        least = max(min(len(item), LEAST_TOKENS), share * len(item))
        for shift in _clusters(mine[2], mine[1], max(1, len(use) // 10)):
            at, to = align(item, tokens, shift)
            if len(at) < least or plain[at].sum() < share * plain.sum():
                continue
            slot = items.kinds[i][at] > 0
            a, b = items.values[i][at[slot]], values[to[slot]]
            inner = (at[slot] > 0) & (at[slot] < len(item) - 1)  # at its ends a slot may have grown by what stands before or after
            if not _consistent(a[inner], b[inner]):
                continue
            # windows whose tokens all stand on one diagonal
            size = min(WINDOW, len(item))
            gap = np.full(len(item), -1 - len(tokens) - len(item))
            gap[at] = to - at
            whole = np.lib.stride_tricks.sliding_window_view(gap, size)[use]
            matched = int(((whole == whole[:, :1]).all(axis=1) & (whole[:, 0] >= -len(item))).sum())
            out.append((i, len(use), matched, int(slot.sum()), int((a != b).sum()), int(to[0]), len(item), len(at)))
            break
    return out


def _scan(items: Items, column: pa.Array, share: float) -> Iterator[list[tuple]]:
    """The items found in each text."""
    data, offsets = words.utf8(column)
    for i, j in words.blocks(offsets):
        token, kind, value, at = templates(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        near = np.zeros(len(token) + 1, np.int64)  # texts without any hit are passed over at once
        for size in items.sizes:
            hit = _among(words.shingles(token, size), items.window[size][0])
            near[:len(hit)] += hit
        near = np.concatenate([[0], np.cumsum(near)])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield matches(items, token[a:b], kind[a:b], value[a:b], share) if near[b] > near[a] else []


def _passes(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in parts of about PASS_WINDOWS windows, each small enough for driver and tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, kind, value, at = templates(*words.utf8(batch.column("text")))
            lists = [pa.LargeListArray.from_arrays(pa.array(at), pa.array(x)).cast(pa.list_(t))
                     for x, t in ((token.view(np.int64), pa.int64()), (kind, pa.int8()), (value.view(np.int64), pa.int64()))]
            yield pa.record_batch([batch.column("item_id"), *lists], names=["item_id", "tokens", "kinds", "slots"])

    rows = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(
        run, "item_id long, tokens array<long>, kinds array<byte>, slots array<long>")
    total = rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    parts = -(-total // PASS_WINDOWS)
    for k in range(parts):
        table = rows.where(F.pmod(F.xxhash64("item_id", "tokens"), F.lit(parts)) == k).toArrow()
        cells = [[x.values.to_numpy(zero_copy_only=False) for x in table.column(c).combine_chunks()] for c in ("tokens", "kinds", "slots")]
        yield index(table.column("item_id").to_pylist(), [(t.view(np.uint64), k, v.view(np.uint64)) for t, k, v in zip(*cells)])


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """Benchmark items that stand in documents: one row per document row and item.

    Gives doc_id, item_id, windows, matched, slots, changed (slots that hold another value), start (template
    token), tokens and covered. At least `share` of an item's template tokens, and of its plain ones, must stand
    in the text in runs of RUN tokens or more, LEAST_TOKENS at least or all of a shorter item, in order, with
    consistent slots; up to DRIFT words may be put in or left out on the way, any number replaced. docs: doc_id, text; benchmark: item_id, text; other columns are left out. Null or empty
    texts match nothing; repeated rows give repeated matches; null ids stay null; empty tables give
    an empty table. Benchmarks of any size are taken in passes of bounded size over the documents.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, windows int, matched int, slots int, changed int, start int, tokens int, covered int"
    out = docs.sparkSession.createDataFrame([], schema)

    def scan(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(doc, items.ids[m[0]], *m[1:]) for doc, found in zip(
                    batch.column("doc_id").to_pylist(), _scan(items, batch.column("text"), share)) for m in found]
                columns = list(zip(*rows)) or [()] * 9
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 7]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["doc_id", "item_id", "windows", "matched", "slots", "changed", "start", "tokens", "covered"])

        return run

    for items in _passes(benchmark):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(scan(items), schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, in whose text no benchmark item stands. No row is shuffled."""
    small_batches(docs.sparkSession)

    def clean(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in _scan(items, batch.column("text"), share)], pa.bool_()))

        return run

    schema = docs.schema
    for items in _passes(benchmark):
        docs = docs.mapInArrow(clean(items), schema)
    return docs
