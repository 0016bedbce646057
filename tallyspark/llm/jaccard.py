"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles. Equal sets are one node. Sets that share a band of
min-hashes are put in groups of similar sets; a group stores the union of its members' tokens.
A query set is bounded against a group by its overlap with that union: a member S can only link
if the overlap reaches the threshold share of the query, since the union of both sets is at least
the query. Only groups that pass are opened, and members are compared exactly.

Which query meets which group is decided by 24 bands of three min-hashes: two sets at Jaccard
0.85 miss all of them with probability (1 - 0.85**3)**24 < 2e-10, more similar ones less. All that
meet are compared exactly, nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import words
from tallyspark.llm.graph import components
from tallyspark.llm.store import saved, small_batches

BANDS, ROWS = 24, 3
#: Tokens of one stored group; families of similar sets that have more are split by hash into several.
GROUP_TOKENS = 1 << 17
_rng = np.random.default_rng(77)
_MULT = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def bands(tokens: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of min-hashes."""
    low = np.full(len(_MULT), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(tokens), 1024):
        part = np.multiply.outer(_MULT, tokens[i:i + 1024])
        part += _ADD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    low = words.mix(low).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, k])
    return key


def signature(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; unequal sets share one with probability 2**-64 a pair."""
    return int(words.mix(np.array([words.mix(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))], np.uint64))[0])


def _sketch(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # sets whose bands this task has given already
        for batch in batches:
            n, sigs, keys = [], [], []
            for tokens in words.shingle_sets(batch.column("text"), size):
                sig = signature(tokens)
                n.append(len(tokens))
                sigs.append(sig)
                fresh = len(tokens) > 0 and sig not in known
                keys.append(bands(tokens).view(np.int64) if fresh else np.zeros(0, np.int64))
                known.add(sig)
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                 pa.array(np.array(sigs, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                schema=schema,
            )

    return run


def _tokens(size: int):
    schema = pa.schema([("sig", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(words.shingle_sets(batch.column("text"), size))
            sigs = np.array([signature(x) for x in sets], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(sigs), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], schema=schema)

    return run


def _open_groups(percent: int):
    """Links between two stored groups: bound every query by the other's token union, open if it passes.

    Only sets of components not joined yet are compared, and a link joins its components at once,
    so a group of near copies costs little more than one comparison a member.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = [[batch.column(c + n) for c in ("comps", "sizes", "tokens")] for n in "12"]
            a, b = [], []
            for i in range(batch.num_rows):
                (c1, n1, t1), (c2, n2, t2) = ([c[i].values.to_numpy(zero_copy_only=False) for c in part] for part in side)
                for x, y in linked(c1, n1, t1, c2, n2, t2, percent):
                    a.append(x)
                    b.append(y)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def linked(c1, n1, t1, c2, n2, t2, percent: int) -> list[tuple[int, int]]:
    """Pairs of components that a link between the groups joins; each group: components, sizes, tokens of its sets."""
    root = {int(c): int(c) for c in (*c1, *c2)}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    union = np.unique(t2)
    member = np.repeat(np.arange(len(n2)), n2)
    out, stop = [], 0
    for c, n in zip(c1.tolist(), n1.tolist()):
        query, stop = t1[stop:stop + n], stop + n
        inside = query[union[np.minimum(np.searchsorted(union, query), len(union) - 1)] == query]
        if 100 * len(inside) < percent * n:
            continue
        other = np.array([find(int(x)) for x in c2])
        open_to = (other != find(c)) & (100 * np.minimum(n, n2) >= percent * np.maximum(n, n2))
        if not open_to.any():
            continue
        rows = np.flatnonzero(open_to[member])
        both = np.bincount(member[rows[np.isin(t2[rows], inside)]], minlength=len(n2))
        for j in np.flatnonzero(open_to & (100 * both >= percent * (n + n2 - both))).tolist():
            x, y = find(c), find(int(c2[j]))
            if x != y:
                root[y] = x
                out.append((c, int(c2[j])))
    return out


def jaccard_components(docs: DataFrame, percent: int = 85, size: int = 4) -> DataFrame:
    """Group the documents whose sets of `size`-word shingles link at `percent` / 100 or more.

    docs: doc_id, text and any other columns, which are left out. Gives doc_id, n_shingles and
    component_id, the smallest doc_id reachable by links. A document without text or words has an
    empty set, links with nothing and is its own component; fewer words than `size` are one
    shingle; repeated rows come out once each, and one doc_id may have several texts. Rows of null
    doc_id stay; a set that only such rows have takes part in no link. An empty table gives an
    empty table.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sketch = saved(docs.mapInArrow(_sketch(size), "doc_id long, n_shingles long, sig long, bands array<long>"))
    keys = sketch.select("sig", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low <> high")
    meet = saved(keys.join(shared.select("key", "low"), "key").distinct())

    nodes = meet.groupBy("sig").agg(F.lit(1).alias("one")).select("sig")
    texts = sketch.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id")).join(nodes, "sig")
    sets = saved(
        docs.join(texts.select("doc_id"), "doc_id", "left_semi").select("text")
        .mapInArrow(_tokens(size), "sig long, tokens array<long>").dropDuplicates(["sig"])
    )

    # first the lowest set of each band stands for it: most groups are joined by these links alone
    pairs = meet.where("sig <> low").select(F.least("sig", "low").alias("a"), F.greatest("sig", "low").alias("b")).distinct()
    left = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    links = pairs.join(left, "a").join(right, "b").where(
        both * 100 >= percent * (F.size("left") + F.size("right") - both)
    ).select("a", "b")
    roots = components(links)
    place = saved(
        nodes.join(roots, nodes["sig"] == roots["node"], "left").select("sig", F.coalesce("root", "sig").alias("comp"))
    )

    # what bands still hold apart is put in groups of similar sets: by the lowest set any band shows
    apart = meet.join(place, "sig")
    split = apart.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    apart = saved(apart.join(split, "key"))
    similar = apart.groupBy("sig").agg(F.min("low").alias("family"), F.first("comp").alias("comp")).join(sets, "sig")
    parts = similar.groupBy("family").agg(F.ceil(F.sum(F.size("tokens")) / GROUP_TOKENS).alias("parts"))
    stored = saved(
        similar.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("sig", F.lit(3)), "parts"))
        .select("sig", F.xxhash64("family", "part").alias("group"), "comp", "tokens")
    )
    groups = saved(
        stored.groupBy("group").agg(F.collect_list(F.struct("comp", "tokens")).alias("m")).select(
            "group", F.col("m.comp").alias("comps"), F.expr("transform(m, x -> size(x.tokens))").alias("sizes"),
            F.flatten("m.tokens").alias("tokens"))
    )
    at = apart.select("key", "sig").join(stored.select("sig", "group"), "sig").select("key", "group").distinct()
    asks = at.join(at.withColumnRenamed("group", "other"), "key").where("group <= other").select("group", "other").distinct()
    first, second = (groups.select(F.col("group").alias(g), *[F.col(c).alias(c + n) for c in ("comps", "sizes", "tokens")])
                     for g, n in (("group", "1"), ("other", "2")))
    opened = asks.join(first, "group").join(second, "other").drop("group", "other").mapInArrow(_open_groups(percent), "a long, b long")
    more = components(opened)
    final = (
        place.join(more, place["comp"] == more["node"], "left").select("sig", F.coalesce("root", "comp").alias("comp"))
    )
    classes = sketch.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least_doc")).join(final, "sig", "left")
    classes = classes.select("sig", "least_doc", F.coalesce("comp", "sig").alias("comp"))
    heads = classes.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    named = classes.join(heads, "comp").select("sig", "component_id")
    out = sketch.select("doc_id", "n_shingles", "sig").join(named, "sig", "left")
    return out.select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
