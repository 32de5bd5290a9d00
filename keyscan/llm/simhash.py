"""SimHash near-duplicates by a self-join of binary tries.

A trie over 64-bit fingerprints is joined with itself: a pair of nodes is followed down to the pairs of
their children, differing bits add up, and a pair is dropped once they exceed the budget. To spread this
over tasks, ``budget + 1`` rotations of the bits each have a trie; two fingerprints within the budget
agree in one of ``budget + 1`` blocks of bits, so in the rotation that puts this block on top only pairs of a
node with itself need following at the block's depth. Each such subtrie is a task's work; one with very many
fingerprints is followed ``SPLIT_BITS`` levels further first, and its node pairs become separate work.
Fingerprints are joined once each, whatever number of documents has them; a subtrie's links leave the task as a
spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, give_back, release, small_batches

SPLIT_BITS = 6
#: A subtrie of at least so many fingerprints, and of at most 4 to the power of the budget, is compared directly: on its
#: dense levels a pair differs in half of the bits, so that the walk would drop next to none.
DIRECT = 64
#: Texts of one candidate group that are held against each other at once; groups are of texts with a shared shingle
#: whose fingerprints lie within so many bits of each other, both kinds.
GROUP, PARTED = 512, (24, 26)
#: Texts that tell which shingles are common.
SAMPLED = 8192
#: Leading shingles that are dealt to one part at most on average.
PART = 1 << 18
#: Node pairs that are followed at once.
FRONTIER = 1 << 17
#: Links that a task makes one spanning forest of before stars are drawn.
CONTRACTED = 1 << 18


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, A-Z lower-cased; of all words if they are fewer; no word: none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    joined, n = b" ".join(words), len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if n else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the shingles of a text; a single shingle is the fingerprint itself; no word: 0."""
    return majority(shingles(text, width))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def with_fingerprint(df: DataFrame, text: str, *carry: str, width: int = 3) -> DataFrame:
    """``*carry, fp``: the fingerprint of each whole text as a signed long. Null text: as empty, so 0."""
    small_batches(df.sparkSession)
    rows = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), F.col(text).alias("t"))
    kinds = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(rows.schema.fields[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*b.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, kinds + "fp long").toDF(*carry, "fp")


class Forest:
    """Links among 0..n-1, kept as each one's smallest known partner."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p = self.parent
        while len(a):
            a, b = p[a], p[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(q := p[p], p):
                p[:] = q


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what the links (a, b) connect: of each node to the least of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.link(at[: len(a)], at[len(a) :])
    child = np.flatnonzero(forest.parent != np.arange(len(nodes)))
    return nodes[child], nodes[forest.parent[child]]


def trie_join(values: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, bits: int, budget: int, second: np.ndarray | None = None, within: int = 64) -> np.ndarray:
    """The forest of links of many subtries at once.

    ``values``: uint64, sorted and distinct within each subtrie, which spans ``lo:hi``; its fingerprints agree above
    the lowest ``bits`` bits. Where ``lo < mid < hi`` the first part's fingerprints are joined to the second's alone,
    both parts having their own bits above; else all are joined with all. Linked fingerprints have ``second`` values that
    differ in ``within`` bits at most.
    """
    forest = Forest(len(values))
    second = values if second is None else second
    two = (lo < mid) & (mid < hi)
    top = np.uint64((1 << bits) - 1)
    used = np.where(two, np.bitwise_count((values[lo] & ~top) ^ (values[np.minimum(mid, len(values) - 1)] & ~top)), 0)
    start = np.stack([lo, np.where(two, mid, hi), np.where(two, mid, lo), hi, budget - used.astype(np.int64)])
    start = start[:, start[4] >= 0]
    size = start[3] - start[0]
    direct = (size >= DIRECT) & (size <= 4**budget)
    for a0, a2, b0, b2, _ in start[:, direct].T.tolist():
        near = [np.flatnonzero(np.bitwise_count(values[max(a + 1, b0) : b2] ^ values[a]) <= budget) + max(a + 1, b0) for a in range(a0, a2)]
        a, b = np.repeat(np.arange(a0, a2), list(map(len, near))), np.concatenate(near)
        near = np.bitwise_count(second[a] ^ second[b]) <= within
        forest.link(a[near], b[near])
    stack = [(bits - 1, start[:, ~direct])]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, half:]), (bit, pairs[:, :half])]
            continue
        # pairs of single fingerprints need no further walk
        single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        a, b = pairs[0, single], pairs[2, single]
        near = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (np.bitwise_count(second[a] ^ second[b]) <= within) & (a != b)
        forest.link(a[near], b[near])
        pairs = pairs[:, ~single]
        if not pairs.shape[1] or bit < 0:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        c = ones[bit]
        a0, a2, b0, b2, left = pairs
        a1, b1 = a2 - (c[a2] - c[a0]), b2 - (c[b2] - c[b0])
        same = a0 == b0
        children = [np.stack([a0, a1, b0, b1, left]), np.stack([a1, a2, b1, b2, left]), np.stack([a0, a1, b1, b2, left - 1]), np.stack([a1, a2, b0, b1, left - 1])[:, ~same]]
        after = np.concatenate(children, axis=1)
        alone = (after[0] == after[2]) & (after[1] - after[0] < 2)
        after = after[:, (after[0] < after[1]) & (after[2] < after[3]) & (after[4] >= 0) & ~alone]
        if after.shape[1]:
            stack.append((bit - 1, after))
    return forest.parent


def blocks(budget: int) -> list[tuple[int, int]]:
    """(rotation, depth) of each trie: together the depths are 64 bits."""
    n = budget + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _joined(budget: int, after_split: bool, within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            """rows: trie, group, side, value, second value; whole groups only."""
            new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
            edges = []
            for trie, (turn, depth) in enumerate(blocks(budget)):
                mine = rows[:, 0] == trie
                r, start = rows[mine], np.flatnonzero(new[mine])
                if not len(r):
                    continue
                stop = np.append(start[1:], len(r))
                ones = np.concatenate([[0], np.cumsum(r[:, 2])])
                mid = stop - (ones[stop] - ones[start])
                values = r[:, 3].copy().view(np.uint64)
                bits = 64 - depth - (SPLIT_BITS if after_split else 0)
                parent = trie_join(values, start, mid, stop, bits, budget, r[:, 4].copy().view(np.uint64), within)
                child = np.flatnonzero(parent != np.arange(len(parent)))
                back = lambda v, t=turn: v if not t else (v >> np.uint64(t)) | (v << np.uint64(64 - t))
                edges.append(np.stack([back(values[child]), back(values[parent[child]])]))
            # one group's tries differ in their roots; with the least one in all, their links are the same rows
            out = spanning(*(np.concatenate(edges, axis=1) if edges else np.empty((2, 0), np.uint64)).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"])

        for b in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1))
            size += len(held[-1])
            if size > 1 << 18:
                rows = np.concatenate(held)
                last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
                whole = last[-1] + 1 if len(last) else 0
                if whole:
                    yield solve(rows[:whole])
                held, size = [rows[whole:]], len(rows) - whole
        if size:
            yield solve(np.concatenate(held))
        give_back()

    return run


def links(fps: DataFrame, budget: int = 2, split_over: int = 20_000, within: int | None = None) -> DataFrame:
    """``a, b``: links that connect just what the pairs of distinct fingerprints ``fp`` within the budget connect.

    With ``within``, only pairs whose other fingerprints ``fp2`` differ in so many bits at most. A subtrie of over
    ``split_over`` fingerprints is followed further before it is dealt out. Nulls take no part.
    """
    small_batches(fps.sparkSession)
    turned = [
        F.struct(F.lit(k).cast("long").alias("trie"), (F.col("fp") if not turn else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn))).alias("value"), F.lit(64 - depth).alias("below"))
        for k, (turn, depth) in enumerate(blocks(budget))
    ]
    rows = fps.where("fp is not null").select(F.explode(F.array(*turned)).alias("x"), F.col("fp" if within is None else "fp2").alias("second")).select("x.*", "second")
    rows = rows.withColumn("node", F.expr("shiftrightunsigned(value, below)"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("trie", "node"))).where("n > 1")
    whole = rows.where(F.col("n") <= split_over).select("trie", "node", F.lit(0).cast("long").alias("side"), "value", "second")
    child = F.expr(f"shiftrightunsigned(value, below - {SPLIT_BITS}) & {(1 << SPLIT_BITS) - 1}")
    near = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget]
    parts = (
        rows.where(F.col("n") > split_over)
        .withColumn("child", child)
        .withColumn("other", F.explode(F.transform(F.array(*map(F.lit, near)), lambda m: F.col("child").bitwiseXOR(m.cast("long")))))
        .select(
            "trie",
            (F.col("node") * (1 << (2 * SPLIT_BITS)) + F.least("child", "other") * (1 << SPLIT_BITS) + F.greatest("child", "other")).alias("node"),
            (F.col("child") > F.col("other")).cast("long").alias("side"),
            "value",
            "second",
        )
    )
    unsigned = F.col("value").bitwiseXOR(F.lit(-(1 << 63)))
    found = [
        part.repartition("trie", "node").sortWithinPartitions("trie", "node", "side", unsigned).mapInArrow(_joined(budget, split, 64 if within is None else within), "a long, b long")
        for part, split in ((whole, False), (parts, True))
    ]
    return found[0].unionByName(found[1])


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for each node of the links (a, b) other than its component's smallest, that smallest one.

    Bounded parts of the links each become a spanning forest first, so that a hub or a dense group leaves at most a link a
    node and part. Then large stars and small stars in turn: every node's larger neighbours, then its smaller ones, are
    linked to the least of its neighbourhood, until nothing changes; the rounds grow with the logarithm of a component's
    size, whatever its shape. A node's links meet only as partial minima; the least of each is joined back by a shuffle
    that may be split. Finished rounds are let go of, as their small files add up.
    """
    small_batches(edges.sparkSession)
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if parts := -(-links.count() // CONTRACTED):
        links = cut(links.coalesce(parts).mapInArrow(_contracted, "u long, v long").distinct())
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    known = None
    while (now := state(links)) != known and now[0]:
        known = now
        links = _starred(links)
        release(edges.sparkSession)
    return links.toDF("node", "root")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links ``u, v`` of each ``CONTRACTED`` rows as a spanning forest."""
    held: list[np.ndarray] = []
    size = 0

    def forest() -> pa.RecordBatch:
        u, v = spanning(*np.concatenate(held, axis=1))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
        size += b.num_rows
        if size >= CONTRACTED:
            yield forest()
            size = 0
    if held:
        yield forest()


def _starred(links: DataFrame) -> DataFrame:
    """The links ``u, v`` after large and small stars; what they were made by may be let go of."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v"))
    return cut(small.where("u <> v").distinct())


def near_duplicates(df: DataFrame, key: str, text: str, width: int = 3, budget: int = 2) -> DataFrame:
    """``key, fp, component_id``: each row's fingerprint and the smallest key that links of the budget reach.

    Rows with equal fingerprints are linked, empty and null texts (fingerprint 0) among themselves like any
    others. Repeated rows come back as often; a null key belongs to a component but never names it; an empty
    table gives an empty result; other columns are left out.
    """
    docs = cut(with_fingerprint(df, text, key, width=width).toDF("key", "fp"))
    distinct = docs.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(links(distinct.select("fp"), budget))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(least, "root").select("fp", "component_id")
    return docs.join(label, "fp").select(F.col("key").alias(key), "fp", "component_id")


def alike(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just what the pairs of sets of a Jaccard similarity of ``least`` or more connect."""
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.full(len(times), -1)
    shared[times > 1] = np.arange(int((times > 1).sum()))
    column, both = shared[at], np.zeros((len(sets), len(sets)), np.float32)
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int((times > 1).sum()), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        both += has @ has.T
    union = n[:, None] + n[None, :] - both
    forest = Forest(len(sets))
    forest.link(*np.nonzero(np.triu((both > 0) & (both >= least * union - 1e-3), 1)))
    child = np.flatnonzero(forest.parent != np.arange(len(sets)))
    return child, forest.parent[child]


def leading(text: str | None, words: int, least: float) -> np.ndarray:
    """So many of a text's distinct shingles, the least first, that a text with a similarity of ``least`` shares one."""
    return first_of(shingles(text, words), least)


def first_of(hashes: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The same of shingles; those that are ``common`` come last. Any order that all texts share will do."""
    x = np.unique(hashes)
    if common and len(common[0]) and len(x):
        at = np.minimum(np.searchsorted(common[0], x), len(common[0]) - 1)
        x = x[np.argsort(np.where(common[0][at] == x, common[1][at], 0), kind="stable")]
    return x[: len(x) - math.ceil(least * len(x) - 1e-3) + 1]


def common_shingles(rows: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in several of some ``SAMPLED`` texts, rising, and in how many each; they only set an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(t, words)).view(np.int64))], ["x"])
        give_back()

    sample = rows.select(text).sample(min(1.0, SAMPLED / max(1, rows.count())), seed=42)
    found = sample.mapInArrow(run, "x long").groupBy("x").count().where("count > 3").orderBy(F.desc("count"), "x").limit(1 << 16).collect()
    x, n = (np.array([r[k] for r in found], np.int64) for k in range(2))
    order = np.argsort(x.view(np.uint64))
    return x.view(np.uint64)[order], n[order]


#: What is dealt out of a text for each of its leading shingles.
RECORD = np.dtype([("key", "<i8"), ("u", "<i8"), ("fp", "<i8"), ("fp2", "<i8"), ("n", "<i4"), ("place", "<i4")])


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The records of the texts ``u, root, fp, fp2, shingles`` by the part that their key falls to, packed."""
    for b in batches:
        u, root, fp, fp2 = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
        lists = [np.asarray(x, np.int64) for x in b.column(4).to_pylist()]
        n = np.array([len(x) for x in lists])
        owner = np.repeat(np.arange(len(n)), n)
        if not len(owner):
            continue
        out = np.empty(len(owner), RECORD)
        mixed = np.concatenate(lists).view(np.uint64) ^ (root.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[owner]
        out["key"], out["u"], out["fp"], out["fp2"], out["n"] = mixed.view(np.int64), u[owner], fp[owner], fp2[owner], n[owner]
        out["place"] = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
        # leading hashes are small ones, so their low bits tell the part
        part = (mixed % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held, first = np.unique(part[order], return_index=True)
        blobs = [x.tobytes() for x in np.split(out[order], first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(blobs, pa.binary())], ["part", "records"])
    give_back()


def _sharing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of the records in rows ``part, records``, sorted by part, that have one key and near fingerprints.

    ``n`` is how many leading shingles a text has and ``place`` the shared one's among them; both bound what two texts can
    have in common, and pairs that cannot reach ``least`` are no links.
    """

    def possible(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most, fewest = np.ceil(n / (1 - least)), (n - 1.01) / (1 - least)
        shared = np.minimum(place[a], place[b]) + np.minimum(most[a] - place[a], most[b] - place[b])
        return (1 + least) * shared >= least * (fewest[a] + fewest[b])

    def solve(records: np.ndarray) -> pa.RecordBatch:
        records = records[np.argsort(records["key"], kind="stable")]
        key, u, fp, fp2, n, place = (np.ascontiguousarray(records[k]) for k in RECORD.names)
        forest, at = Forest(len(key)), np.arange(len(key) - 1)
        apart = 1
        while len(at := at[at + apart < len(key)]) and len(at := at[key[at] == key[at + apart]]):
            near = at[np.bitwise_count((fp[at] ^ fp[at + apart]).view(np.uint64)) <= PARTED[0]]
            near = near[np.bitwise_count((fp2[near] ^ fp2[near + apart]).view(np.uint64)) <= PARTED[1]]
            near = near[possible(n, place, near, near + apart)]
            if len(near):
                forest.link(near, near + apart)
            apart += 1
        child = np.flatnonzero(forest.parent != np.arange(len(key)))
        pairs = spanning(u[child], u[forest.parent[child]])
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    held, now = [], None
    for b in batches:
        for part, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if part != now and held:
                yield solve(np.concatenate(held))
                held = []
            now = part
            held.append(np.frombuffer(records, RECORD))
    if held:
        yield solve(np.concatenate(held))
    give_back()


def parted(large: DataFrame, shingled: DataFrame, least: float = 0.8) -> DataFrame:
    """``u, root``: smaller groups of the groups ``u, root, fp, fp2``, which part no texts that are alike.

    Alike texts share a leading shingle (``u, shingles``). Of a group's texts with a leading shingle in common those are
    linked whose fingerprints differ in ``PARTED`` bits at most and that can reach ``least`` by their numbers of shingles
    and the shared one's places. Texts are not moved for this. Who is linked to none is in no group.
    """
    dealt = shingled.join(large, "u").groupBy("u", "root", "fp", "fp2").agg(F.first("shingles").alias("shingles"))
    rows = shingled.agg(F.sum(F.size("shingles"))).first()[0] or 0
    parts = max(int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))
    blobs = dealt.select("u", "root", "fp", "fp2", "shingles").mapInArrow(lambda batches: _dealt(batches, parts), "part long, records binary")
    found = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(lambda batches: _sharing(batches, least), "a long, b long")
    tree = components(found)
    return tree.select(F.col("node").alias("u"), "root").unionByName(tree.select(F.col("root").alias("u"), "root").distinct())


def similar(df: DataFrame, key: str, text: str, words: int = 5, least: float = 0.8) -> DataFrame:
    """``key, component_id``: the smallest key that pairs of texts with a similarity of ``least`` or more reach.

    The similarity is Jaccard's, exact, over runs of ``words`` words. Candidates are groups of texts linked by pairs that
    share a leading shingle, as all alike texts do, and whose fingerprints of three and of ``words`` words lie within
    ``PARTED`` bits (``parted``). Such pairs are looked for within a shingle alone: at these widths chance brings random
    fingerprints together, so that a join of tries would link nearly all texts and grow with their square. In each group
    every text is held against every other, in blocks of ``GROUP`` where it is large. Fingerprints are drawn by
    hashes, so a pair can lie outside the bits by chance; of the pairs at 0.8 or more in the samples none does.
    Texts of the same words are linked, empty and null ones too. Rows and keys are treated as in ``near_duplicates``.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"))

    def same(t: str | None) -> int:
        """Of the words: equal for texts with equal shingles in order."""
        return xxhash.xxh3_64_intdigest(b" ".join((t or "").encode("utf-8", "replace").lower().split()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leading shingles once for each distinct text of the partition."""
        seen = set()
        for b in batches:
            fp, fp2, u, first = [], [], [], []
            for t in b.column(1).to_pylist():
                hashes = shingles(t, words)
                fp.append(fingerprint(t))
                fp2.append(majority(hashes))
                u.append(same(t))
                first.append(None if u[-1] in seen else first_of(hashes, least, common).view(np.int64))
                seen.add(u[-1])
            made = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, fp2, u)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, pa.array(first, pa.list_(pa.int64()))], ["key", "fp", "fp2", "u", "shingles"])
        give_back()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct text of the partition."""
        seen = set()
        for b in batches:
            found = {}
            for t in b.column(1).to_pylist():
                if (u := same(t)) not in seen:
                    seen.add(u)
                    found[u] = t
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.string())], ["u", "t"])
        give_back()

    def verified(table: pa.Table) -> pa.Table:
        u = table.column("u").to_numpy()
        a, b = alike([np.unique(shingles(t, words)) for t in table.column("t").to_pylist()], least)
        if table.num_rows > DIRECT:
            give_back()
        return pa.table({"a": u[a], "b": u[b]})

    common = common_shingles(rows, "t", words)
    docs = cut(rows.mapInArrow(marked, "key long, fp long, fp2 long, u long, shingles array<long>"))
    named = docs.groupBy("u").agg(F.min("key").alias("least"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"))
    groups = cut(parted(named.select("u", F.lit(0).alias("root"), "fp", "fp2"), docs.where("shingles is not null").select("u", "shingles"), least))
    blocks = groups.groupBy("root").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("blocks"))
    wanted = groups.join(blocks, "root").select("u", "root", "blocks", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("own"))
    texts = rows.mapInArrow(once, "u long, t string").join(wanted, "u").groupBy("u", "root", "blocks", "own").agg(F.first("t").alias("t"))
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.where((F.col("blocks") < 2) | (F.col("own") != F.col("other")))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "u", "t")
    tree = components(dealt.groupBy("root", "i", "j").applyInArrow(verified, "a long, b long"))
    joined = named.join(tree, F.col("u") == F.col("node"), "left").select("u", "least", F.coalesce(tree["root"], F.col("u")).alias("top"))
    label = joined.join(joined.groupBy("top").agg(F.min("least").alias("component_id")), "top").select("u", "component_id")
    return docs.join(label, "u").select(F.col("key").alias(key), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
