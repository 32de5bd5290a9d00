"""Removal of repeated byte strings by suffix sorting.

Every byte that lies in a string of ``width`` bytes which also starts elsewhere goes. Sorting all suffixes of a corpus
at once is not needed for that: the position of the least hash of a string's ``GRAM``-grams is the same wherever the
string stands, so each text is cut into runs of window starts that share this position, and only runs whose gram stands
at two places or more can hold a repeated string. These runs, dealt out by gram, are the shards. Equal runs of one gram
are one row with a number of copies. A gram with very many different runs is refined: its windows are halved by where in
them the gram stands, and each half is dealt out by the longer string that all its windows hold, again and again while
one holds too many; a single window is its own key, so this ends. A shard's task writes its runs to disk and sorts their
suffixes by external induced sorting (``induced``); a window is repeated if it shares ``width`` bytes with a neighbour in
that order, or stands in a run that has copies. Matches never cross texts, as a run never does.
"""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import release, remove
from .common import give_back, new_dir, small_batches, utf8
from .induced import falling, mapped

WIDTH, GRAM = 200, 32
#: Window starts looked at together, and bytes of runs a shard: its task needs some 25 bytes of scratch disk for each.
BLOCK, SHARD_BYTES = 1 << 22, 2 << 20
#: A gram of more rows than this is known to repeat without a join; a key with more different runs is refined.
HOT_ROWS, HOT_RUNS = 1 << 14, 1 << 15
#: How many such keys are looked for at once, and counted closely: the bound of what is broadcast.
HOT_KEYS, TRACKED = 10_000, 100_000
_BITS = np.uint64(24)
#: A run's place in its text as one long: first window start, number of window starts less one, and place of the gram.
_FIELD = 12
#: The columns of different runs: ``at`` is the gram's place in the run, ``lo`` to ``hi`` its places in the run's windows.
_RUNS = ("key", "rid", "run", "at", "lo", "hi", "copies")


def _gram(width: int) -> int:
    return 1 << (min(GRAM, width).bit_length() - 1)


def content_id(payload: Column) -> Column:
    """16 bytes that name a payload."""
    return F.unhex(F.md5(payload))


def runs(text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first and last window start, place of the gram) of each run of a text of uint8.

    None if the text is shorter than a window; the place counts from the first window start.
    """
    keys, firsts, lasts, places = [np.empty(0, np.uint64)], *([np.empty(0, np.int64)] for _ in range(3))
    gram = _gram(width)
    for at in range(0, len(text) - width + 1, BLOCK):
        part = text[at : at + BLOCK + width - 1]
        h, have, power = part.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
        while have < gram:  # gram hashes by doubling
            h = h[:-have] * np.uint64(power) + h[have:]
            have, power = 2 * have, power * power % (1 << 64)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        least = (mixed >> _BITS << _BITS) | np.arange(len(h), dtype=np.uint64)
        span, wanted = 1, width - gram + 1
        while span * 2 <= wanted:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wanted:
            least = np.minimum(least[: len(least) - (wanted - span)], least[wanted - span :])
        place = (least & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        keys.append(mixed[place[first]])
        firsts.append(first + at)
        lasts.append(np.append(first[1:], len(place)) - 1 + at)
        places.append(place[first] - first)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(lasts), np.concatenate(places)


_ENTRY = np.dtype([("start", np.int64), ("size", np.int64), ("skip", np.int64), ("rid", "V16")])


class Shard:
    """Runs on disk, a symbol a byte, each closed by a 1; and an entry for each that is to be reported."""

    def __init__(self, folder: str):
        self.folder, self.size, self.entries = folder, 0, 0
        self.symbols, self.index = (open(os.path.join(folder, name), "wb") for name in ("symbols", "index"))

    def add(self, run: bytes, rid: bytes | None, skip: int = 0) -> None:
        """``skip`` bytes of a run, which ``run`` lacks, are counted in what is reported; no ``rid``: it is not reported."""
        self.symbols.write((np.frombuffer(run, np.uint8).astype(np.uint16) + 2).tobytes() + b"\1\0")
        if rid is not None:
            self.index.write(np.array([(self.size, len(run), skip, rid)], _ENTRY).tobytes())
            self.entries += 1
        self.size += len(run) + 1

    def repeated(self, width: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
        """The reported runs with repeated windows: ``rid`` and the byte ranges that these cover."""
        self.symbols.write(b"\0\0")
        self.symbols.close()
        self.index.close()
        if not self.entries:
            return
        n = self.size + 1
        x = np.asarray(np.memmap(os.path.join(self.folder, "symbols"), np.uint16, "r", shape=n))
        found, before = mapped(self.folder, "found", np.uint8, n), -1
        for pos, lcp in falling(x, self.folder, width):
            long = lcp >= width
            found[pos[long]] = 1
            found[pos[:-1][long[1:]]] = 1
            if long[0] and before >= 0:
                found[before] = 1
            before = int(pos[-1])
        index = np.memmap(os.path.join(self.folder, "index"), _ENTRY, "r", shape=self.entries)
        for at in range(0, self.entries, 4096):
            for start, size, skip, rid in index[at : at + 4096].tolist():
                hits = np.flatnonzero(found[start : start + max(0, size - width + 1)])
                if len(hits):
                    yield bytes(rid), [(a + skip, b + skip) for a, b in merged(hits, hits + width)]


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Ranges joined where they touch or overlap."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return list(zip(lo[new].tolist(), hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)].tolist(), strict=True))


def _found_runs(width: int):
    """Runs of each distinct text of a batch, with how often the text stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uids = b.column(0).to_pylist()
            times = Counter(uids)
            rows = {uid: k for k, uid in enumerate(uids)}
            made = [runs(np.frombuffer(b.column(1)[k].as_buffer() or b"", np.uint8), width) for k in rows.values()]
            if not made:
                continue
            sizes = [len(k) for k, *_ in made]
            key, first, last, place = (np.concatenate(c) for c in zip(*made, strict=True))
            at = np.repeat(np.fromiter(rows.values(), np.int64, len(rows)), sizes)
            n = np.repeat(np.array([times[uid] for uid in rows], np.int64), sizes)
            spot = first << (2 * _FIELD) | (last - first) << _FIELD | place
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(at)), pa.array(spot), pa.array(n)], ["gram", "uid", "spot", "n"])
        give_back()

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of the partition, by its id."""
    seen: set[bytes] = set()
    for b in batches:
        fresh = []
        for k, uid in enumerate(b.column(0).to_pylist()):
            if uid not in seen:
                seen.add(uid)
                fresh.append(k)
        yield b.take(pa.array(fresh, pa.int64()))


def _hot(column: DataFrame, more: int) -> DataFrame | None:
    """The values of a table's only column that stand more than ``more`` times; at most ``HOT_KEYS``, the most frequent."""
    name = column.columns[0]
    found = column.agg(F.expr(f"approx_top_k(`{name}`, {HOT_KEYS}, {TRACKED})")).first()[0] or []
    rows = [(r["item"],) for r in found if r["count"] > more]
    return F.broadcast(column.sparkSession.createDataFrame(rows, f"{name} long")) if rows else None


def _refined(runs: DataFrame, width: int) -> tuple[DataFrame, DataFrame | None]:
    """Runs of which no key has very many, and ``rid, child, skip``: of which the refined ones were made, and where.

    Windows are halved by the gram's place in them. What all windows of a half hold is its key.
    """
    spark, done, links = runs.sparkSession, None, None
    while (hot := _hot(runs.select("key"), HOT_RUNS)) is not None:
        cold = runs.join(hot, "key", "left_anti").select(*_RUNS)
        done = cold if done is None else done.unionByName(cold)
        half = runs.join(hot, "key", "left_semi").where("lo < hi").withColumn("mid", F.expr("div(lo + hi, 2)").cast("int"))
        skip = F.greatest(F.lit(0), F.col("at") - F.col("mid"))
        part = lambda a, b: F.substring("run", F.lit(a) + 1 if isinstance(a, int) else a + 1, b - a)
        at, lo, mid, hi = (F.col(c) for c in ("at", "lo", "mid", "hi"))
        low = half.where(at - F.octet_length("run") + width <= mid).select(
            F.xxhash64(part(at - lo, at - mid + width), lo, mid).alias("key"), F.col("rid").alias("parent"), skip.alias("skip"), part(skip, F.octet_length("run")).alias("run"), (at - skip).alias("at"), "lo", mid.alias("hi"), "copies"
        )
        high = half.where(at > mid).select(
            F.xxhash64(part(at - mid - 1, at - hi + width), mid + 1, hi).alias("key"), F.col("rid").alias("parent"), F.lit(0).alias("skip"), part(F.lit(0), F.least(at - mid - 1 + width, F.octet_length("run"))).alias("run"), "at", (mid + 1).alias("lo"), "hi", "copies"
        )
        halves = low.unionByName(high).withColumn("rid", F.unhex(F.md5(F.concat(F.col("run"), F.encode(F.concat_ws(":", "key", "lo", "hi"), "UTF-8")))))
        paths = [new_dir(spark, "halves"), new_dir(spark, "runs")]
        halves.write.parquet(paths[0])
        halves = spark.read.parquet(paths[0])
        more = halves.select(F.col("parent").alias("rid"), F.col("rid").alias("child"), "skip")
        links = more if links is None else links.unionByName(more)
        halves.groupBy("key", "rid", "run", "at", "lo", "hi").agg(F.sum("copies").alias("copies")).select(*_RUNS).write.parquet(paths[1])
        runs = spark.read.parquet(paths[1])
    return runs.select(*_RUNS) if done is None else done.unionByName(runs.select(*_RUNS)), links


def _live(group: list[tuple], width: int) -> Iterator[tuple[tuple, int, int]]:
    """Of a key's different runs those that can share a window with another, and from where to where.

    Windows are halved by the gram's place in them; two runs share one only if they share what all windows of its half
    hold.
    """
    halves, many = [], Counter()
    digest = xxhash.xxh64_intdigest
    for _, run, at, lo, hi, _ in group:
        mid = (lo + hi) // 2
        low = (0, digest(run[at - lo : at - mid + width])) if at - len(run) + width <= mid else None
        high = (1, digest(run[at - mid - 1 : at - hi + width])) if at > mid else None
        halves.append((mid, low, high))
        many[low] += 1
        many[high] += 1
    for row, (mid, low, high) in zip(group, halves, strict=True):
        low, high = low is not None and many[low] > 1, high is not None and many[high] > 1
        if low or high:
            at, size = row[2], len(row[1])
            yield row, 0 if high else max(0, at - mid), size if low else min(size, at - mid - 1 + width)


def _sorted_shard(width: int):
    """A shard's repeated ranges, its rows sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

        def rows(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.binary()), pa.array([[{"lo": a, "hi": b} for a, b in r] for _, r in pairs], kind)], ["rid", "ranges"])

        with tempfile.TemporaryDirectory() as folder:
            shard, group, key, out = Shard(folder), [], None, []

            def close() -> None:
                """A run alone with its key has no neighbours but its copies, and is not sorted."""
                out.extend((rid, [(0, len(r))]) for rid, r, *_, copies in group if copies > 1)
                if len(group) > 1:
                    for (rid, r, *_, copies), a, b in _live(group, width):
                        shard.add(r[a:b], rid if copies < 2 else None, a)
                group.clear()

            for b in batches:
                for k, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if k != key:
                        close()
                        key = k
                    group.append(tuple(rest))
                if len(out) >= 4096:
                    yield rows(out)
                    out.clear()
            close()
            for found in shard.repeated(width):
                out.append(found)
                if len(out) >= 4096:
                    yield rows(out)
                    out.clear()
            if out:
                yield rows(out)
        give_back()

    return run


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """A text without the ranges, which rise and do not touch."""
    at, kept = 0, []
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def aligned(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of a UTF-8 text shrunk to whole characters; those that hold none go."""
    out = []
    for a, b in ranges:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _removed(characters: bool):
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, payloads = [], b.column("payload").to_pylist()
            pairs = b.column("found").flatten()
            lo, hi = (pairs.field(k).to_numpy() for k in range(2))
            edges = np.concatenate([[0], np.cumsum(b.column("found").value_lengths().to_numpy())]).tolist()
            for text, a, z in zip(payloads, edges, edges[1:], strict=False):
                ranges = merged(lo[a:z], hi[a:z])
                if characters:
                    ranges = aligned(text, ranges)
                made.append(([{"lo": x, "hi": y} for x, y in ranges], without(text, ranges)))
            if made:
                ranges, kept = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(ranges, kind), pa.array(kept, pa.binary())], ["uid", "spans", "kept"])

    return run


def _repeating(found: DataFrame) -> DataFrame:
    """The rows whose gram stands more than once, and ``hot``: whether it stands so often that no join is needed to know."""
    hot = _hot(found.select("gram"), HOT_ROWS)
    cold = found if hot is None else found.join(hot, "gram", "left_anti")
    cold = cold.withColumn("times", F.sum("n").over(Window.partitionBy("gram"))).where("times > 1").select("gram", "uid", "spot", "n")
    return cold if hot is None else cold.unionByName(found.join(hot, "gram", "left_semi").select("gram", "uid", "spot", "n"))


def repeats(payloads: DataFrame, width: int = WIDTH, characters: bool = False) -> DataFrame:
    """``uid, spans, kept``: for each distinct payload that loses bytes, the byte spans and what is left.

    ``payloads`` has one binary column, ``payload``, a row a text, null as empty; a text that stands there twice loses
    everything if it has ``width`` bytes. ``uid`` is ``content_id(payload)``. Texts shorter than ``width`` lose nothing.
    With ``characters`` spans are shrunk to whole UTF-8 characters, so that what is left is text. No rows: no rows.
    """
    if not 0 < width - _gram(width) < 1 << _FIELD:
        raise ValueError("the width is out of range")
    spark = payloads.sparkSession
    small_batches(spark)
    texts = payloads.select(F.coalesce("payload", F.lit(b"")).alias("payload")).where(F.octet_length("payload") >= width).select(content_id(F.col("payload")).alias("uid"), "payload")
    where_found, where_held, where_runs = (new_dir(spark, name) for name in ("found", "held", "runs"))
    texts.mapInArrow(_found_runs(width), "gram long, uid binary, spot long, n long").write.option("compression", "zstd").parquet(where_found)
    found = spark.read.parquet(where_found)
    by_text = _repeating(found).groupBy("uid").agg(F.collect_set(F.struct("spot", "gram")).alias("runs"), F.sum("n").alias("n"))
    held = texts.mapInArrow(_once, "uid binary, payload binary").join(by_text, "uid").groupBy("uid").agg(F.first("payload").alias("payload"), F.first("runs").alias("runs"), F.first("n").alias("n"))
    held.select("uid", "payload", "runs", (F.col("n") / F.size("runs")).cast("long").alias("copies")).write.option("compression", "zstd").parquet(where_held)
    remove(spark, where_found)
    held = spark.read.parquet(where_held)
    release(spark)
    spot = f"shiftright(x.spot, {2 * _FIELD})"
    cut = f"substring(payload, cast({spot} + 1 as int), cast((shiftright(x.spot, {_FIELD}) & {(1 << _FIELD) - 1}) + {width} as int))"
    pieces = F.expr(f"transform(runs, x -> struct(x.gram as key, {cut} as run, cast(x.spot & {(1 << _FIELD) - 1} as int) as at))")
    whole = held.select("copies", F.explode(pieces).alias("x")).select("x.*", F.lit(0).alias("lo"), F.lit(width - _gram(width)).alias("hi"), "copies")
    whole = whole.groupBy("key", "run", "at", "lo", "hi").agg(F.sum("copies").alias("copies")).withColumn("rid", content_id(F.col("run")))
    whole.select(*_RUNS).write.option("compression", "zstd").parquet(where_runs)
    release(spark)
    different, links = _refined(spark.read.parquet(where_runs), width)
    size = different.agg(F.sum(F.octet_length("run"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    dealt = different.repartition(shards, "key").sortWithinPartitions("key").select(*_RUNS)
    ranges = dealt.mapInArrow(_sorted_shard(width), "rid binary, ranges array<struct<lo:long,hi:long>>")
    if links is not None:
        ranges = _lifted(ranges, links)
    places = held.select("uid", F.explode(F.expr(f"transform(runs, x -> struct({spot} as first, unhex(md5({cut})) as rid))")).alias("x")).select("uid", "x.*")
    spans = places.join(ranges, "rid").select("uid", "first", F.explode("ranges").alias("r"))
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct((F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + F.col("r.hi")).alias("hi"))).alias("found"))
    return held.select("uid", "payload").join(spans, "uid").mapInArrow(_removed(characters), "uid binary, spans array<struct<lo:long,hi:long>>, kept binary")


def _lifted(ranges: DataFrame, links: DataFrame) -> DataFrame:
    """``ranges`` with those of refined runs brought back to the runs that they were made of, level by level."""
    spark = ranges.sparkSession
    path = new_dir(spark, "ranges")
    ranges.write.parquet(path)
    level = out = spark.read.parquet(path)
    while level.take(1):
        up = level.join(links, F.col("child") == level["rid"]).select(links["rid"], F.expr("transform(ranges, r -> struct(r.lo + skip as lo, r.hi + skip as hi))").alias("ranges"))
        path = new_dir(spark, "ranges")
        up.write.parquet(path)
        level = spark.read.parquet(path)
        out = out.unionByName(level)
    return out


def without_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of the column ``text``, whole characters only; a null text stays null.

    Other columns and repeated rows stay as they are, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("row"), content_id(utf8(F.col(text))).alias("doc_uid"))
    lost = repeats(docs.select(utf8(F.col(text)).alias("payload")), width, characters=True).select("uid", F.col("kept").cast("string").alias("kept"))
    out = rows.join(lost, F.col("doc_uid") == F.col("uid"), "left")
    return out.select(*(F.coalesce("kept", f"row.`{c}`").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", utf8(F.col("text")).alias("payload"))
    lost = repeats(docs.select("payload")).select(
        "uid",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept"),
    )
    small = docs.select("doc_id", content_id(F.col("payload")).alias("uid"), F.octet_length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("whole"))
    none = F.lit(0).cast("long")
    return small.join(lost, "uid", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
