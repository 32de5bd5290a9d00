"""Operators against brute force on small inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from keyscan.functions import intset
from keyscan.functions.values import ValueType, decode, encode, fold
from keyscan.operators import index, multimap, ordinals, relation
from keyscan.operators.search import Bias, search, seek, take_while, take_while_by
from keyscan.runtime import new_dir
from keyscan.sources.fixedrec import read_records, write_records
from keyscan.sources.schema import Field, IndexKind, RecordSchema

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def brute(rows, probe, bias):
    """(key, pos) over (pos, key) rows, the first of equal keys."""
    best = {}
    for p, k in rows:
        best[k] = min(p, best.get(k, p))
    below = max((k for k in best if k <= probe), default=None)
    above = min((k for k in best if k >= probe), default=None)
    if bias is Bias.NONE:
        k = probe if probe in best else None
    elif bias is Bias.FORWARD:
        k = above
    elif bias is Bias.BACKWARD:
        k = below
    else:
        k = below if above is None or (below is not None and probe - below <= above - probe) else above
    return (k, best[k]) if k is not None else (None, -1)


ROWS = [
    [(0, 10), (1, 10), (2, 20), (3, 40)],
    [],
    [(0, 5)],
    [(k, 7) for k in range(17)] + [(17, 9)],
    [(0, LOW), (1, -1), (2, 0), (3, HIGH)],
]


@pytest.mark.parametrize("rows", ROWS)
def test_search_matches_brute_force(spark, rows):
    keys = spark.createDataFrame(rows, "_pos bigint, key bigint")
    asked = sorted({x for _, k in rows for x in (k - 1, k, k + 1) if LOW <= x <= HIGH} | {15, 30, 35, 5, 99, LOW, HIGH, 30})
    probes = spark.createDataFrame([(p,) for p in asked], "probe bigint")
    for bias in Bias:
        got = {r["probe"]: (r["key"], r["_pos"]) for r in search(keys, probes, bias).collect()}
        assert got == {p: brute(rows, p, bias) for p in asked}


def test_seek_matches_brute_force(spark):
    keys = spark.createDataFrame(ROWS[0], "_pos bigint, key bigint")
    for bias, p in itertools.product(Bias, (5, 10, 15, 30, 35, 40, 99)):
        want = brute(ROWS[0], p, bias)
        assert seek(keys, p, bias) == (None if want[0] is None else want)


def test_search_repeated_probes_and_spread_ranges(spark):
    rnd = random.Random(3)
    rows = [(p, k) for p, k in enumerate(sorted(rnd.choices(range(0, 5000, 7), k=800)))]
    keys = spark.createDataFrame(rows, "_pos bigint, key bigint")
    asked = [rnd.randrange(-50, 5100) for _ in range(500)]
    probes = spark.createDataFrame([(p,) for p in asked], "probe bigint")
    got = sorted((r["probe"], r["key"], r["_pos"]) for r in search(keys, probes, Bias.NEAREST).collect())
    assert got == sorted((p, *brute(rows, p, Bias.NEAREST)) for p in asked)


def test_ordinals_follow_the_key_however_rows_arrive(spark):
    rnd = random.Random(1)
    values = [(rnd.randrange(1000),) for _ in range(700)] + [(None,)]
    rnd.shuffle(values)
    got = ordinals.with_ordinals(spark.createDataFrame(values, "k bigint"), "k").orderBy("_pos").collect()
    assert [r["_pos"] for r in got] == list(range(701))
    assert [r["k"] for r in got] == [None, *sorted(v for (v,) in values if v is not None)]
    assert ordinals.with_ordinals(spark.createDataFrame([], "k bigint"), "k").count() == 0


def test_swaps_and_patches(spark):
    rows = spark.range(1000).select(F.col("id").alias("_pos"), (F.col("id") * 10).alias("v"))
    model = [i * 10 for i in range(1000)]
    swapped = ordinals.bulk_swap(ordinals.bulk_swap(rows, 200, 500, 100), 3, 999)
    model[200:300], model[500:600] = model[500:600], model[200:300]
    model[3], model[999] = model[999], model[3]
    patched = ordinals.patch_field(swapped, 7, "v", F.lit(-1).cast("bigint"))
    model[7] = -1
    assert [r["v"] for r in patched.orderBy("_pos").collect()] == model
    with pytest.raises(ValueError):
        ordinals.bulk_swap(rows, 1, 5, 8)
    null = spark.createDataFrame([(4, None)], "_pos bigint, value bigint")
    assert ordinals.patch_fields(rows, null, "v").where("v is null").count() == 1


@pytest.mark.parametrize("kind", [k for k in ValueType if k is not ValueType.LONG128])
def test_values_decode_as_stored(spark, kind):
    bits = 8 * kind.width
    patterns = [0, (1 << (bits - 1)) - 1, 1 << (bits - 1), (1 << bits) - 1]
    signed = lambda x, b: x - (1 << b) if x >= 1 << (b - 1) else x
    rows = spark.createDataFrame([(signed(p, 64),) for p in patterns], "v bigint")
    got = [tuple(r) for r in rows.select(decode(encode(F.col("v"), kind), 0, kind), fold(F.col("v"), kind)).collect()]
    want = [signed(p, bits) if kind.signed else p for p in patterns]
    assert got == [(w, w) for w in want]


SCHEMA = RecordSchema("t", [Field("file_offset"), Field("id", ValueType.LONG, IndexKind.UNIQUE), Field("small", ValueType.SHORT), Field("wide", ValueType.LONG128)])


def test_record_files_round_trip(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("_pos"), (F.col("id") * 23).alias("file_offset"), (5000 - F.col("id")).alias("id"), (F.col("id") % 7 - 3).alias("small"), F.struct((-F.col("id")).alias("hi"), F.col("id").alias("lo")).alias("wide"))
    path = str(tmp_path / "records")
    write_records(rows.repartitionByRange(3, "_pos").sortWithinPartitions("_pos"), path, SCHEMA)
    back = read_records(spark, path, SCHEMA, rangeBytes=4096)
    assert [tuple(r) for r in back.orderBy("_pos").collect()] == [tuple(r) for r in rows.orderBy("_pos").collect()]
    assert [r["_pos"] for r in back.where("_pos >= 4990 and _pos < 4995").collect()] == list(range(4990, 4995))
    write_records(rows.limit(10).coalesce(1), path, SCHEMA)
    assert read_records(spark, path, SCHEMA).count() == 10
    part = next((tmp_path / "records").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"xyz")
    assert read_records(spark, path, SCHEMA).count() == 10


def test_index_is_the_same_for_any_order_of_arrival(spark):
    schema = RecordSchema("t", [Field("file_offset"), Field("id", ValueType.LONG, IndexKind.UNIQUE), Field("data")])
    rows = [(i * 23, (i * 37 % 1000) * 10, i * i) for i in range(1000)]
    random.Random(5).shuffle(rows)
    built = index.build(spark.createDataFrame(rows, "file_offset bigint, id bigint, data bigint"), schema, new_dir(spark, "t"))
    probes = spark.createDataFrame([(x,) for x in (0, 370, 371, 9990, 10000)], "probe bigint")
    got = {r["probe"]: (r["_pos"], r["data"]) for r in built.find("id", probes).collect()}
    assert got == {0: (0, 0), 370: (1, 1), 371: (-1, None), 9990: (27, 729), 10000: (-1, None)}
    assert {r["probe"]: r["_pos"] for r in built.search("file_offset", probes, Bias.FORWARD).collect()}[371] == 17
    assert built.size() == 1000
    with pytest.raises(ValueError):
        built.rows("data")
    twice = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "file_offset bigint, id bigint, data bigint")
    with pytest.raises(ValueError):
        index.build(twice, schema, new_dir(spark, "t"), strict=True)
    with pytest.raises(ValueError):
        RecordSchema("x", [Field("offset"), Field("file_offset")])


def edges(spark):
    rows = [(i, i, k, 100 * k + j) for i, (k, j) in enumerate(((k, j) for k in range(1000, 1012, 2) for j in range(0, 23 * (1 + k % 23), 23)), 1)]
    return rows, spark.createDataFrame(rows, "key_index bigint, value_index bigint, key bigint, value bigint")


def test_multimap(spark):
    rows, e = edges(spark)
    assert len(rows) == 102
    by_key = {k: [r for r in rows if r[2] == k] for k in {r[2] for r in rows}}
    assert {r["key"]: r["n"] for r in multimap.counts(e).collect()} == {k: len(v) for k, v in by_key.items()}
    assert [r["value"] for r in multimap.values(e, 1004).orderBy("value").collect()] == [r[3] for r in by_key[1004]]
    limit = by_key[1004][3][3]
    assert multimap.values(e, 1004, F.col("value") < limit).count() == 4
    assert multimap.read_from(e, 1004, F.col("key") < 1006).count() == len(by_key[1004]) + 1
    assert multimap.read_from(e, 1003, F.lit(True)).count() == 0
    assert multimap.read_nearest(e, 1003).count() == 102 - 0 - len(by_key[1000])
    assert multimap.read_nearest(e, 999).count() == 102
    assert sorted(tuple(r) for r in multimap.inverse(multimap.inverse(e)).collect()) == sorted(rows)
    none = e.limit(0)
    assert [tuple(r) for r in multimap.extent(none).collect()] == [(0, 0, -1, -1)]
    assert multimap.counts(none).count() == 0 and multimap.read_nearest(none, 3).count() == 0


def test_closure_ends_on_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 1), (5, 5)]
    e = spark.createDataFrame(pairs, "key bigint, value bigint")
    reach = lambda start, stop=None: sorted(r["node"] for r in multimap.closure(e, start, stop).collect())
    assert reach(1) == [1, 2, 3, 4, 5]
    assert reach(6) == [1, 2, 3, 4, 5]
    assert reach(7) == []
    assert reach(1, F.col("node") == 3) == [2, 3]


def test_take_while_includes_the_first_failure(spark):
    rows = spark.createDataFrame([(k, v) for k in range(3) for v in (5, 1, 4, 2, 3)], "k int, v int")
    got = sorted(tuple(r) for r in take_while(rows, (F.col("k") < 1) | (F.col("v") < 3), "k", "v").collect())
    assert got == [(0, v) for v in range(1, 6)] + [(1, 1), (1, 2), (1, 3)]
    assert take_while(rows, F.lit(True), "k", "v").count() == 15
    got = sorted(tuple(r) for r in take_while_by(rows, F.col("v") < 2, "k", "v").collect())
    assert got == [(k, v) for k in range(3) for v in (1, 2)]


def test_integer_sets(spark):
    model = set(range(5, 101, 5)) | {6, 7}
    one = spark.createDataFrame([(sorted(model), [])], "s array<bigint>, none array<bigint>")
    value = lambda c: one.select(c).first()[0]
    s, none = F.col("s"), F.col("none")
    for i in range(103):
        x = F.lit(i).cast("bigint")
        assert value(intset.next_set(s, x)) == min((m for m in model if m >= i), default=-1)
        assert value(intset.next_clear(s, x)) == next(m for m in itertools.count(i) if m not in model)
        if i % 5 < 3:
            assert value(intset.previous_set(s, x)) == max((m for m in model if m <= i), default=-1)
            assert value(intset.previous_clear(s, x)) == next((m for m in range(i, -1, -1) if m not in model), -1)
    assert value(intset.length(s)) == 101 and value(intset.length(none)) == 0
    assert value(intset.previous_set(none, F.lit(3))) == -1
    assert value(intset.flip(s, F.lit(5).cast("bigint"))) == sorted(model ^ {5})
    assert value(intset.total(s, lambda x: x * 0.5)) == sum(model) / 2
    with pytest.raises(Exception, match="negative"):
        value(intset.add(s, F.lit(-1).cast("bigint")))


def test_relations(spark):
    r = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "key bigint, value bigint")
    more = spark.createDataFrame([(2, 21), (4, 40)], "key bigint, value bigint")
    path = new_dir(spark, "relation")
    relation.save(relation.put(r, more), path)
    assert relation.same(relation.load(spark, path), spark.createDataFrame([(1, 10), (2, 21), (3, 30), (4, 40)], r.schema))
    assert relation.clear(r).count() == 0
    assert sorted(tuple(x) for x in relation.get_or_default(r, more, -1).collect()) == [(2, 20), (4, -1)]
