import random

import pytest

from siltstone.operators import merge, read

SCHEMA = "key binary, op byte, value binary, recency long, seq long"


def table(spark, generations):
    rows, seq = [], 0
    for recency, entries in enumerate(generations):
        for key, value in entries:
            seq += 1
            rows.append((key.encode(), 2 if value is None else 1, None if value is None else value.encode(), recency, seq))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {bytes(r["key"]).decode(): None if r["op"] == 2 else bytes(r["value"]).decode() for r in df.collect()}


@pytest.mark.parametrize(
    ("generations", "kept"),
    [
        ([[("a", "1"), ("c", "3")], [("b", "2"), ("d", "4")]], {"a": "1", "b": "2", "c": "3", "d": "4"}),
        ([[("k", "old")], [("k", "new")]], {"k": "new"}),
        ([[("k", "v")], [("k", None)]], {"k": None}),
        ([[("alive", "yes")], [("dead", None)]], {"alive": "yes", "dead": None}),
        ([[("k", "oldest")], [("k", "middle")], [("k", "newest")]], {"k": "newest"}),
        ([[("k", "v1"), ("k", None), ("k", "v2")]], {"k": "v2"}),
        ([[("ghost", None)]], {"ghost": None}),
        ([[("", "empty key"), ("e", "")]], {"": "empty key", "e": ""}),
        ([], {}),
        ([[], []], {}),
    ],
)
def test_newest_wins(spark, generations, kept):
    df = table(spark, generations)
    assert found(merge.merge(df, False)) == kept
    assert found(merge.merge(df, True)) == {k: v for k, v in kept.items() if v is not None}


@pytest.mark.parametrize(("gens", "per_gen", "keys", "deletes", "seed"), [(6, 800, 2000, 0.2, 7), (5, 600, 1500, 0.25, 99)])
def test_random_generations_against_a_dict(spark, gens, per_gen, keys, deletes, seed):
    rng = random.Random(seed)
    generations, model = [], {}
    for g in range(gens):
        entries = [(f"key-{k:04d}", None if rng.random() < deletes else f"v{g}-{k}") for k in rng.sample(range(keys), per_gen)]
        model.update(entries)
        generations.append(entries)
    df = table(spark, generations)
    assert found(merge.merge(df, False)) == model
    live = {k: v for k, v in model.items() if v is not None}
    assert found(merge.merge(df, True)) == live
    scanned = [bytes(r["key"]).decode() for r in read.scan(df, b"key-0100", b"key-0900", ordered=True).collect()]
    assert scanned == sorted(k for k in live if "key-0100" <= k <= "key-0900")
    buried = {bytes(r["key"]).decode() for r in merge.buried(df.withColumnRenamed("recency", "gen")).collect()}
    older = {k for entries in generations for k, v in entries if v is not None}
    assert buried == {k for k, v in model.items() if v is None and k in older}


def test_ranges_are_inclusive_and_bytes_are_unsigned(spark):
    df = table(spark, [[(k, k) for k in "abcde"]])
    keys = lambda *a: sorted(bytes(r["key"]) for r in read.scan(df, *a).collect())
    assert keys(b"b", b"d") == [b"b", b"c", b"d"]
    assert keys(b"c", None) == [b"c", b"d", b"e"] and keys(None, b"b") == [b"a", b"b"]
    assert keys(b"m", b"n") == [] and keys(b"d", b"b") == [] and keys(None, b"") == []
    raw = spark.createDataFrame([(k, 1, b"", 0, i) for i, k in enumerate([b"\xff", b"\x7f", b"a", b"a\x00", b"", b"\x80"])], SCHEMA)
    assert [bytes(r["key"]) for r in read.scan(raw, ordered=True).collect()] == [b"", b"a", b"a\x00", b"\x7f", b"\x80", b"\xff"]


def test_tri_state(spark):
    df = table(spark, [[("a", "1"), ("b", None), ("c", "3")]])
    probes = spark.createDataFrame([(k,) for k in (b"a", b"b", b"c", b"none", b"a")], "key binary")
    out = {bytes(r["key"]): (r["exists_here"], r["is_deleted"], r["value"]) for r in read.tri_state(probes, df).collect()}
    assert out == {b"a": (True, False, b"1"), b"b": (True, True, None), b"c": (True, False, b"3"), b"none": (False, False, None)}
    assert {bytes(r["key"]) for r in read.multi_get(probes, df).collect()} == {b"a", b"c"}


def test_plan_pushes_the_range_and_sorts_nothing(spark, tmp_path):
    table(spark, [[("a", "1")]]).write.parquet(str(tmp_path / "t"))
    df = read.scan(spark.read.parquet(str(tmp_path / "t")), b"a", b"b")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(key" in plan and "Window" not in plan


def test_flush_boundaries_do_not_depend_on_blocks(spark):
    df = table(spark, [[(f"k{i:03d}", "v" * i) for i in range(50)]])
    one = sorted(map(tuple, merge.flush_boundaries(df, 500).collect()))
    assert one == sorted(map(tuple, merge.flush_boundaries(df, 500, block=7).collect()))
    total = held = flushes = 0
    for i, (seq, running, flush) in enumerate(one):
        total, held = total + 4 + i + 48, held + 4 + i + 48
        assert (seq, running, flush) == (i + 1, total, flushes)
        if held >= 500:  # counting starts at zero behind a flush
            held, flushes = 0, flushes + 1


def test_lookups_reduce_the_entries_before_they_aggregate(spark, tmp_path):
    """The store's entries are met by the probes before any aggregate or shuffle by key."""
    table(spark, [[(f"k{i}", "v") for i in range(2000)]]).write.parquet(str(tmp_path / "t"))
    probes = spark.createDataFrame([(b"k7",)], "key binary")
    plan = read.tri_state(probes, spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("max_by") < plan.index("LeftSemi")  # parents come first
    equal = read.point_get(spark.read.parquet(str(tmp_path / "t")), b"k7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in equal
