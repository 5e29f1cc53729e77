import pytest

from siltstone.operators import bloom, index


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(0, f"key-{i:06d}") for i in range(200)], "gen int, key string")


def test_sparse_index(entries):
    rows = sorted(map(tuple, index.build(entries).collect()))
    assert rows == [(0, 0, "key-000000", 64), (0, 1, "key-000064", 64), (0, 2, "key-000128", 64), (0, 3, "key-000192", 8)]


@pytest.mark.parametrize(("probe", "chunk"), [(0, 0), (1, 0), (63, 0), (64, 1), (65, 1), (127, 1), (128, 2), (199, 3)])
def test_sparse_index_search(entries, probe, chunk):
    assert [r["chunk"] for r in index.search(index.build(entries), f"key-{probe:06d}").collect()] == [chunk]


def test_sparse_index_search_many(spark, entries):
    probes = spark.createDataFrame([("a",), ("key-000063",), ("key-000064",), ("z",)], "key string")
    assert {r["key"]: r["chunk"] for r in index.search_many(index.build(entries), probes).collect()} == {"key-000063": 0, "key-000064": 1, "z": 3}


def test_bloom_shape():
    shape = bloom.BloomShape.for_keys(1000)
    assert (shape.bits, shape.hashes) == (9586, 7)
    assert bloom.BloomShape.for_keys(0) == bloom.BloomShape.for_keys(1)
    assert bloom.BloomShape.for_keys(10, 2.0) == bloom.BloomShape.for_keys(10, 0.01)
    assert bloom.BloomShape.for_keys(1, 0.9).bits == 8


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    present = spark.range(5000).selectExpr("format_string('present-%08d', id) as key")
    absent = spark.range(20000).selectExpr("format_string('absent-%08d', id) as key")
    shape = bloom.BloomShape.for_keys(5000)
    bits = bloom.build(present, shape)
    again = bloom.from_bytes(spark, bloom.to_bytes(bits, shape), shape)
    assert bloom.might_contain(present, again, shape).where("not might_contain").count() == 0
    assert bloom.skipped(present.union(absent), bits, shape).first()["skipped"] > 0.95 * 20000
    wrong = bloom.might_contain(absent, bits, shape).where("might_contain").count()
    assert 0.3 * 200 < wrong < 3 * 200
    empty = bloom.build(present.limit(0), shape)
    assert bloom.might_contain(absent, empty, shape).where("might_contain").count() == 0
