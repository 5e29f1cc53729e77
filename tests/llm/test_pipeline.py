import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline
    from siltstone.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before
    assert docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_odd_rows_pass_all_stages(spark, odd_docs, tmp_path):
    import corpus_pipeline
    from siltstone.llm.common import materialize

    spark.createDataFrame([(1, "some benchmark text of a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd_docs, odd_docs.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert (docs.count() > 0) == (rows is odd_docs)
    once = {r["doc_id"] for r in odd_docs.collect() if r["text"] is not None and any(map(str.isalpha, r["text"]))} - {0, 1, 2, 4, 25, 26, None}
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
    packed = docs.collect()
    assert once - {r["doc_id"] for r in packed} <= {27, 28}  # those two are in no language that was learned
    assert all(r["length"] * 4 == len(r["ids"]) for r in packed)


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['siltstone.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'scan_full' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    import corpus_pipeline

    common, clean, other = "a line that two documents have in common", "unique words about a river in the south", "something else on mountains and their snow"
    texts = [(None, f"first row begins so\n{clean}"), (None, f"second row is different\n{common}"), (7, f"{common}\nnothing here is repeated"), (7, f"{other}\n{common}")]
    docs = spark.createDataFrame([(1 - (1 << 40), common), *texts], "doc_id long, text string").coalesce(1)
    left = [r["text"] for r in corpus_pipeline.line_deduped(spark, docs, "").collect()]
    assert sum(clean in x for x in left) == 1 and sum(other in x for x in left) == 1

    long = " ".join(f"word{i}" for i in range(60))
    apart = " ".join(f"other{i}" for i in range(60))
    rows = [(1, long), (2, long + " end"), (2, apart), (3, apart + " end"), (3, apart + " end")]
    found = corpus_pipeline.near_deduped(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["text"].split()[0] for r in found) == ["other0", "word0"]
    rows = [(None, long), (9, long + " end"), (4, long), (None, apart), (None, apart + " end"), (None, None), (None, "")]
    found = corpus_pipeline.near_deduped(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"], (r["text"] or "").split()[:1]) for r in found if r["doc_id"]) == [(4, ["word0"])]
    assert sorted("none" if r["text"] is None else r["text"][:5] for r in found if r["doc_id"] is None) == ["", "none", "other"]
