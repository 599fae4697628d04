import zlib

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from folioflow.llm.simhash import near_duplicates

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], SMALL).cache())
    return results


def test_stages_keep_the_columns_and_narrow_the_rows(stages):
    docs, *filtered, packed = stages
    for some in filtered:
        assert some.dtypes == docs.dtypes
    sizes = [s.count() for s in stages[:-1]]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert packed.count() >= sizes[-1]


def test_packed_are_the_documents_that_remain(stages):
    kept = {r.doc_id for r in stages[-2].collect()}
    assert {r.doc_id for r in stages[-1].collect()} == kept


def test_no_near_duplicates_remain(stages):
    before, after = stages[2], stages[3]
    groups = {r.id: r.component_id for r in near_duplicates(before).collect()}
    kept = [r.doc_id for r in after.collect()]
    assert len(kept) == len(set(kept)) == len(set(groups.values()))
    assert {groups[i] for i in kept} == set(groups.values())


def test_run_equals_the_stages(spark, stages):
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    run = corpus_pipeline.run(spark, SMALL).select(*names).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, stages[-1].select(*names).collect()))


def test_good_documents_stay(stages):
    labels = pq.read_table(f"{SMALL}/labels.parquet").to_pydict()
    good = {d for d, q in zip(labels["doc_id"], labels["quality"]) if q == 1}
    judged = {r.doc_id for r in stages[1].collect()}
    long = {r.doc_id for r in stages[0].collect() if len((r.text or "").split()) >= 20}
    assert len(good & judged) >= 0.97 * len(good & long)


def test_odd_rows_go_through(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, kept STRING, `a.b` INT"
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()[:30]]
    rows = [(i, t, "en", "x", i) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), (1, texts[1], "en", "x", 1), (50, None, None, "y", 0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "kept", "a.b"]
    assert docs.filter("doc_id = 1").count() <= 1 and docs.filter("doc_id = 50").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i}" for i in range(60))
    rows = [
        (7, text, "a"), (7, text, "a"), (7, text, "b"), (3, text, "c"), (None, text, "d"),
        (3, other, "e"), (None, None, "f"), (None, "", "g"), (None, None, "f"),
    ]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, _hash STRING")
    kept = corpus_pipeline.near_duplicate(spark, docs, SMALL)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, r.text or "", r._hash) for r in kept.collect())
    assert found[1:] == [(3, other, "e"), (3, text, "c")]
    assert found[0][:2] == (0, "") and found[0][2] in "fg"


def test_packing_checksums(stages):
    assert all(0 <= r.ids_crc32 < 1 << 32 for r in stages[-1].collect())
    assert zlib.crc32(b"") == 0
