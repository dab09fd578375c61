import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hotsets.llm import decontam
from hotsets.llm.common import handoff
from hotsets.llm.queries import REGISTRY
from tests.conftest import SF_SMALL
from tests.llm.cases import clashing
from tests.llm.test_linededup import brute, normal
from tests.llm.test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def stages(spark):
    """Input and result of every stage over the small test tables."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = handoff(stage(spark, docs, SF_SMALL))
        out.append((name, docs, result))
        docs = result
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay_to_the_last_stage(spark, stages):
    columns = spark.read.parquet(f"{SF_SMALL}/documents.parquet").columns
    assert [name for name, _, _ in stages] == ["quality_classifier", "line_dedup", "near_duplicates", "benchmark_decontamination", "packing"]
    assert all(out.columns == columns for _, _, out in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    _, docs, out = stages[0]
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    kept = out.select("doc_id", F.lit(1).alias("kept"))
    rows = labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in rows}
    assert share[1] > 0.95 and share[0] < 0.4


def test_line_stage_against_brute_force(stages):
    _, docs, out = stages[1]
    before, after = texts(docs), texts(out)
    gone = brute(before)
    for d, text in before.items():
        lines = text.split("\n")
        left = [x for i, x in enumerate(lines) if i not in gone.get(d, [])]
        if d not in gone:
            assert after[d] == text
        elif any(len(normal(x).split(" ")) >= 3 or len(normal(x)) >= 20 for x in left):
            assert after[d] == "\n".join(left)
        else:
            assert d not in after


def test_near_duplicate_stage_against_brute_force(stages):
    _, docs, out = stages[2]
    before = texts(docs)
    roots = brute_components([(d, brute_fingerprint(t)) for d, t in before.items()], 4)
    assert set(texts(out)) == set(roots.values())


def test_benchmark_stage(spark, stages):
    _, docs, out = stages[3]
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontam.find_contamination(docs, bench).where("size(spans) > 0").collect()}
    before, after = texts(docs), texts(out)
    assert hit and all(after[d] == t for d, t in before.items() if d not in hit)
    assert decontam.find_contamination(out, bench).where("size(spans) > 0").count() == 0


def test_packing_stage_places_every_token(stages):
    _, docs, out = stages[4]
    rows = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(rows) == docs.count() and all(r["n"] == r["all"] for r in rows)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run_equals_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF_SMALL)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want = stages[-1][2].select(*key)
    assert got.select(*key).exceptAll(want).count() == 0 and want.exceptAll(got.select(*key)).count() == 0


def test_stages_take_empty_tables_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
    extra = clashing(docs.drop("n_chars").limit(20))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, SF_SMALL).columns == extra.columns


def test_registered_names():
    assert [n.split("_")[0] for n in REGISTRY] == [f"op{i}" for i in range(1, 14)]
    assert all(re.fullmatch(r"op\d+_[a-z_]+", n) for n in REGISTRY)
