"""The corpus pipeline, stage by stage and as a whole."""

import pytest

import corpus_pipeline
from seasonframe.llm import decontam

from .test_operators import brute_counts, brute_fingerprint, components


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage was given and what it left."""
    out, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, sf_dir).persist()
        out[name] = (docs, left)
        docs = left
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(stages, spark, sf_dir):
    for name, (given, left) in stages.items():
        if name != "tokenize":
            assert left.columns == given.columns
        assert set(ids(left)) <= set(ids(given))
    given, left = stages["language_id"]
    assert len(ids(left)) >= 0.97 * len(ids(given))
    given, left = stages["quality_rules"]
    counts = {r["doc_id"]: brute_counts(r["text"]) for r in given.collect()}
    assert ids(left) == sorted(d for d, c in counts.items() if c[0] >= 10 and 100 * c[4] <= 20 * c[0])
    given, left = stages["near_dedup"]
    rows = sorted((r["doc_id"], brute_fingerprint(r["text"])) for r in given.collect())
    roots = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] ^ rows[b][1]).bit_count() <= 3])
    assert ids(left) == [rows[k][0] for k in sorted(set(roots))]
    given, left = stages["decontaminate"]
    found = decontam.find_contamination(given, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert ids(left) == sorted(set(ids(given)) - set(ids(found)))
    given, left = stages["tokenize"]
    assert ids(left) == ids(given)


def test_run(stages, spark, sf_dir):
    want = sorted(map(tuple, stages["tokenize"][1].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want


def test_odd_tables(spark, edges, empty, sf_dir):
    from pyspark.sql import functions as F

    odd = edges.withColumn("kept", F.lit(1)).withColumn("margin", F.lit(2)).withColumn("fp", F.lit(3)).withColumn("a.b", F.lit(4))
    for docs in (odd, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "tokenize":
                assert docs.columns == columns
        docs.collect()
