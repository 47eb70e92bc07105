"""Every operator on tables with nulls, empty and very long texts, ties, repeats, no rows, and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.llm import bpe, decontam, host_rules, html_extract, langid, licenses, quality_model, sharding, simhash, toxicity
from seasonframe.llm.queries import word_vocabulary

CLASH = ["score", "predicted", "lang_pred", "margin", "rejected", "n_words", "kept", "host_rate", "base_failed", "fp", "component", "ids", "decoded", "n_tokens", "shard", "slot", "size", "stats", "Score"]


def clashing(df):
    for c in [c for c in CLASH if c != "Score"]:
        df = df.withColumn(c, F.lit("old"))
    return df


def toxic_model(spark, docs):
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (5, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    return labels, toxicity.train_toxicity(docs, labels)


OPERATORS = {
    "langid": lambda s, d: langid.identify_languages(d, langid.learn_languages(d)),
    "drop_rejected": lambda s, d: langid.drop_rejected(d, langid.learn_languages(d)),
    "host_rules": lambda s, d: host_rules.apply_quality_rules(d),
    "host_rules_small": lambda s, d: host_rules.apply_quality_rules(d, keep=["doc_id"]),
    "near_duplicates": lambda s, d: simhash.near_duplicates(d),
    "drop_near_duplicates": lambda s, d: simhash.drop_near_duplicates(d),
    "decontaminate": lambda s, d: decontam.find_contamination(d, s.createDataFrame([(1, "repeated row with ten words in it or even more"), (2, None), (None, "short")], "item_id long, text string")),
    "drop_contaminated": lambda s, d: decontam.drop_contaminated(d, s.createDataFrame([(1, "repeated row with ten words in it or even more"), (2, None)], "item_id long, text string")),
    "no_benchmark": lambda s, d: decontam.find_contamination(d, s.createDataFrame([], "item_id long, text string")),
    "bpe": lambda s, d: bpe.encode_texts(d, word_vocabulary()),
    "digests": lambda s, d: bpe.token_digests(d, word_vocabulary(), keep=["doc_id"]),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, toxic_model(s, d)[1]),
    "quality": lambda s, d: quality_model.score_quality(quality_model.document_statistics(d, keep=["doc_id"]), quality_model.train_quality(quality_model.document_statistics(d, keep=["doc_id"]), toxic_model(s, d)[0])),
    "sharding": lambda s, d: sharding.hilbert_shards(d),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "html": lambda s, d: html_extract.extract_main_text(d, html_extract.train_extractor(40), html="text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, edges, empty, name):
    operator = OPERATORS[name]
    keeps_rows = name not in ("drop_rejected", "drop_near_duplicates", "decontaminate", "drop_contaminated", "no_benchmark", "licenses")
    rows = operator(spark, edges).collect()
    assert (len(rows) == edges.count()) if keeps_rows else len(rows) <= edges.count()
    assert operator(spark, empty).collect() == []
    clash = operator(spark, clashing(edges))
    assert len({c.lower() for c in clash.columns}) == len(clash.columns)
    assert clash.count() == len(rows)


def test_defined_results(spark, edges):
    lang = {r["doc_id"]: r for r in langid.identify_languages(edges, langid.learn_languages(edges)).collect()}
    for k in (1, 2, 3, 6):
        assert (lang[k]["lang_pred"], lang[k]["score"], lang[k]["rejected"]) == ("und", 0.0, True)
    rules = {r["doc_id"]: r for r in host_rules.apply_quality_rules(edges).collect()}
    assert rules[1]["n_words"] == 0 and rules[1]["base_failed"] and not rules[1]["kept"]
    near = {r["doc_id"]: r for r in simhash.near_duplicates(edges).collect()}
    assert near[1]["fp"] == 0 and near[1]["component"] == near[2]["component"] == near[3]["component"] == 1
    kept = simhash.drop_near_duplicates(edges).select("doc_id", "text").collect()
    assert sum(r["doc_id"] == 8 for r in kept) == 2 and sum(not (r["text"] or "").strip() for r in kept) == 1
    ids = {r["doc_id"]: r for r in bpe.encode_texts(edges, word_vocabulary()).collect()}
    assert ids[1]["ids"] == [] and ids[1]["decoded"] == ""
    tox = {r["doc_id"]: r for r in toxicity.score_toxicity(edges, toxic_model(spark, edges)[1]).collect()}
    assert tox[1]["score"] == 0.0 and tox[2]["predicted"] == 0
    size = {r["doc_id"]: r for r in sharding.hilbert_shards(edges).collect()}
    assert size[1]["size"] == 8 and size[1]["text_crc32"] == 0


def test_labels_of_one_class(spark, edges):
    labels = spark.createDataFrame([(7, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    stats = quality_model.document_statistics(edges, keep=["doc_id"])
    for table, quality, toxic in ((labels, 1.0, 0.0), (none, 0.5, 0.0)):
        got = quality_model.score_quality(stats, quality_model.train_quality(stats, table)).collect()
        assert all(abs(r["score"] - quality) < 0.01 for r in got)
        got = toxicity.score_toxicity(edges, toxicity.train_toxicity(edges, table)).collect()
        assert all(abs(r["score"] - toxic) < 0.01 for r in got)


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "some text here", 2)], "doc_id long, text string, `a.b` int")
    assert bpe.token_digests(df, word_vocabulary()).first()["a.b"] == 2
    assert np.isfinite(langid.identify_languages(df.withColumn("lang", F.lit("en")), langid.learn_languages(df.withColumn("lang", F.lit("en")))).first()["score"])
