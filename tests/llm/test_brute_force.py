"""Operators without SQL against plain reimplementations, and every query with the columns of its contract."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.llm import decontam, licenses, quality_model, sharding, toxicity
from seasonframe.llm.queries import QUERIES

from .conftest import SCHEMA, rows_of

COLUMNS = {
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_host_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op1_decontamination": {"doc_id": "bigint", "item_id": "bigint", "edits": "int"},
    "op9_licenses": {"doc_id": "bigint", "license": "string", "coverage": "double"},
    "op11_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op12_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op13_centroids": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
}
#: Enough labelled rows of each language.
LARGER = "/root/testdata/sf0.1"
HELD = {"op2_toxicity": (4, 2, 0.3), "op5_quality": (3, 1, 0.5), "op10_langid": (3, 1, None)}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_of_the_contract(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    if name == "op11_collocations":
        return
    table, key = {"op8_html": ("pages", "page_id"), "op13_centroids": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    ids = {r[key] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
    if name in ("op1_decontamination", "op9_licenses"):
        assert {r[key] for r in rows} <= ids
    else:
        assert sorted(r[key] for r in rows) == sorted(ids)
    if name in HELD:
        modulus, rest, threshold = HELD[name]
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and 0 <= r["score"] <= 1
            assert threshold is None or r["predicted"] == int(r["score"] >= threshold)


def test_held_out_quality(spark, sf_dir):
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality"](spark, sf_dir).collect() if r["doc_id"] in y]
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in rows]) >= 0.8


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs a larger table")
def test_held_out_toxicity_of_each_language(spark):
    """Of held-out rows: most toxic ones of every language are found, few clean ones are taken for them."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op2_toxicity"](spark, LARGER).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    clean = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean(clean) <= 0.02
    for each in ("en", "fr", "de", "es"):
        toxic = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1 and lang[r["doc_id"]] == each]
        found = [labels[r["doc_id"]] for r in rows if r["predicted"] and lang[r["doc_id"]] == each]
        assert len(toxic) >= 10 and np.mean(toxic) >= 0.85 and np.mean(found) >= 0.7, each


def test_quality_against_a_direct_solution(spark, prose):
    """The summed normal equations give the ridge regression that one matrix of all rows gives."""
    rng = random.Random(6)
    texts = [prose(rng.randint(5, 60)) if k % 3 else (prose(5) + "!!! ") * 6 for k in range(150)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(150)], "doc_id long, quality int")
    stats = quality_model.document_statistics(docs, keep=["doc_id"]).repartition(5)
    model = quality_model.train_quality(stats, labels, waves=20)
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0).alias("h")).collect()}
    x = np.array([quality_model.text_statistics(t) for t in texts])
    y = np.array([float(k % 3 > 0) for k in range(150)])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1))
    fit = np.array([not held[k] for k in range(150)])
    z = np.ones((150, 21))
    for k in range(150):
        for w in range(20):
            inner = sum(min(6.0, max(-6.0, (x[k, s] - model.mean[s]) / model.scale[s])) * model.frequencies[s, w] for s in range(x.shape[1]))
            z[k, w] = np.sqrt(2 / 20) * np.cos(inner + model.phases[w])
    direct = np.linalg.solve(z[fit].T @ z[fit] + 1e-3 * 150 * np.eye(21) / 21, z[fit].T @ y[fit])
    assert np.allclose(direct, model.weights, rtol=1e-4, atol=1e-6)


def test_word_scores_by_loops():
    """A word is the mean of its n-grams and itself, a document's logit its words' mean times their number."""
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(rng.normal(size=1 << 18), 0.0, 1.3, -0.2)
    mask, full = (1 << 64) - 1, 1 << 18

    def bucket(gram):
        mixed = 0
        for c in gram:
            mixed = (mixed * 0x9E3779B97F4A7C15 + c + 1) & mask
        return ((mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 46

    def word(w):
        marked = b"<" + w + b">"
        found = [bucket(marked[k : k + n]) for n in (3, 4, 5, 6) for k in range(len(marked) - n + 1)] + [zlib.crc32(w) % full]
        return np.mean([model.weights[b] for b in found])

    words = [b"a", b"toxic", b"verylongword", "é".encode()]
    assert np.allclose(model.word_scores(words), [word(w) for w in words])
    logit = 3 * np.mean([word(w) for w in words]) + 0.5
    assert np.isclose(toxicity.ToxicityModel(model.weights, 0.5, 1.3, -0.2).probability(float(np.mean(model.word_scores(words))), 3), 1 / (1 + np.exp(-(1.3 * logit - 0.2))))


def test_bags_and_telling_ngrams_by_loops():
    rng = random.Random(5)
    words = [b"zorkish", b"zorkling", b"house", b"garden", b"tree", b"river", b"stone"]
    docs = [np.array([rng.randrange(2, 7) for _ in range(rng.randint(1, 60))] + [0, 1] * (k % 2)) for k in range(80)]
    bucket, count = toxicity._ngrams(words)
    first = np.cumsum(count) - count
    counts = np.stack([sum(np.bincount(d, minlength=7) for d in docs[c::2]) for c in (0, 1)])
    grams = toxicity.telling_ngrams(words, counts, 5.0, 10_000)
    own = lambda k: bucket[first[k] : first[k] + count[k]]
    assert set(own(0)) | set(own(1)) <= set(grams) and len(toxicity.telling_ngrams(words, counts, 5.0, 3)) == 3
    bags = toxicity._bags(docs, words, grams)
    for d, bag in zip(docs, bags, strict=True):
        want = np.zeros(1 << 18)
        for w in d:
            for b in own(w):
                want[b] += 1 / count[w]
        assert np.allclose(bag, want[grams], atol=1e-4)


def hilbert_by_recursion(x, y, bits):
    """The place of a cell on the curve of two dimensions, quadrant by quadrant."""
    if not bits:
        return 0
    half = 1 << (bits - 1)
    right, top = x >= half, y >= half
    if not right and not top:
        return hilbert_by_recursion(y, x, bits - 1)
    if not right:
        return half * half + hilbert_by_recursion(x, y - half, bits - 1)
    if top:
        return 2 * half * half + hilbert_by_recursion(x - half, y - half, bits - 1)
    return 3 * half * half + hilbert_by_recursion(half - 1 - y, 2 * half - 1 - x, bits - 1)


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_hilbert_places_by_recursion(bits):
    cells = [(x, y) for x in range(1 << bits) for y in range(1 << bits)]
    got = sharding.hilbert_index(np.array(cells), bits).tolist()
    ways = [[hilbert_by_recursion(x, y, bits) for x, y in cells], [hilbert_by_recursion(y, x, bits) for x, y in cells]]
    assert got in ways


def test_written_shards_keep_rows_of_null_and_repeated_keys(spark, edge_rows, tmp_path):
    rows = [*edge_rows * 3, *[(None, "one text", "en", "s", 1)] * 90]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("x")).withColumn("Shard", F.lit("y")).repartition(5)
    sharding.write_shards(docs, str(tmp_path / "x"), n_shards=7)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert set(back.columns) == {"doc_id", "text", "lang", "source", "n_chars", "slot", "shard"}
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "lang", "source", "n_chars").collect()) == Counter(rows)
    sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    wanted = Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in sharding.hilbert_shards(docs, 7).collect())
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    assert Counter(tuple(r) for r in back.select("doc_id", crc, "shard").collect()) == wanted


def test_rows_alike_are_sorted_by_several_tasks(spark):
    docs = spark.createDataFrame([(None, "one text", "en", "s", 1)] * 4000, SCHEMA)
    placed = sharding._curve_places(docs, "doc_id", "text", ("source", "lang"), 5)
    order = ["curve", "__text", "__key", "__tie"]
    parts = placed.repartitionByRange(4, *order).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1
    got = sharding.hilbert_shards(docs, 3).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, k) for s, n in enumerate((1334, 1333, 1333)) for k in range(n)]


def test_licences_of_documents_keyed_by_an_outputs_name(spark):
    docs = spark.createDataFrame(rows_of(["Released under the MIT License."]), SCHEMA).withColumnRenamed("doc_id", "license")
    (r,) = licenses.scan_licenses(docs, key="license").collect()
    assert (r["document_license"], r["license"]) == (0, "MIT")


def test_alignment_in_pieces_of_any_size(words, monkeypatch):
    rng = random.Random(9)
    items = [" ".join(rng.choices(words, k=n)) for n in (6, 15, 40, 900)]
    texts = [" ".join([*rng.choices(words, k=30), *i.split()[1:], *rng.choices(words, k=30)]) for i in items for _ in range(3)]
    index = decontam.EditIndex(items)
    whole = decontam._search(index, texts)
    assert {(r[0], r[1]) for r in whole} >= {(3 * k + j, k) for k in range(4) for j in range(3)}
    monkeypatch.setattr(decontam, "_CELLS", 1000)
    assert decontam._search(index, texts) == whole
