"""The registered queries of the ten operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, collocations, decontam, host_rules, html_extract, langid, licenses, line_dedup, quality_model, sharding, simhash, toxicity
from .common import checkpointed, read_table, remainder


def _held_out(modulus: int, rest: int):
    return F.coalesce(remainder("doc_id", modulus) == rest, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its edits and the passage's place."""
    return decontam.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return toxicity.score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), word_vocabulary(), keep=["doc_id"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpointed(quality_model.document_statistics(read_table(spark, sf_dir, "documents"), keep=["doc_id"]))
    model = quality_model.train_quality(stats, read_table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return quality_model.score_quality(stats, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.hilbert_shards(read_table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = host_rules.apply_quality_rules(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract_main_text(pages, html_extract.train_extractor(), keep=["page_id", "url"])


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence text or notice found in a document, with its coverage and place."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = langid.learn_languages(docs, trainable=remainder("doc_id", 3) != 1)
    found = langid.identify_languages(docs, profiles, keep=["doc_id"])
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's two thousand best collocations."""
    return collocations.mine_collocations(read_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(read_table(spark, sf_dir, "embeddings"))


def word_vocabulary(path: str | None = None) -> bpe.Vocabulary:
    """The word-end vocabulary at ``path``; that of the installed public files, if None."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.Vocabulary.load(path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_simhash, op4_bpe, op5_quality, op6_sharding, op7_host_rules, op8_html, op9_licenses, op10_langid, op11_collocations, op12_line_dedup, op13_centroids)
}

_OP7 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 5) t(k) GROUP BY 1),
counted AS (SELECT d.doc_id, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM based WHERE source IS NOT NULL GROUP BY 1),
moments AS (SELECT count(*) AS h, sum(failed) / sum(n) AS mean, var_samp(failed / n) AS var, avg(1 / n) AS inverse FROM hosts),
prior AS (SELECT mean, CASE WHEN h < 2 OR mean * (1 - mean) = 0 THEN 10.0
  ELSE least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inverse, 1e-6 * mean * (1 - mean)) - 1, 1.0), 1e6) END AS weight FROM moments),
judged AS (SELECT source, (failed + mean * weight) / (n + weight) AS host_rate FROM hosts, prior)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce(host_rate <= 0.5, true) AS kept, round(host_rate, 6) AS host_rate
FROM based LEFT JOIN judged ON judged.source = based.source"""

_OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY 1),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cut AS (SELECT c.lang, c.phrase, a, n, j, one.f AS l, two.f AS r, (1000 * a * n) // (one.f * two.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate) c JOIN total ON total.lang = c.lang
  JOIN f one ON one.lang = c.lang AND one.phrase = array_to_string(w[1:j], ' ') JOIN f two ON two.lang = c.lang AND two.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
free AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM candidate c WHERE c.lang = b.lang AND len(c.w) > len(string_split(b.phrase, ' '))
  AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM free QUALIFY rank <= 2000"""

_OP12 = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS dropped FROM keyed LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


def _op13() -> str:
    """Five rounds and a last assignment, unrolled."""
    steps = ["""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, q AS c FROM v QUALIFY cluster < 40)"]
    for k in range(6):
        square = "list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"a{k} AS (SELECT vec_id, q, cluster, d FROM (SELECT vec_id, q, cluster, {square} AS d FROM v, c{k}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)")
        steps.append(f"""m{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM
(SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{k}) GROUP BY ALL) GROUP BY 1)""")
        steps.append(f"c{k + 1} AS (SELECT c{k}.cluster, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} ON m{k}.cluster = c{k}.cluster)")
    return ",\n".join(steps) + """
SELECT vec_id, CAST(a5.cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a5.cluster) AS BIGINT) AS cluster_inertia,
CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON c5.cluster = a5.cluster"""


#: The other operators have no SQL: they are tested against brute force, round trips and held-out labels.
ORACLES: dict[str, str] = {"op7_host_rules": _OP7, "op11_collocations": _OP11, "op12_line_dedup": _OP12, "op13_centroids": _op13()}
