"""Collocations, shared lines and centroids: against plain loops, with nulls, ties, repeats, hot groups and no rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.llm import centroids, collocations, line_dedup

from .conftest import SCHEMA, rows_of

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


# --- 11: collocations


def plain_collocations(rows, min_count, top, max_words=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update((k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: c for (k, p), c in counts.items() if k >= 2 and c >= min_count}
        all_ = {p: c for (k, p), c in counts.items()}
        found = []
        for p, a in often.items():
            if any(f" {p} " in f" {q} " and c >= a and len(q.split(" ")) > len(p.split(" ")) for q, c in often.items()):
                continue
            w = p.split(" ")
            score, _, l, r = min((1000 * a * n[lang] // (all_[" ".join(w[:k])] * all_[" ".join(w[k:])]), k, all_[" ".join(w[:k])], all_[" ".join(w[k:])]) for k in range(1, len(w)))
            found.append((-score, -a, p.encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.mine_collocations(df, **options).collect())


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_collocations_against_loops(spark, shards):
    """Two languages and none; phrases inside phrases, at piece ends, overlapping; one that stands in a third of all texts."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["É", "x-y", "don't", "A", "\x1c", "日本"]
    fixed = ["one two three four five", "three four", "Fast food, slow food", "a a a a", "stray; dog", "New\tYork City"]
    rows = []
    for k in range(300):
        parts = [rng.choice(words) if rng.random() < 0.8 else rng.choice(fixed) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r"]) for p in parts)
        rows.append((text + (" the hot phrase of all" if k % 3 == 0 else ""), rng.choice(["en", "fr", None])))
    rows += [rows[0]] * 40 + [(None, "en"), ("", None), ("...", "fr"), ("   ", "xx")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = plain_collocations(rows, 12, 25)
    assert len(want) > 30 and any(r[0] == "und" for r in want)
    assert mined(df, min_count=12, top=25, shards=shards) == want


def test_collocation_odd_tables(spark, edges, empty):
    assert mined(empty) == []
    clash = edges.withColumn("phrase", F.lit("old")).withColumn("n", F.lit(1)).withColumn("a.b", F.lit(2))
    assert mined(clash, min_count=2) == mined(edges, min_count=2) != []
    with pytest.raises(ValueError, match="steps"):
        collocations.frequent_phrases(edges, shards=60)


def test_score_passes_64_bits(spark):
    big = 10**12
    rows = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "", 0, 3 * 10**13)]
    got = collocations.score_phrases(spark.createDataFrame(rows, "lang string, phrase string, size int, n long")).first()
    assert got["score"] == int(Decimal(1000) * big * 3 * 10**13 // (big * (big + 7)))


def test_equal_hashes_are_told_apart():
    """A tally keeps phrases with one equal hash apart by the other; what comes back twice is summed with it afterwards."""
    words = collocations.Words("en", ["alpha beta gamma alpha"])
    tally = collocations.Tally()
    one, two = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 3], np.uint64)
    for _ in range(2):
        tally.add(words, one, two, np.ones(4, np.int64), np.array([0, 1, 3, 2]))
    found = Counter()
    for phrase, n in zip(*(tally.batch().column(c).to_pylist() for c in ("phrase", "n")), strict=True):
        found[phrase] += n
    assert found == {"alpha": 4, "beta": 2, "gamma": 2}


# --- 12: lines


def plain_lines(rows, min_chars=40, min_documents=5):
    held = defaultdict(set)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    least = lambda d: -(10**18) if d is None else d
    keeper = {k: max(docs, key=least) for k, docs in held.items() if len(docs) >= min_documents}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in keeper or keeper[key(line)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(12)
    shared = ["  This line is shared by many documents, k = %d \t" % k for k in range(8)] + ["short line", "é" * 40, "ß" * 39, ""]
    rows = []
    for k in range(120):
        lines = [rng.choice(shared) if rng.random() < 0.4 else f"a line of its own, number {rng.random():.18f} of them" for _ in range(rng.randint(1, 200 if k % 30 == 0 else 12))]
        lines = [line.upper() if rng.random() < 0.2 else line for line in lines]
        if k % 3 == 0:
            lines.insert(0, "THE LINE THAT A THIRD OF ALL DOCUMENTS HOLD, ON TOP")
        rows.append((k, "\n".join(lines)))
    return rows + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None), (500, ""), (501, "\n\n"), (502, None)]


@pytest.mark.parametrize("share", [10_000, 4])
def test_lines_against_loops(spark, monkeypatch, share):
    """With a small share for hot keys, frequent ones are dealt out by document."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = line_dedup.drop_repeated_lines(df, slices=5).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got), key=str) == plain_lines(rows)
    assert sum(r["n_dropped"] for r in got) > 100


def test_bitmaps(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.keep_bitmaps(df)
    assert "text" not in got.columns and got.count() == len(rows)
    texts = {r[0]: r[1] for r in rows if rows.count(r) and r[0] not in (7, None)}
    want = {d: (n, m, t) for d, n, m, t in plain_lines(rows) if d in texts}
    for r in got.filter("doc_id <> 7").collect():
        words = {w["at"]: w["bits"] for w in r["keep"]}
        lines = (texts[r["doc_id"]] or "").split("\n")
        kept = [line for k, line in enumerate(lines) if words.get(k // 64, -1) >> (k % 64) & 1]
        assert (r["n_lines"], r["n_dropped"], "\n".join(kept)) == want[r["doc_id"]]
        # words that keep all lines are not stored
        assert all(w["bits"] != -1 for w in r["keep"])


def test_lines_run_no_python(spark):
    df = spark.createDataFrame(line_rows(), "doc_id long, text string")
    plan = line_dedup.drop_repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_line_odd_tables(spark, edges, empty):
    assert line_dedup.drop_repeated_lines(empty).collect() == [] and line_dedup.keep_bitmaps(empty).collect() == []
    clash = edges.withColumn("keep", F.lit("old")).withColumn("n_lines", F.lit("old")).withColumn("mark", F.lit("m")).withColumn("a.b", F.lit(1)).withColumn("doc", F.lit(0))
    got = line_dedup.drop_repeated_lines(clash, min_documents=2)
    assert got.count() == edges.count() and len(set(got.columns)) == len(got.columns) and {"keep", "mark", "a.b", "doc"} <= set(got.columns)
    assert {r["keep"] for r in got.collect()} == {"old"}


# --- 13: centroids


def plain_clusters(rows, k, rounds, size):
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((distance(v, c), j) for j, c in enumerate(centers)) for _, v in vectors]

    for _ in range(rounds):
        to = [j for _, j in assign()]
        for j in range(len(centers)):
            mine = [v for (_, v), t in zip(vectors, to, strict=True) if t == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = assign()
    per = Counter()
    for d, j in last:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, per[j], sum(per.values()), digest[j]) for (i, _), (d, j) in zip(vectors, last, strict=True)), key=str)


def vector_rows(n=400, size=8):
    rng = random.Random(13)
    rows = [(k, [rng.choice([-1, 1]) * rng.random() * 3 for _ in range(size)]) for k in range(n)]
    same = [0.5] * size
    rows += [(1000 + k, same) for k in range(n // 2)]  # a third is one vector
    rows += [(1, rows[1][1]), (None, rows[2][1]), (None, None), (2000, []), (2001, [1.0] * (size - 1)), (2002, [None] + same[1:]), (2003, [float("nan")] + same[1:]), (2004, [float("-inf")] + same[1:]), (2005, [-0.0] * size)]
    # ties: vectors in the middle between others
    return rows + [(3000 + k, [x] + [0.0] * (size - 1)) for k, x in enumerate([-0.25, 0.25, 0.0, 0.0])]


@pytest.mark.parametrize("k, rounds", [(12, 5), (40, 2), (2000, 1), (1, 3)])
def test_centroids_against_loops(spark, k, rounds):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = centroids.cluster_report(df, size=8, k=k, rounds=rounds).collect()
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(plain, k, rounds, 8)


def test_bounds_hold_and_prune():
    """No bound is above the true distance, at any magnitude; near clusters are found without most distances."""
    rng = np.random.default_rng(3)
    for scale in (1, 1000, 1 << 26):
        centers = rng.integers(-scale, scale + 1, (40, 64))
        pivots = centroids.choose_pivots(centers)
        q = np.concatenate([np.clip(centers[rng.integers(0, 40, 300)] + rng.integers(-1 - scale // 50, 2 + scale // 50, (300, 64)), -scale, scale), centers])
        to = np.sqrt(centroids.exact_distances(q, pivots).astype(float))
        state = centroids.Centroids(centers, pivots)
        true = centroids.exact_distances(q, centers)
        assert (state.bounds(to) <= np.sqrt(true.astype(float)) * (1 + 1e-15)).all()
        best, distance, computed = state.nearest(q, to)
        assert (best == true.argmin(1)).all() and (distance == true.min(1)).all()
        if scale > 1:
            assert computed < 0.5 * true.size
    assert len(centroids.choose_pivots(np.zeros((5, 3), np.int64))) == 1


def test_centroid_odd_tables(spark):
    df = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>")
    assert centroids.cluster_report(df.limit(0)).collect() == [] and centroids.cluster_report(df, size=64).collect() == []
    clash = df.withColumn("cluster", F.lit("old")).withColumn("id", F.lit(1)).withColumn("q", F.lit(2))
    key = lambda d: sorted(map(str, centroids.cluster_report(d, size=8, k=5, rounds=2).collect()))
    assert key(clash) == key(df)
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = centroids.cluster_report(huge, size=2, k=2, rounds=2).collect()
    assert len(got) == 3 and all(r["distance"] >= 0 for r in got)
