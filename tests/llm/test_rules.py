"""Quality rules: base counts against plain Python, the ratio against its definition."""

import math
import re

from pyspark.sql import functions as F

from nearline.llm import rules

SPACE = "\x20\x09-\x0d"


def brute(text):
    t = text or ""
    w = re.findall(f"[^{SPACE}]+", t)
    lines = [x for x in t.split("\n") if re.search(f"[^{SPACE}]", x)]
    seen, covered = {}, set()
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k:k + 3]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            covered |= {k + d for k in places for d in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


def key(r):
    return (str(r[0]), *r[1:])


def test_base_counts(docs, no_docs):
    got = rules.quality_rules(docs).select("__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(key, got)) == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
    assert rules.quality_rules(no_docs).count() == 0


def test_repeats_overlapping(spark):
    texts = ["a b c a b c a b c", "a a a a a", "x y z", "x y", "a b c d a b c", "p q r s p q r s t u v"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.quality_rules(df).select("__row.doc_id", "n_repeat_words").collect()}
    assert got == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_very_long_text(spark):
    """More windows than the plain sort takes."""
    text = " ".join(f"w{(k * k) % 70001}" for k in range(70000)) + " one two three four one two three"
    got = rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_words, got.n_repeat_words) == (brute(text)[0], brute(text)[4])


def test_ratio_is_the_definition(spark):
    """The score from counts made in Python, buckets by the same hash."""
    texts = [f"clean words number {i} " + " ".join(f"plain{(i * k) % 31}" for k in range(60)) for i in range(12)]
    texts += [" ".join(f"junk{k}$$$ ###" for k in range(i, i + 60)) for i in range(4)] + ["", None, "ABC DEF"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = rules.RuleParams()
    token = re.compile("[a-zA-Z0-9\x80-\U0010ffff]+|[!-/:-@\\[-`{-~]+")
    grams = {i: [] for i in range(len(texts))}
    for i, t in enumerate(texts):
        w = token.findall(t or "")
        grams[i] = [(a,) for a in w] + [(a, b) for a, b in zip(w, w[1:] + [None])]
    every = sorted({g for x in grams.values() for g in x}, key=str)
    rows = spark.createDataFrame([(k, g[0], g[1] if len(g) > 1 else None, len(g)) for k, g in enumerate(every)], "k int, a string, b string, n int")
    h = F.when(F.col("n") == 1, F.xxhash64("a")).otherwise(F.xxhash64(F.xxhash64("a"), F.when(F.col("b").isNotNull(), F.xxhash64("b"))))
    bucket = {every[r.k]: r.x for r in rows.select("k", F.pmod(h, F.lit(p.buckets)).alias("x")).collect()}
    raw, target = [0] * p.buckets, [0] * p.buckets
    for i, t in enumerate(texts):
        trusted = len(token.findall(t or "")) >= 50 and not re.search(r"[#*$%&|<>]", t) and sum(c.isupper() for c in t) <= 0.2 * len(t)
        for g in grams[i]:
            raw[bucket[g]] += 1
            target[bucket[g]] += trusted
    n_raw, n_target = (sum(x) + p.smoothing * p.buckets for x in (raw, target))
    ratio = [round(rules.SCALE * math.log((t + p.smoothing) / n_target * n_raw / (r + p.smoothing))) for r, t in zip(raw, target)]
    got = {r.doc_id: r.score for r in rules.quality_rules(df).select("__row.doc_id", "score").collect()}
    for i in grams:
        want = sum(ratio[bucket[g]] for g in grams[i]) / (rules.SCALE * len(grams[i])) if grams[i] else 0.0
        assert abs(got[i] - want) < 1e-9, i


def test_labels_apart(spark, sf):
    """Texts labelled good are kept, junk goes (labels are no input)."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = rules.quality_rules(docs).select("__row.doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    good = [x.kept for x in r if x.quality == 1 and not x.base_failed]
    junk = [x.kept for x in r if x.quality == 0]
    assert sum(good) >= 0.98 * len(good) and not any(junk)


def test_columns_kept(docs):
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() > 0
