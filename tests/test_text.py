"""Masking rules (B1-B18) against the fixture expectations and a plain-Python run of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from nearline.functions.text import FULL_RULES, normalise, rules_for

from .conftest import SF001


def py_normalise(s, profile="full", skip=()):
    s = s.lower()
    for r in rules_for(profile, skip):
        pat = re.compile(r.pattern, re.I if r.ignore_case else 0)
        s = pat.sub(r.replacement.replace("$1", r"\1").replace("$2", r"\2"), s)
    return re.sub(r"\s+", " ", s).strip()


def run(spark, texts, profile="full"):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(normalise(F.col("t"), profile)).collect()]


def test_fixture_full_profile(spark, logs):
    got = {r.n: r.m for r in logs.select("n", normalise(F.col("text")).alias("m")).collect()}
    assert got[1] == "error <ts> user_id=<id> request took 150ms"
    assert got[2] == "info <ts> user_id=<id> passed user"
    assert got[3] == got[5] == "error <ts> user_id=<id> request took 149ms"
    assert got[4] == "error <ts> user_id=<id> request took 153ms"


def test_fixture_basic_profile(spark, logs):
    got = {r.n: r.m for r in logs.select("n", normalise(F.col("text"), "basic").alias("m")).collect()}
    assert got[4] == "error <ts> user_id=<uuid> request took 153ms"
    assert got[1] == "error <ts> user_id=323e4567-e89b-12d3-a456-<num> request took 150ms"


@pytest.mark.parametrize("text,expected", [
    ("authentication failed code 5", "<id> failed code <id>"),
    ("at 12:34:56", "at <ip>"),
    ("2026-01-15 12:00:01 up", "<id>-<id>-<id> <ip> up"),
    ("", ""),
    ("   spaced\t\tout  ", "spaced out"),
])
def test_quirks(spark, text, expected):
    assert run(spark, [text]) == [expected]


def test_same_as_python_re_on_documents(spark):
    """Brute force: every sf0.001 document through Spark and through Python's re."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    got = docs.select("doc_id", "text", normalise(F.col("text")).alias("m")).collect()
    assert len(got) > 0
    for r in got:
        assert r.m == py_normalise(r.text), r.doc_id


def test_rule_table_is_ordered():
    names = [r.name for r in FULL_RULES]
    assert names.index("url") < names.index("uuid") < names.index("ipv6") < names.index("ts_time") < names.index("number")


def test_java_forms_match_the_same(spark):
    """The faster spellings against the rules' own, on words of what the rules look for."""
    from nearline.functions import text as X
    rng = random.Random(3)
    parts = ["a", "k", "B", "\u017f", "\u212a", "\u0131", "\u00e9", "7", "25", "256", "0", ".", "@", "-", "_", "+", "%", "=", ":", " ", "\n", "/", "id", "ID", "user_id=",
             "\u017fession-id: ", "trace", "tas\u212a_id=", "abcdef", "10.0.0.1", "x@y.org", "\u0663", "Abc-123_def45", "1.2.3.4.5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = 0
    for rule in X.FULL_RULES:
        if rule.name in X.JAVA_FORMS:
            form = X._java_pattern(rule)
            plain = form[:form.index(")") + 1] + rule.pattern
            assert form != plain
            a, b = (F.regexp_replace("t", p, rule.replacement) for p in (plain, form))
            assert df.where(a != b).count() == 0, rule.name
            hits += df.where(a != F.col("t")).count() > 50
    assert hits == len(X.JAVA_FORMS)


def test_texts_without_a_digit_are_looked_at_once(spark):
    """A text without a digit is no rule's of the basic profile; the others as rule by rule."""
    from nearline.functions import text as X
    rng = random.Random(8)
    parts = ["a", "Z", "\u00e9", "7", "\u0663", "0x", "0xff", "12:30:45", "1.2.3.4", "2024-01-02T03:04:05Z", "123e4567-e89b-12d3-a456-426614174000", " ", "\n", "-", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = F.col("t")
    for rule in X.BASIC_RULES:
        plain = F.regexp_replace(plain, X._java_pattern(rule), rule.replacement)
    masked = X.mask(F.col("t"), "basic")
    assert df.where(~masked.eqNullSafe(plain)).count() == 0 and df.where(masked != F.col("t")).count() > 1000
    assert "regexp_like" in str(masked).lower() or "rlike" in str(masked).lower()


def test_log_lines_come_in_short_tasks(spark, tmp_path):
    from nearline.sources.tables import log_lines
    spark.range(600_000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "'view' AS event_type", "rand(1) AS value",
                                    "concat('{\"k\": ', rand(2), '}') AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert log_lines(spark, str(tmp_path)).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
