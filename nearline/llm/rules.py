"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted
target and the raw corpus, next to fixed per-text rules.  DataFrame functions only.

Tokens are runs of ASCII punctuation or runs of anything else but spaces;
unigrams and bigrams (the last one with the end) are hashed into ``buckets``.  Two multinomials are counted over the
whole corpus in one combinable aggregate: all texts (raw), and the texts that
pass the trust rule (target; no label is used).  A text's score is the mean
over its n-grams of ln(p_target / p_raw), in whole ten-thousandths so that
sums do not depend on order; below ``threshold`` it is rejected.  The ratio
table has one number per bucket, whatever the corpus, and goes to the tasks
as a constant.

Per-text rules work inside the row (sorts and set functions on hashes of
words), so no text, word or window is ever shuffled.

Defined cases: a null text is empty: all counts are 0 and the base rule
rejects it (fewer than 50 words); a text without n-grams scores 0; rows with
repeated ids are judged one by one; input columns of any name are carried
through unchanged in ``__row``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SIGNS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
TOKEN = r"[a-zA-Z0-9\x80-\x{10FFFF}]+|[!-/:-@\[-`{-~]+"
SCALE = 10_000


@dataclass(frozen=True)
class RuleParams:
    buckets: int = 1 << 16          # a power of two
    threshold: float = -0.5         # mean ln ratio below which a text is rejected
    smoothing: float = 0.5
    trusted_tokens: int = 50        # a trusted text has at least so many tokens,
    trusted_upper: float = 0.2      # at most this share of capitals, no sign of SIGNS and no repeated line


def count_of(text: Column, chars: str) -> Column:
    """How many of these ASCII characters a text holds: the bytes that go with them."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def pair_hashes(h: str) -> Column:
    """Hashes of each token with the next (the last one with the end)."""
    return F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def bucket(h: Column, p: RuleParams) -> Column:
    return h.bitwiseAND(F.lit(p.buckets - 1)).cast("int")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def count_grams(docs: DataFrame, p: RuleParams) -> DataFrame:
    """``(bucket, raw, target)`` over all texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), token_hashes(text).alias("h"), worded_lines(text).alias("lines"))
    trusted = ((F.size("h") >= p.trusted_tokens)
               & (count_of(F.col("text"), SIGNS) == 0)
               & (F.regexp_count("text", F.lit("[A-Z]")) <= p.trusted_upper * F.char_length("text"))
               & (F.size("lines") == F.size(F.array_distinct("lines"))))
    # The flag first: an expression beside explode() would be worked out for every n-gram.
    # explode_outer: for a plain explode Spark adds a filter that works out the hashes once more.
    return (rows.select(trusted.cast("int").alias("trusted"), F.concat("h", pair_hashes("h")).alias("hashes"))
            .select("trusted", F.explode_outer("hashes").alias("h")).where("h is not null")
            .groupBy(bucket(F.col("h"), p).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target")))


def ratio_table(docs: DataFrame, p: RuleParams) -> list[int]:
    """ln(p_target / p_raw) per bucket, in ten-thousandths; at most
    ``buckets`` counts reach the driver."""
    raw, target = [0] * p.buckets, [0] * p.buckets
    for r in count_grams(docs, p).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * p.buckets                  # nothing trusted to compare with
    n_raw, n_target = sum(raw) + p.smoothing * p.buckets, sum(target) + p.smoothing * p.buckets
    return [round(SCALE * math.log((t + p.smoothing) / n_target * n_raw / (r + p.smoothing))) for r, t in zip(raw, target)]


def repeated_words(docs: DataFrame) -> DataFrame:
    """From ``words`` to ``n_repeat_words``: words in 3-word windows that the
    text holds twice or more.

    Only texts with equal windows are sorted.  Up to 65,536 windows the sort
    is one of plain numbers, the hash's high 48 bits with the place below, and
    neighbours are compared in full; longer texts sort (hash, place).
    """
    at = lambda k: F.slice("words", k, F.greatest(F.size("words") - 2, F.lit(0)))
    windows = F.zip_with(F.zip_with(at(1), at(2), lambda a, b: F.xxhash64(a, b)), at(3), lambda a, b: F.xxhash64(a, b))
    docs = docs.withColumn("w3", windows).withColumn("again", F.size(F.array_distinct("w3")) < F.size("w3"))
    short = F.size("w3") <= 65536
    high = lambda x: x.bitwiseAND(F.lit(-65536).cast("long"))
    low = lambda x: x.bitwiseAND(F.lit(65535).cast("long")).cast("int")
    docs = docs.withColumn("s3", F.when(F.col("again") & short, F.sort_array(F.transform("w3", lambda x, i: high(x).bitwiseOR(i.cast("long"))))))
    docs = docs.withColumn("t3", F.when(F.col("again") & ~short, F.array_sort(F.transform("w3", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda a, b: (high(a) == high(b)) & (F.get("w3", low(a)) == F.get("w3", low(b)))
    pairs = F.zip_with("s3", F.slice("s3", 2, F.size("s3")), lambda a, b: F.when(same(a, b), F.array(low(a), low(b))))
    long_pairs = F.zip_with("t3", F.slice("t3", 2, F.size("t3")), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    found = F.when(F.col("s3").isNotNull(), F.array_compact(pairs)).when(F.col("t3").isNotNull(), F.array_compact(long_pairs))
    docs = docs.withColumn("places", F.array_sort(F.array_distinct(F.flatten(found))))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(acc["stop"], i)).alias("n"), (i + 3).alias("stop")))["n"]
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("words", "w3", "again", "s3", "t3", "places")


def quality_rules(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """Every row of ``docs`` as ``__row`` with ``n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``."""
    # A split of a constant is folded into one array literal before the job starts.
    table = F.split(F.lit(",".join(map(str, ratio_table(docs.select("text"), p)))), ",").cast("array<int>")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = d.select("__row", "text", F.array_remove(F.split("text", f"[{SPACE}]+"), "").alias("words"), token_hashes(F.col("text")).alias("h"),
                 worded_lines(F.col("text")).alias("lines"))
    ratio = lambda acc, h: acc + F.get(table, bucket(h, p))
    none = F.lit(0).cast("long")
    total = F.aggregate("h", none, ratio) + F.aggregate(pair_hashes("h"), none, ratio)
    d = d.select(
        "__row", "words", F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - count_of(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        count_of(F.col("text"), SIGNS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("h") > 0, total / (2 * SCALE * F.size("h"))).otherwise(0.0).alias("score"))
    d = repeated_words(d)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= p.threshold))


def keep_good(docs: DataFrame, p: RuleParams = RuleParams()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The verdict is turned into a row by a generator: a filter on it would be
    pushed down as an expression, and all rules worked out again for it.
    """
    kept = F.when(F.col("kept"), F.array(F.struct(F.lit(True).alias("__kept"), F.col("__row"))))
    return quality_rules(docs, p).select(F.inline_outer(kept)).where("__kept IS NOT NULL").select("__row.*")
