import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearline.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows, parts, entries, rounds):
    """Plain Python from the definition; rows are (vec_id, floats, label)."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        got = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
    by = {}
    for _, lab, _, e in out:
        by[lab] = by.get(lab, 0) + e
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((*r, by[r[1]]) for r in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def vectors(n, dim, seed, wide=False):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) * (1e4 if wide and rng.random() < 0.1 else 1) for _ in range(dim)], rng.choice([0, 1, 1, 1, None])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,dim,parts,entries,rounds,wide", [(150, 32, 16, 64, 2, False), (90, 8, 4, 7, 3, True), (20, 16, 16, 64, 2, False)])
def test_brute_force(spark, n, dim, parts, entries, rounds, wide):
    rows = vectors(n, dim, n, wide) + [
        (1000, None, 1), (1001, [None] + [0.5] * (dim - 1), 1), (1002, [float("nan")] * dim, 1), (1003, [float("inf")] * dim, None), (1004, [], 2),
        (None, [0.25] * dim, 5), (None, [-0.25] * dim, None), (3, [0.125] * dim, 1), (3, [0.125] * dim, 1), (1005, [-0.0] * dim, 0)]
    df = spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], SCHEMA).repartition(3)
    out, books = codes.compress(df, params=codes.CodeParams(parts, entries, rounds))
    want, digest = brute(rows, parts, entries, rounds)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    assert codes.books_digest(books) == digest


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [0.5] * 16, 0) for i in range(70)]            # 64 equal entries
    out, _ = codes.compress(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    assert {(r["code"], r["error"]) for r in out.collect()} == {("00" * 16, 0)}


def test_small_blocks_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "", "") for r in vectors(120, 32, 5)], SCHEMA)
    a, books = codes.compress(df)
    monkeypatch.setattr(codes, "BLOCK", 32 * 7)
    b, again = codes.compress(df)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str) and (books == again).all()


def test_empty_and_unusable(spark):
    none = spark.createDataFrame([], SCHEMA)
    out, books = codes.compress(none)
    assert out.collect() == [] and codes.books_digest(books) == hashlib.sha256(b"").hexdigest()
    out, _ = codes.compress(spark.createDataFrame([(1, None, 1, "", ""), (2, [], 1, "", "")], SCHEMA))
    assert out.collect() == []
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [0.5] * 17, 1, "", "")], SCHEMA))
    with pytest.raises(Exception, match="several lengths|one length"):
        codes.compress(spark.createDataFrame([(1, [0.5] * 16, 1, "", ""), (2, [0.5] * 32, 1, "", "")], SCHEMA))[0].collect()
    with pytest.raises(Exception, match="beyond"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1, "", "")], SCHEMA))
    with pytest.raises(ValueError):
        codes.CodeParams(entries=300)


def test_decode_gives_the_entries(spark):
    df = spark.createDataFrame([(*r, "", "") for r in vectors(100, 32, 9)], SCHEMA)
    out, books = codes.compress(df)
    both = df.join(out.select(F.col("id").alias("vec_id"), "code", F.col("error").alias("err")).withColumnRenamed("code", "c"), "vec_id")
    far = F.aggregate(F.zip_with(F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)), codes.decode(F.col("c"), books),
                                 lambda a, b: (a - b * 256) * (a - b * 256)), F.lit(0.0), lambda s, x: s + x)
    assert both.where(F.abs(far - F.col("err")) > 1e-6).count() == 0
