"""MinHash / LSH embedding (C1-C12): parameter checks, exact Jaccard, reference-identical signatures."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearline.functions.text import normalise
from nearline.operators import minhash as M

from .test_text import py_normalise


def test_parameter_checks():
    for bad in ({"shingle_size": 0}, {"num_hashes": 0}, {"bands": 0}, {"num_hashes": 10, "bands": 3}):
        with pytest.raises(ValueError):
            M.MinHashParams(**bad)


def grams(s, n=5):
    return {s[i:i + n] for i in range(0, len(s) - n + 1)} if len(s) >= n else set()


def test_fixture_jaccard(spark, logs):
    p = M.MinHashParams(5, 16, 8, 42, profile="full")
    sets = {r.id: r.grams for r in M.gram_sets(logs.withColumnRenamed("n", "id"), "id", "text", p).collect()}
    df = spark.createDataFrame([(a, b, sets[a], sets[b]) for a, b in [(3, 5), (4, 3), (1, 3), (4, 1), (4, 2)]],
                               "a int, b int, ga array<bigint>, gb array<bigint>")
    got = {(r.a, r.b): round(r.j, 6) for r in df.select("a", "b", M.exact_jaccard(F.col("ga"), F.col("gb")).alias("j")).collect()}
    assert got == {(3, 5): 1.0, (4, 3): 0.809524, (1, 3): 0.809524, (4, 1): 0.853659, (4, 2): 0.288462}


def py_minhash(text, p):
    """Plain-Python MinHash from the written definition (blake2b grams and family)."""
    s = py_normalise(text, p.profile)
    if p.stop_short_lines and len(s) < p.stop_short_lines:
        xs = set()
    else:
        xs = {int.from_bytes(hashlib.blake2b(g.encode(), digest_size=4).digest(), "little") for g in grams(s, p.shingle_size)}
    prime, mx = 4294967311, (1 << 32) - 1
    sig = []
    for i in range(p.num_hashes):
        h = hashlib.blake2b(f"{p.seed}:{i}".encode(), digest_size=16).digest()
        a, b = int.from_bytes(h[:8], "little") | 1, int.from_bytes(h[8:], "little")
        sig.append(min([mx] + [(a * x + b) % prime for x in xs]))
    r = p.num_hashes // p.bands
    keys = [f"lsh:{j}:" + hashlib.blake2b(",".join(map(str, sig[j * r:(j + 1) * r])).encode(), digest_size=8).hexdigest()
            for j in range(p.bands)]
    return sig, keys, len(xs)


def test_blake2b_signatures_match_definition(spark, logs):
    p = M.MinHashParams(5, 32, 8, 123, profile="full", hash="blake2b")
    extra = spark.createDataFrame([(10, ""), (11, "abc")], "n int, text string")
    df = logs.select("n", "text").unionByName(extra)
    got = {r.n: r for r in M.signatures(df, "n", "text", p).collect()}
    texts = {r.n: r.text for r in df.collect()}
    for n, t in texts.items():
        sig, keys, cnt = py_minhash(t, p)
        assert list(got[n].signature) == sig, n
        assert list(got[n].band_keys) == keys, n
        assert got[n].shingle_count == cnt, n


def test_empty_texts_share_all_max_signature(spark):
    p = M.MinHashParams(5, 8, 4, 1, profile="basic")
    df = spark.createDataFrame([(1, ""), (2, "ab")], "id int, text string")
    rows = M.signatures(df, "id", "text", p).collect()
    assert all(list(r.signature) == [4294967295] * 8 and r.shingle_count == 0 for r in rows)
    assert rows[0].band_keys == rows[1].band_keys


def test_estimate_tracks_exact_jaccard(spark, logs):
    p = M.MinHashParams(5, 128, 32, 7, profile="full")
    sig = {r.id: r.signature for r in M.signatures(logs.withColumnRenamed("n", "id"), "id", "text", p).collect()}
    df = spark.createDataFrame([(sig[3], sig[5]), (sig[4], sig[2])], "a array<bigint>, b array<bigint>")
    est = [r[0] for r in df.select(M.signature_similarity(F.col("a"), F.col("b"))).collect()]
    assert est[0] == 1.0 and abs(est[1] - 0.288) < 0.15


def test_arrow_and_jvm_engines_agree(spark):
    from .conftest import SF001
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    out = {}
    for engine in ("arrow", "jvm"):
        p = M.MinHashParams(5, 32, 8, 42, profile="basic", engine=engine)
        out[engine] = {r.doc_id: (list(r.signature), list(r.band_keys), r.shingle_count)
                       for r in M.signatures(docs, "doc_id", "text", p).collect()}
    assert out["arrow"] == out["jvm"] and len(out["arrow"]) > 0


def test_texts_to_sets_and_signatures_by_blocks(spark, monkeypatch):
    from nearline.functions import hashing as H
    rng = np.random.default_rng(3)
    texts = ["", "abcd", "abcde", "aaaaaaaaaa", "é😀ü" * 40] + ["".join(chr(c) for c in rng.integers(97, 101 + 3000 * (i % 2), 200)) for i in range(60)]
    for n in (1, 3, 5, 9):
        for name, digest in H.GRAM_HASHES.items():
            flat, offs = H.gram_block(texts, n, digest)
            want = [sorted({digest(t[k:k + n]) for k in range(len(t) - n + 1)}) for t in texts]
            assert [flat[a:z].tolist() for a, z in zip(offs[:-1], offs[1:])] == want
    monkeypatch.setattr(H, "_BLOCK", 500)
    params = H.hash_params(8, 7)
    seen = []
    for flat, offs in H._gram_blocks(pa.array([*texts, None]), 5, "md5"):
        for g, s in zip([flat[a:z].tolist() for a, z in zip(offs[:-1], offs[1:])], H.signature_block(flat, offs, 8, 7).tolist()):
            assert s == [min([H.MAX_HASH] + [(a * x + b) % H.PRIME for x in g]) for a, b in params]
            seen.append(g)
    assert len(seen) == len(texts) + 1 and seen[-1] == []


def test_plans_of_blake2b_and_band_keys(spark):
    """No gram is a row, rows of one id are one document, and the keys are computed in one place."""
    from nearline.plans.q_minhash import P_COMPAT, q_band_keys
    docs = spark.createDataFrame([(1, "some text of words")], "doc_id long, text string")
    plan = M.signatures(docs, "doc_id", "text", P_COMPAT)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning(doc_id") <= 2
    twice = spark.createDataFrame([(1, "some text"), (1, "other words"), (1, None), (2, "abc"), (None, "some text")], "doc_id long, text string")
    got = {r.doc_id: r for r in M.signatures(twice, "doc_id", "text", P_COMPAT).collect()}
    grams = {t[k:k + 5] for t in ("some text", "other words") for k in range(len(t) - 4)}
    assert len(got) == 3 and {k: r.shingle_count for k, r in got.items()} == {1: len(grams), 2: 0, None: 5}
    alone = M.signatures(twice.where("doc_id = 1 AND text IS NOT NULL").selectExpr("text AS doc_id", "text"), "doc_id", "text", P_COMPAT).collect()
    assert got[1].signature == [min(x) for x in zip(*(r.signature for r in alone))]
    keys = q_band_keys(spark, "/root/testdata/sf0.001")
    assert keys._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1



def test_blocks_of_signatures_and_twins(spark):
    """Nearest other signature by brute force, with points of one signature among them, whatever the size of a tile."""
    from nearline.operators import tiles
    from nearline.sources.band_index import similarity_blocks
    from nearline.streaming.neighbours import nearest_edges
    rng = random.Random(5)
    sigs = [[rng.randrange(3) for _ in range(8)] for _ in range(60)]
    sigs += sigs[:9]
    rows = [(f"{i:03d}", ",".join(map(str, s)), s, [10 * b + 100 * s[2 * b] + s[2 * b + 1] for b in range(4)]) for i, s in enumerate(sigs)]
    df = spark.createDataFrame(rows, "id string, key string, signature array<long>, bands array<long>")
    want = {}
    for i, _, s, b in rows:
        near = [(-sum(x == y for x, y in zip(s, t)) / 8, j) for j, _, t, c in rows if j != i and any(x == y for x, y in zip(b, c))]
        if near:
            want[i] = min(near)[::-1]
    got = {r.src: (r.dst, -r.sim) for r in nearest_edges(df, "jaccard").collect()}
    assert got == want and len(want) > 40
    one = df.groupBy("key").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    bands = one.select(F.explode("bands").alias("bk"), "key")
    costs = similarity_blocks("jaccard")
    plain = lambda a, block: costs(a, block)
    found = [sorted(map(tuple, tiles.best_matches(one, one, bands, bands, f, chunk, True).collect())) for f, chunk in ((costs, 7), (costs, 1000), (plain, 1000))]
    assert found[0] == found[1] == found[2] and costs.equal_places


def test_signatures_travel_once_a_group(spark, monkeypatch):
    """Tiles are long and hold numbers for heads; a signature joins before its row is repeated for the tiles."""
    from nearline.operators import tiles
    from nearline.sources.band_index import similarity_blocks
    rng = random.Random(9)
    sigs = [[rng.randrange(4) for _ in range(8)] for _ in range(1500)]
    rows = [(f"k{i:05d}", f"{i:05d}", s, [10 * b + 100 * s[2 * b] + s[2 * b + 1] for b in range(4)]) for i, s in enumerate(sigs)]
    df = spark.createDataFrame(rows, "key string, id string, signature array<long>, bands array<long>")
    bands = df.select(F.explode("bands").alias("bk"), "key")
    sent, real = [], tiles.by_groups
    monkeypatch.setattr(tiles, "by_groups", lambda df, *a: (sent.append(df), real(df, *a))[1])
    got = {r.key: (r.match_id, r.similarity) for r in tiles.best_matches(df, df, bands, bands, similarity_blocks("jaccard"), exclude_same=True).collect()}
    a, b = np.array(sigs), np.array([r[3] for r in rows])
    for i in range(0, 1500, 100):
        score = (a[i] == a).sum(axis=1) * (b[i] == b).any(axis=1)
        score[i] = 0
        assert got[f"k{i:05d}"] == (f"{int(score.argmax()):05d}", score.max() / 8)
    groups = bands.groupBy("bk").agg(F.min("key").alias("head")).join(bands, "bk").select("head", "key").distinct().count()
    assert sent[0].where("NOT asks").count() <= groups and dict(sent[0].dtypes)["head"] == "bigint"


def test_equal_texts_of_a_batch_are_hashed_once(monkeypatch):
    import pyarrow as pa
    from nearline.functions import hashing as H
    seen = []
    real = H.gram_block
    monkeypatch.setattr(H, "gram_block", lambda texts, n, digest: (seen.extend(texts), real(texts, n, digest))[1])
    texts = pa.array(["took <id> ms", None, "took <id> ms", "other words", "", "took <id> ms"])
    out = H.text_embed_udf(5, 16, 4, 42).func(texts).to_pylist()
    assert sorted(seen) == ["", "other words", "took <id> ms"]
    assert out[0] == out[2] == out[5] != out[3] and out[1] == out[4] and out[1]["shingle_count"] == 0
    assert [len(x["signature"]) for x in out] == [16] * 6 and [len(x["band_keys"]) for x in out] == [4] * 6


def test_embedded_band_keys_are_the_columns(spark):
    p = M.MinHashParams(5, 16, 8, 42, profile="basic")
    df = spark.createDataFrame([(1, "Took 12 ms at noon"), (2, None), (3, ""), (4, "took 13 ms at noon"), (5, "ça va bien, été")], "id int, text string")
    rows = M.embed_rows(df, "text", p)
    assert rows.columns == ["id", "text", "signature", "shingle_count", "band_keys"]
    assert rows.where(F.col("band_keys") != M.band_keys(F.col("signature"), p)).count() == 0
    plain = M.signatures_from_sets(M.gram_sets(df, "id", "text", p), "id", p)
    assert sorted((r.id, r.signature, r.shingle_count, r.band_keys) for r in rows.collect()) == sorted(
        (r.id, r.signature, r.shingle_count, r.band_keys) for r in plain.select("id", "signature", "shingle_count", "band_keys").collect())


def test_hashes_without_a_call_or_a_division_each(monkeypatch):
    """MD5 of many runs at once, the hash family at its edges, and least values of long sets, against their definitions."""
    from nearline.functions import hashing as H
    joined = "plain words, 0123 " + "\u00e9\u4e00\U0001f600\x00" * 30 + "end of it" * 9
    for n in (1, 4, 5, 13, 14):
        at = np.arange(len(joined) - n + 1)
        assert H._hash_runs(joined, at, n, H._md5_u32).tolist() == [H._md5_u32(joined[k:k + n]) for k in at]
    calls = []
    monkeypatch.setattr(H.hashlib, "md5", lambda *a: calls.append(a) or hashlib.new("md5", *a))
    H.ranked_block([joined], 5, H._md5_u32)
    assert not calls
    rng = np.random.default_rng(6)
    x = np.append(rng.integers(0, 1 << 32, 5000), [0, 1, H.MAX_HASH])
    factors = [(H.PRIME - 1, H.PRIME - 1), (1 << 32, 7), ((1 << 32) - 1, H.PRIME - 1), (1, 0), (0, H.PRIME - 1), (123456789, 987654321)]
    assert H._family(x, factors).tolist() == [[min((a * v + b) % H.PRIME, H.MAX_HASH) for a, b in factors] for v in x.tolist()]
    sets = [np.unique(rng.integers(0, 1 << 32, k)) for k in (0, 1, 100, 20000, 3000)]
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    offs = np.append(0, np.cumsum([len(s) for s in sets]))
    for table in (H._TABLE, 50_000):
        monkeypatch.setattr(H, "_TABLE", table)
        for likely in (8, 1):                                # 1: few sets are settled by their small values
            monkeypatch.setattr(H, "_LIKELY", likely)
            got = H.least_block(values, places, offs, 16, 7)
            assert got.tolist() == [[min([H.MAX_HASH] + [(a * v + b) % H.PRIME for v in s.tolist()]) for a, b in H.hash_params(16, 7)] for s in sets]
