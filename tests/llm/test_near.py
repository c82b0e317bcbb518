"""b-bit MinHash near-duplicates against exact all-pairs comparison."""

import random
import re

import numpy as np

from nearline.llm import bbit

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[k:k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted((str(i), len(s), str(find(i)) if i is not None else "None") for i, s in sets)


def have(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_edge_rows(docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = bbit.near_duplicates(docs)
    assert have(out) == brute(rows)
    assert {(r.doc_id, r.kept) for r in out.collect()} >= {(1, True), (2, False), (4, True), (None, True)}
    assert bbit.near_duplicates(no_docs).count() == 0


def copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(f"z{rng.randrange(5000)}" for _ in range(60))) for i in range(20)]


def test_family_in_many_tiles_and_chunks(spark, monkeypatch):
    """Chains of near copies: small tiles and chunks of edges give the same components."""
    rows = copies(150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert have(bbit.near_duplicates(df)) == want
    assert have(bbit.near_duplicates(df, bbit.NearParams(chunk_rows=20))) == want
    real = bbit.components
    monkeypatch.setattr(bbit, "components", lambda e, name: real(e, name, chunk=7))
    assert have(bbit.near_duplicates(df, bbit.NearParams(chunk_rows=40))) == want


def test_estimate_is_unbiased():
    p, rng = bbit.NearParams(), np.random.default_rng(5)
    sk, errors = bbit.Sketcher(p), []
    for _ in range(60):
        common, own = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = np.concatenate([common, own[:100]]), np.concatenate([common, own[100:]])
        s = [sk.low_bits(sk.minima(x)) for x in (a, b)]
        errors.append(bbit.estimate(s[0], s[1][None, :], p.hashes)[0] - 400 / 600)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_drop(docs):
    left = bbit.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "4", "5", "6", "7", "8", "8", "9", "None", "11", "12", "13", "14"])
