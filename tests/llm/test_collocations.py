import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearline.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, f int, shard int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def brute(rows, least=10, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for w in pieces(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["The", "ÉTÉ", "naïve", "x\x00y", "a b", "😀"]
    mark = [" ", " ", " ", " ", ". ", ", ", "\n", "\r\n", "\t", ";", "  ", "\x0b", "\x0c"]
    return ["".join(rng.choice(vocab[:8] if rng.random() < 0.6 else vocab) + rng.choice(mark) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, params=C.PhraseParams(**kw)).collect())


@pytest.mark.parametrize("least,top,block", [(10, 2000, None), (3, 40, 500), (1, 2000, 37)])
def test_brute_force(spark, monkeypatch, least, top, block):
    rng = random.Random(least)
    rows = [(t, rng.choice(["en", "en", "fr", None])) for t in texts(120, least)] + [(None, "en"), ("", "fr"), (" \t\n ", None), (None, None)]
    rows += [("New York City is big. " * 15, "en")] * 3                       # repeated rows
    rows += [("a very long passage without any mark " * 400, "de")]
    if block:
        monkeypatch.setattr(C, "BLOCK", block)
    assert run(spark, rows, least=least, top=top) == brute(rows, least, top)


def test_hot_pair(spark):
    rows = [("of the " + f"x{i % 700} " + f"y{i % 11}. of the", "en") for i in range(1500)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [("one word", "en")]) == [] and run(spark, [(None, None)]) == []


def test_exact_beyond_64_bits(spark):
    big = 10 ** 14 - 7
    got = spark.createDataFrame([(big, big + 11, big + 5), (3, 7, 9)], "a long, l long, r long").select(C.exact_score("a", "l", "r").alias("s"))
    assert [r["s"] for r in got.collect()] == [1000000 * big * big // ((big + 11) * (big + 5)), 1000000 * 9 // 63]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "ab", ".", "\n", ","]), max_size=60), st.integers(1, 9))
def test_flows_are_counts(marks, block):
    """Node flows with end corrections equal the counts, however the words are cut into blocks."""
    words, piece = C.words_of(" ".join(marks).encode())
    want = Counter()
    for w in pieces(" ".join(marks)):
        for k in (1, 2, 3):
            want.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    got = Counter()
    for a in range(0, len(words), block):
        own = min(block, len(words) - a)
        g = C.block_graph(words[a:a + own + 2], piece[a:a + own + 2], own)
        text = [x.decode() for x in g.words.to_pylist()]
        for x, y, z, c in zip(*g.edges):
            got[text[x], text[y], text[z]] += int(c)
        for x, y, c in zip(*g.nodes):
            got[text[x], text[y]] += int(c)
        for x in np.flatnonzero(g.counts):
            got[text[x],] += int(g.counts[x])
    assert got == want


def test_paths_are_compacted():
    words, piece = C.words_of(b"a b c d e f g h. x y z. a b c d e f g h")
    g = C.block_graph(words, piece, len(words))
    assert len(g.edges[3]) == 7 and g.paths == 2
