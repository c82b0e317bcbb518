"""Mixing: targets and selection against plain Python."""

import hashlib
import math
import re

from nearline.llm import mixing

SPACE = "\x20\x09-\x0d"


def brute(rows, weights=(5, 2, 1), share=1.5, cap=2):
    sized = []
    for i, t, s in rows:
        tie = hashlib.md5("\x1f".join(x for x in (None if i is None else str(i), t) if x is not None).encode()).hexdigest()
        n = len(t or "")
        q = max(0.05, (sum(c not in "#*$%&|<>!" for c in t) / n) ** 2) if n else 0.05
        u = (int(tie[:13], 16) + 0.5) / 2 ** 52
        sized.append((s, -math.log(u) / q, tie, len(re.findall(f"[^{SPACE}]+", t or "")), i))
    sources = sorted({x[0] for x in sized}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[3] for x in sized if x[0] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total, target, open_ = share * sum(size.values()), {}, set(sources)
    while open_:                                             # reshare until none is above
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > cap * size[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: float(cap * size[s]) for s in over}
        open_ -= set(over)
    out = []
    for s in sources:
        words = math.floor(target[s] + 0.5)
        epochs = words // size[s] if size[s] else 0
        rest = words - epochs * size[s]
        mine = sorted(x for x in sized if x[0] == s)
        k = 0
        while k < len(mine):
            same = [x for x in mine if x[1:3] == mine[k][1:3]]
            n = sum(x[3] for x in same)
            part = n if rest >= n else rest
            out += [(str(x[4]), x[3], size[s], round(target[s], 6), epochs * x[3] + (x[3] if part == n else part // len(same))) for x in same]
            rest -= part if part == n else rest
            k += len(same)
    return sorted(out)


def have(df):
    return sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.select(
        "__row.doc_id", "size", "source_size", "target", "taken").collect())


def test_edge_rows(docs, no_docs):
    got = have(mixing.mix(docs))
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert all(taken <= 2 * size for _, size, _, _, taken in got)
    assert mixing.mix(no_docs).count() == 0


def test_bins_and_reruns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = brute(rows)
    assert have(mixing.mix(docs)) == want
    assert have(mixing.mix(docs.repartition(7), mixing.MixParams(rows_per_bin=1))) == want
    by_source = {}
    for (i, _, s), _ in zip(rows, want):
        by_source[str(i)] = s
    total = {}
    for i, _, _, target, taken in want:
        t = total.setdefault(by_source[i], [target, 0])
        t[1] += taken
    assert all(abs(a - b) <= 1 for a, b in total.values())


def test_other_columns_survive(docs):
    assert mixing.mix(docs).select("__row.*").columns == docs.columns
