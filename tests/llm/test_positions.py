"""Benchmark decontamination against a brute-force search."""

import re

from nearline.llm import positions

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return W.findall((t or "").translate(LOWER))


def brute(text, items, width=10):
    w, hit, owners = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for k in range(max(1, len(iw) - width + 1) if iw else 0):
            win = iw[k:k + width]
            for s in range(len(w) - len(win) + 1):
                if w[s:s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    owners.add(str(item))
    return len(w), len(hit), sorted(owners)


ITEMS = [(1, "quick brown fox jumps over the lazy dog while seven wizards quietly watch"), (2, "TWO words"), (3, None), (4, ""), (10, "la plage"),
         (5, "same line"), (5, "same line"), (None, "other line"), (6, "word1 and1 word2 and2 word3 and3 word4 and4 word5 and5 word6 and6")]


def check(got, docs, items):
    want = sorted((str(r.doc_id), *brute(r.text, items)) for r in docs.collect())
    have = sorted((str(r.doc_id), r.n_words, sum(h["stop"] - h["start"] for h in r["hits"]), sorted(r["items"])) for r in got.collect())
    owners = lambda rows: [(*r[:3], [i for i in r[3] if i != "None"]) for r in rows]
    assert have == owners(want)


def test_edge_rows(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    check(positions.decontaminate(docs, items), docs, ITEMS)


def test_small_segments_and_blocks_change_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    check(positions.decontaminate(docs, items, segment_bytes=200, block_bytes=64), docs, ITEMS)


def test_runs_of_candidates(spark, docs, monkeypatch):
    monkeypatch.setattr(positions, "RUN", 3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = positions.build_index(docs)
    rows = positions.search(index, [(b"word5", b"and5"), (b"the",), (b"nowhere", b"the")]).collect()
    text = {r.doc_id: words(r.text) for r in docs.collect()}
    want = sorted((p, d, k) for p, ph in enumerate((["word5", "and5"], ["the"])) for d, w in text.items() if d is not None
                  for k in range(len(w)) if w[k:k + len(ph)] == ph)
    assert sorted((r.phrase, r.doc_id, r.position) for r in rows if r.doc_id is not None) == want
    assert items.count() == len(ITEMS)


def test_proximity(spark, docs):
    index = positions.build_index(docs)
    near = positions.search(index, [(b"fox", b"dog")], slop=5).where("doc_id = 1").collect()
    assert len(near) == 1 and not positions.search(index, [(b"fox", b"wizards")], slop=3).collect()


def test_empty_tables(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert positions.decontaminate(no_docs, items).count() == 0
    none = positions.decontaminate(docs, items.limit(0))
    assert none.count() == docs.count() and none.where("size(hits) > 0").count() == 0
