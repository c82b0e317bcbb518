"""The pipeline against its stages' brute-force versions, one after another."""

import re

import corpus_pipeline as C
import nearline.llm as llm
from nearline.session import cut_lineage

from .test_mixing import brute as mix_brute
from .test_near import brute as near_brute
from .test_positions import words
from .test_rules import brute as rules_brute
from .test_secrets import brute as secrets_brute


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "mix_sources"]


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k:k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    inputs = {}
    for name, stage in C.STAGES:
        inputs[name] = {r.doc_id: r for r in docs.collect()}
        docs = cut_lineage(stage(spark, docs, sf), f"test_{name}")
        assert docs.columns[:len(columns)] == columns
        out = {r.doc_id: r for r in docs.collect()}
        before = inputs[name]
        if name == "quality_rules":
            gone = set(before) - set(out)
            assert all(rules_brute(before[i].text)[5] or quality.get(i, 0) == 0 for i in gone)
            assert not any(rules_brute(r.text)[5] for r in out.values())
        elif name == "near_dedup":
            roots = near_brute([(r.doc_id, r.text) for r in before.values()])
            assert set(out) == {int(i) for i, _, root in roots if i == root}
        elif name == "decontamination":
            def hit(w):
                return any(tuple(w[k:k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
            assert set(out) == {i for i, r in before.items() if not hit(words(r.text))}
        elif name == "secret_scan":
            assert set(out) == set(before)
            for i, r in out.items():
                spans, masked, stop = secrets_brute(before[i].text), [], 0
                for _, s, e in spans:
                    masked += [before[i].text[stop:s], "[SECRET]"] if s >= stop else []
                    stop = max(stop, e)
                assert r.text == "".join([*masked, before[i].text[stop:]]) and r.n_chars == len(r.text)
                assert not re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text)
        else:
            taken = {int(i): t for i, _, _, _, t in mix_brute([(r.doc_id, r.text, r.source) for r in before.values()])}
            assert {i: r.taken for i, r in out.items()} == {i: t for i, t in taken.items() if t > 0}


def test_edge_rows_run_through(spark, docs, no_docs, sf):
    for table in (docs, no_docs):
        for _, stage in C.STAGES:
            table = cut_lineage(stage(spark, table, sf), "test_edges")
        assert "taken" in table.columns and table.count() >= 0


def test_one_row_of_each_group(spark, docs):
    """Repeated rows, texts that share an id and null ids: the pipeline's stage keeps one row of each group."""
    stage = dict(C.STAGES)["near_dedup"]
    assert sorted(str(r.doc_id) for r in stage(spark, docs, "").collect()) == sorted(["1", "4", "5", "6", "7", "8", "9", "11", "12", "13", "14"])
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(80)) for c in "abcd")
    rows = [(5, one), (5, one), (7, one), (7, two), (9, two), (None, three), (None, three), (None, four), (11, four), (None, None), (None, None), (12, None), (12, None)]
    out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "").collect()
    assert sorted((str(r.doc_id), (r.text or "")[:1]) for r in out if r.text != two) == sorted(
        [("5", "a"), ("None", "c"), ("11", "d"), ("None", ""), ("None", ""), ("12", "")])
    assert len([r for r in out if r.text == two]) == 1


def test_registered_once(spark):
    import __spark_entry__ as E
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(llm.ORACLES) <= set(llm.QUERIES)
