"""Compaction of the log-structured store, and look-ups that open only the segments they need."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearline.session import ensure_checkpoint_dir
from nearline.sources import store as S

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType()), T.StructField("note", T.StringType())])


def make(spark, mode="last_wins", **kw):
    return S.TableStore(spark, f"{ensure_checkpoint_dir(spark)}/cs-{uuid.uuid4().hex}", ROW, "id", mode, ["v"], **kw)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW).coalesce(1)


def seen(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("mode", ["last_wins", "first_wins"])
def test_same_view_with_and_without_compaction(spark, mode):
    rng = random.Random(7)
    plain, merged = make(spark, mode), make(spark, mode, compact_every=3, segment_bytes=2000)
    for epoch in range(9):
        rows = [(f"k{rng.randrange(40)}", rng.randrange(1000), f"{epoch}") for _ in range(12)]
        for st in (plain, merged):
            if mode == "first_wins":
                st.insert_if_absent(frame(spark, rows), epoch, "w")
            elif epoch % 4 == 3:
                st.delete_where(F.col("v") % 3 == 0, epoch, "w")
            elif epoch == 5:
                st.update_where(F.col("v") > 500, {"note": F.lit("changed")}, epoch, "w")
            else:
                st.upsert(frame(spark, rows), epoch, "w")
    want = seen(plain.current())
    assert seen(merged.current()) == want and merged._base().upto >= 6
    # Repeated writes, merged ones among them, change nothing.
    again = frame(spark, [("k1", 10 ** 6, "late"), ("new", 1, "late")])
    for epoch in (0, 2):
        (merged.insert_if_absent if mode == "first_wins" else merged.upsert)(again, epoch, "w")
    merged.delete_where(F.lit(True), 1, "w")
    assert seen(merged.current()) == want
    assert merged.next_epoch("w") == 9 and merged.next_epoch("other") == 0
    with pytest.raises(ValueError, match="merged"):
        merged.current(0)


def test_a_look_up_reads_few_files(spark):
    st = make(spark, "first_wins", compact_every=10, segment_bytes=4000)
    rows = [[(f"{e}-{i}", i, "x" * 40) for i in range(100)] for e in range(24)]
    for e, r in enumerate(rows):
        st.insert_if_absent(frame(spark, r), e)
    base = st._base()
    files = len(st._segments(base).inputFiles())
    assert base.upto >= 19 and files > 8 and base.slots > 8
    keys = frame(spark, [rows[3][5], rows[23][1], ("absent", 0, "")]).select("id")
    found = st.lookup(keys)
    assert seen(found) == sorted([rows[3][5], rows[23][1]])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "PartitionFilters: [slot" in plan
    slots = [r[0] for r in keys.select(st._slot(base.slots)).distinct().collect()]
    opened = st._segments(base, slots)
    # every file read holds rows of the wanted slots only
    used = {r[0] for r in opened.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(used) <= 3 + len(slots) and all(any(f"slot={s}/" in u for s in slots) for u in used)
    # what merged writes leave behind is bounded too
    assert len(st._names("/data")) < 24 and len(st._bases()) <= 2


def test_an_unfinished_write_holds_compaction_back(spark):
    st = make(spark)
    st.upsert(frame(spark, [("a", 1, "")]), 0, "w")
    st.place("dead", 0)                                        # dealt a place, never written
    st.upsert(frame(spark, [("b", 1, "")]), 1, "w")
    assert st.compact() == 0
    assert st.compact() is None
    st.abandon(0, "dead")
    assert st.compact() == 2 and seen(st.current()) == [("a", 1, ""), ("b", 1, "")]


def test_delete_keys_and_slots_by_another_column(spark):
    st = make(spark, slot_by="note", segment_bytes=500)
    st.upsert(frame(spark, [(f"k{i}", i, f"n{i % 5}") for i in range(60)]))
    st.compact()
    st.delete_keys(frame(spark, [("k7", 0, ""), ("gone", 0, "")]).select("id"))
    got = st.lookup(frame(spark, [("", 0, "n2")]).select("note"), on="note")
    assert seen(got) == sorted((f"k{i}", i, "n2") for i in range(2, 60, 5) if i != 7)
    assert S._joined([[4, 4], [0, 1], [2, 2], [9, 9]]) == [[0, 2], [4, 4], [9, 9]]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_come_once_are_not_sorted_as_a_whole(spark):
    """A view of one write compares nothing, and a write compares whole rows of repeated keys only."""
    st = make(spark)
    st.upsert(frame(spark, [("a", 1, "x"), ("b", 1, "y")]), 0, "w")
    assert "Exchange" not in plan(st.current()) and seen(st.current()) == [("a", 1, "x"), ("b", 1, "y")]
    rows = frame(spark, [("a", 1, "p"), ("a", 2, "q"), ("a", 2, "r"), (None, 3, "n"), ("c", 1, "s")])
    assert "SortAggregate" not in plan(st._one_per_key(frame(spark, [("a", 1, "p"), ("c", 1, "s")]), F.max_by))
    for pick, note in ((F.max_by, ("a", 2, "r")), (F.min_by, ("a", 1, "p"))):
        assert seen(st._one_per_key(rows, pick)) == [note, ("c", 1, "s")]
    st.upsert(rows, 1, "w")
    assert seen(st.current()) == [("a", 2, "r"), ("b", 1, "y"), ("c", 1, "s")]
    st.replace(spark.createDataFrame([], ROW), 0, "w")
    assert seen(st.current()) == [("a", 2, "r"), ("c", 1, "s")]
