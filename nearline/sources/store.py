"""Point store and lookup table as log-structured Parquet folders.

Layout under ``root``: ``_meta`` (one JSON row: dim, distance, key),
``data/seq=N`` (one folder per write), ``commits`` (which writer's which
epoch is write N) and ``base`` (merged segments).  A write is named by
``(writer, epoch)``: a stream's micro-batch number, or a number that the store
deals out itself.  Its place N in the log is dealt out once, by creating a file
that must not exist yet, so two writers never share a place, a stream that
starts again at epoch 0 under another name overwrites nothing, and a repeated
epoch replaces exactly its own rows, also when it has none.

* ``mode="last_wins"`` (points, A5): the current view keeps, per key, the
  row of the latest write (ties: the latest order columns); rows flagged
  ``__deleted`` hide the key (A12).
* ``mode="first_wins"`` (lookup, A7): a key is inserted only if absent;
  inside a write the first row by the order columns wins.

**Compaction.**  :meth:`TableStore.compact` merges all finished writes up to a
place into segments: one row per key, dealt into ``slots`` by a hash of the key
(as many as their bytes need), sorted by key inside a slot and with a Parquet
Bloom filter on it.  A look-up of keys opens only the slots they fall into, and
inside them only row groups whose key range and Bloom filter admit one; a
view joins the (few) later writes onto the segments, which need no aggregate.
``compact_every`` does it after so many writes.  Writes at or before the place
are settled: repeating one changes nothing, and the view before it is gone.
Merged writes are deleted at the compaction after next, so readers have time
to finish; what is remembered of them is one range of epochs per writer.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

DISTANCES = ("cosine", "euclidean", "dot", "jaccard")
OWN = "store"                       # the writer of epochs that the store deals out


class Base(NamedTuple):
    """A finished compaction: the place it reaches, its number of slots, its folder."""
    upto: int
    slots: int
    path: str


class TableStore:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str = "id",
                 mode: str = "last_wins", order: list[str] | None = None, slot_by: str | None = None,
                 compact_every: int = 0, segment_bytes: int = 128 << 20):
        if mode not in ("last_wins", "first_wins"):
            raise ValueError("mode must be 'last_wins' or 'first_wins'")
        self.slot_by, self.compact_every, self.segment_bytes = slot_by or key, compact_every, segment_bytes
        self.spark, self.root, self.schema, self.key, self.mode = spark, root.rstrip("/"), schema, key, mode
        self.order = order or []

    # ------------------------------------------------------------ table life
    def _fs_path(self, sub: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root + sub)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        p, fs = self._fs_path("/_meta")
        return bool(fs.exists(p))

    def create_if_absent(self, **props) -> bool:
        """Write ``_meta``; returns False when the table already exists."""
        if "distance" in props and props["distance"] not in DISTANCES:
            raise ValueError(f"distance is one of {DISTANCES}, not {props['distance']!r}")
        if self.exists():
            return False
        meta = dict(props, key=self.key, mode=self.mode)
        self.spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string") \
            .coalesce(1).write.mode("overwrite").text(self.root + "/_meta")
        return True

    def properties(self) -> dict:
        return json.loads(self.spark.read.text(self.root + "/_meta").first()[0])

    def drop_if_present(self) -> bool:
        """A4: remove the table folder."""
        p, fs = self._fs_path()
        return bool(fs.delete(p, True)) if fs.exists(p) else False

    def truncate(self) -> None:
        """Delete every row, keep the definition (schema and properties)."""
        for sub in ("/data", "/commits", "/places", "/settled", "/base"):
            p, fs = self._fs_path(sub)
            if fs.exists(p):
                fs.delete(p, True)

    # ------------------------------------------------------------ places in the log
    def _names(self, sub: str) -> list[str]:
        p, fs = self._fs_path(sub)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _commits(self) -> dict[tuple[str, int], int]:
        """(writer, epoch) -> place, from the names of small files alone."""
        out = {}
        for name in self._names("/commits"):
            seq, writer, epoch = name.split("~")
            out[writer, int(epoch)] = int(seq)
        return out

    def place(self, writer: str, epoch: int) -> int:
        """The place of a write; dealt out at its first call, the same ever after
        (a merged write's is that of its compaction)."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", writer):
            raise ValueError(f"a writer's name has letters, digits and _.- only: {writer!r}")
        known, base = self._commits(), self._base()
        if (writer, epoch) in known:
            return known[writer, epoch]
        if any(a <= epoch <= b for a, b in self._settled(base).get(writer, [])):
            return base.upto
        seq = max((int(n) for n in self._names("/places")), default=-1) + 1
        seq = max(seq, base.upto + 1) if base else seq
        while True:
            p, fs = self._fs_path(f"/places/{seq}")
            if fs.createNewFile(p):
                break
            seq += 1
        p, fs = self._fs_path(f"/commits/{seq:012d}~{writer}~{epoch}")
        fs.createNewFile(p)
        return seq

    def next_epoch(self, writer: str = OWN) -> int:
        settled = (b for _a, b in self._settled(self._base()).get(writer, []))
        return max([*(e for w, e in self._commits() if w == writer), *settled], default=-1) + 1

    def _own(self, epoch: int | None, writer: str) -> int:
        return self.place(writer, self.next_epoch(writer) if epoch is None else epoch)

    # ------------------------------------------------------------ segments
    def _bases(self) -> list[Base]:
        """Finished compactions, the latest first."""
        out = []
        for name in self._names("/base"):
            upto, slots, _ = name.split("~")
            if self._has(f"/settled/{name}"):                 # written after the segments
                out.append(Base(int(upto), int(slots), f"/base/{name}"))
        return sorted(out, key=lambda b: (-b.upto, b.path))

    def _base(self) -> Base | None:
        return next(iter(self._bases()), None)

    def _settled(self, base: Base | None) -> dict[str, list[list[int]]]:
        """Ranges of merged epochs per writer."""
        if base is None:
            return {}
        p, fs = self._fs_path(base.path.replace("/base/", "/settled/"))
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def has_writes(self, before: int) -> bool:
        """True where a write below a place is there (names are listed, no row is read)."""
        return self._base() is not None or any(int(n.split("=")[1]) < before for n in self._names("/data"))

    def is_settled(self, seq: int) -> bool:
        base = self._base()
        return base is not None and seq <= base.upto

    def _finished(self, after: int) -> int:
        """The last place up to which every place after ``after`` is written."""
        done = {int(n.split("=")[1]) for n in self._names("/data") if self._has(f"/data/{n}/_SUCCESS")}
        while after + 1 in done:
            after += 1
        return after

    def _has(self, sub: str) -> bool:
        p, fs = self._fs_path(sub)
        return bool(fs.exists(p))

    def _slot(self, slots: int, by: str | None = None) -> Column:
        return F.pmod(F.xxhash64(by or self.slot_by), F.lit(slots)).cast("int")

    def compact(self) -> int | None:
        """Merge the finished writes into segments; the place they reach (None: nothing new)."""
        before = self._bases()
        old = before[0] if before else None
        upto = self._finished(old.upto if old else -1)
        if upto < 0 or (old and upto <= old.upto):
            return None
        rows = self._winners(upto + 1)
        if self.mode == "last_wins":
            rows = rows.where(~F.coalesce("__deleted", F.lit(False)))
        merged = [f"/data/{n}" for n in self._names("/data") if (old.upto if old else -1) < int(n.split("=")[1]) <= upto]
        size = sum(self._bytes(x) for x in merged) + (self._bytes(old.path) if old else 0)
        slots = 1 << max(0, math.ceil(math.log2(max(1, size / self.segment_bytes))))
        name = f"/{upto:012d}~{slots}~{uuid.uuid4().hex[:8]}"
        (rows.withColumn("slot", self._slot(slots)).hint("rebalance", "slot").sortWithinPartitions("slot", self.slot_by, self.key)
         .write.option(f"parquet.bloom.filter.enabled#{self.slot_by}", "true").partitionBy("slot").parquet(f"{self.root}/base{name}"))
        epochs = {w: list(r) for w, r in self._settled(old).items()}
        for (writer, epoch), seq in self._commits().items():
            if seq <= upto:
                epochs.setdefault(writer, []).append([epoch, epoch])
        text = json.dumps({w: _joined(r) for w, r in epochs.items()}, sort_keys=True)
        p, fs = self._fs_path("/settled" + name)
        out = fs.create(p)
        out.writeBytes(text)
        out.close()
        self._forget(before)
        return upto

    def _bytes(self, sub: str) -> int:
        p, fs = self._fs_path(sub)
        return int(fs.getContentSummary(p).getLength())

    def _forget(self, before: list[Base]) -> None:
        """Delete what the compaction before the last one had merged already."""
        gone = [b.path.replace("/base/", x) for b in before[1:] for x in ("/settled/", "/base/")]
        if before:
            gone += [f"/data/{n}" for n in self._names("/data") if int(n.split("=")[1]) <= before[0].upto]
            gone += [f"/places/{n}" for n in self._names("/places") if int(n) <= before[0].upto]
            gone += [f"/commits/{n}" for n in self._names("/commits") if int(n.split("~")[0]) <= before[0].upto]
        for sub in gone:
            p, fs = self._fs_path(sub)
            fs.delete(p, True)

    # ------------------------------------------------------------ reads
    def _tail_paths(self, base: Base | None, before: int | None) -> list[str]:
        low, high = base.upto if base else -1, before if before is not None else 1 << 62
        return [f"{self.root}/data/{n}" for n in self._names("/data") if low < int(n.split("=")[1]) < high]

    def _tail(self, base: Base | None, before: int | None) -> DataFrame:
        """The writes after the segments."""
        paths = self._tail_paths(base, before)
        if not paths:
            df = self.spark.createDataFrame([], self._log_schema())
        else:
            df = self.spark.read.schema(self._log_schema()).option("basePath", self.root + "/data").parquet(*paths)
        return df.select(*self._cols(), "__deleted", "seq")

    def _segments(self, base: Base, slots: list[int] | None = None) -> DataFrame:
        schema = T.StructType([*self._log_schema().fields, T.StructField("slot", T.IntegerType())])
        df = self.spark.read.schema(schema).parquet(self.root + base.path)
        return (df if slots is None else df.where(F.col("slot").isin(slots))).drop("slot")

    def _at(self, before: int | None) -> Base | None:
        base = self._base()
        if base is not None and before is not None and before <= base.upto:
            raise ValueError(f"the view before write {before} is gone: writes up to {base.upto} are merged")
        return base

    def _cols(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def log(self, before: int | None = None) -> DataFrame:
        """Every row kept, with its place (``seq``); ``before``: below that place."""
        base = self._at(before)
        tail = self._tail(base, before)
        return tail if base is None else self._segments(base).unionByName(tail)

    def _log_schema(self) -> T.StructType:
        return T.StructType(list(self.schema.fields) + [T.StructField("__deleted", T.BooleanType(), True),
                                                        T.StructField("seq", T.LongType(), True)])

    def _winners_of(self, rows: DataFrame, writes: int) -> DataFrame:
        if writes < 2:                                        # a write has one row per key: nothing to compare
            return rows.where(F.col(self.key).isNotNull())
        lg = rows.withColumn("__rank", F.struct("seq", *self.order))
        pick = F.max if self.mode == "last_wins" else F.min
        win = lg.groupBy(self.key).agg(pick("__rank").alias("__rank"))
        return lg.join(win, (lg[self.key] == win[self.key]) & lg["__rank"].eqNullSafe(win["__rank"]), "left_semi").drop("__rank")

    def _winners(self, before: int | None, slots: list[int] | None = None, narrow=lambda df: df) -> DataFrame:
        """The winning row per key, deleted ones included.  Segments hold one row
        per key: a later write beats it (or never does, where the first wins)."""
        base = self._at(before)
        tail, writes = narrow(self._tail(base, before)), len(self._tail_paths(base, before))
        if base is None:
            return self._winners_of(tail, writes)
        merged = narrow(self._segments(base, slots))
        if self.mode == "last_wins":
            return merged.join(tail.select(self.key).distinct(), self.key, "left_anti").unionByName(self._winners_of(tail, writes))
        return merged.unionByName(self._winners_of(tail.join(merged.select(self.key), self.key, "left_anti"), writes))

    def current(self, before: int | None = None) -> DataFrame:
        """Latest (or first) row per key, deleted keys hidden.

        ``before``: the view as it was before that place (a repeated write
        sees exactly the state its first run saw).
        """
        return self._winners(before).where(~F.coalesce("__deleted", F.lit(False))).select(*self._cols())

    def lookup(self, keys: DataFrame, before: int | None = None, on: str | None = None) -> DataFrame:
        """The current rows whose ``on`` (the key, or the column that slots go by)
        is in the one column of ``keys``.  Only the slots that the keys fall into
        are opened; at most their numbers, one per segment, reach the driver."""
        on = on or self.key
        wanted = keys.toDF(on).where(F.col(on).isNotNull()).distinct()
        base, slots = self._at(before), None
        if base is not None and on == self.slot_by:
            slots = sorted(r[0] for r in wanted.select(self._slot(base.slots, on)).distinct().collect())
        rows = self._winners(before, slots, lambda df: df.join(wanted, on, "left_semi"))
        return rows.where(~F.coalesce("__deleted", F.lit(False))).select(*self._cols())

    # ------------------------------------------------------------ writes
    def _write(self, rows: DataFrame, seq: int, deleted: bool = False) -> None:
        if self.is_settled(seq):                              # a repeated write that is merged already
            return
        flag = F.col("__deleted") if "__deleted" in rows.columns else F.lit(deleted)
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], flag.alias("__deleted"))
        out.write.mode("overwrite").parquet(f"{self.root}/data/seq={seq}")
        if self.compact_every and len(self._names("/data")) >= self.compact_every:
            base = self._base()
            if sum(int(n.split("=")[1]) > (base.upto if base else -1) for n in self._names("/data")) >= self.compact_every:
                self.compact()

    def _one_per_key(self, rows: DataFrame, pick) -> DataFrame:
        """The winning row of each key.  Whole rows are compared only where a key
        comes twice; the others are written where they were made."""
        cols = [f.name for f in self.schema.fields if f.name != self.key]
        rows = rows.where(F.col(self.key).isNotNull())
        twice = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(self.key)
        single = rows.select(self.key, *cols)
        if twice.isEmpty():
            return single
        twice = cut_lineage(twice, "store_repeated")
        whole = F.struct(*cols)
        # Ties of the order columns go by the other values, so a repeated write picks the same row.
        rank = F.struct(*self.order, *[F.col(c).cast("string").alias(f"__{c}") for c in cols])
        # Dealt out by key first: sorted in shares of a partition, not in the task that made them.
        more = rows.join(twice, self.key, "left_semi").repartition(self.key).groupBy(self.key).agg(pick(whole, rank).alias("__r"))
        return single.join(twice, self.key, "left_anti").unionByName(more.select(self.key, *[F.col(f"__r.{c}").alias(c) for c in cols]))

    def upsert(self, rows: DataFrame, epoch: int | None = None, writer: str = OWN) -> int:
        """A5: last write wins per key (inside the write: last by the order columns)."""
        seq = self._own(epoch, writer)
        self._write(self._one_per_key(rows, F.max_by), seq)
        return seq

    def insert_if_absent(self, rows: DataFrame, epoch: int | None = None, writer: str = OWN, distinct: bool = False) -> int:
        """Keys already present (in earlier writes) are skipped; first wins.
        ``distinct``: no key is null or comes twice."""
        seq = self._own(epoch, writer)
        if self.is_settled(seq):
            return seq
        one = rows if distinct else self._one_per_key(rows, F.min_by)
        if self._base() is None:
            present = self.log(seq).select(self.key).distinct()
        else:
            one = cut_lineage(one, "store_insert")            # read twice: for its slots and for the rows
            present = self.lookup(one.select(self.key), seq).select(self.key)
        self._write(one.join(present, self.key, "left_anti"), seq)
        return seq

    def delete_where(self, cond: Column, epoch: int | None = None, writer: str = OWN) -> int:
        """Tombstones for current rows where ``cond`` holds (null -> kept)."""
        seq = self._own(epoch, writer)
        if not self.is_settled(seq):
            self._write(self.current(seq).where(F.coalesce(cond, F.lit(False))), seq, deleted=True)
        return seq

    def delete_keys(self, keys: DataFrame, epoch: int | None = None, writer: str = OWN) -> int:
        """A12 by key: tombstones for the given keys (one column), as far as they are there."""
        seq = self._own(epoch, writer)
        if not self.is_settled(seq):
            self._write(self.lookup(keys, seq), seq, deleted=True)
        return seq

    def update_where(self, cond: Column, updates: dict[str, Column], epoch: int | None = None, writer: str = OWN) -> int:
        """Rewrite matching current rows with the given column values."""
        seq = self._own(epoch, writer)
        if not self.is_settled(seq):
            self._write(self.current(seq).where(F.coalesce(cond, F.lit(False))).withColumns(updates), seq)
        return seq

    def put(self, rows: DataFrame, epoch: int, writer: str) -> int:
        """Whole rows, one per key, with a ``__deleted`` flag each."""
        return self.replace(rows.select(*self._cols(), "__deleted"), epoch, writer)

    def is_written(self, epoch: int, writer: str = OWN) -> bool:
        """True where that write is finished."""
        seq = self._commits().get((writer, epoch))
        if seq is not None and self._has(f"/data/seq={seq}/_SUCCESS"):
            return True
        return any(a <= epoch <= b for a, b in self._settled(self._base()).get(writer, []))

    def writes(self, before: int, wanted) -> list[tuple[int, DataFrame]]:
        """``(place, rows with __deleted)`` of the finished writes below a place for
        which ``wanted(place)`` holds; merged ones come as one, under the place they reach."""
        out, base = [], self._base()
        if base is not None and base.upto < before and wanted(base.upto):
            out.append((base.upto, self._segments(base).drop("seq")))
        tail = self._tail(base, before)
        for seq in sorted(int(n.split("=")[1]) for n in self._names("/data")):
            if (base.upto if base else -1) < seq < before and self._has(f"/data/seq={seq}/_SUCCESS") and wanted(seq):
                out.append((seq, tail.where(F.col("seq") == seq).drop("seq")))
        return out

    def abandon(self, epoch: int, writer: str = OWN) -> int:
        """Settle a write that failed for good as one without rows; until then it
        holds compaction back, since its repetition could still bring rows."""
        return self.replace(self.spark.createDataFrame([], self.schema), epoch, writer)

    def replace(self, rows: DataFrame, epoch: int | None = None, writer: str = OWN) -> int:
        """Write whole rows, one per key already, as the latest ones."""
        seq = self._own(epoch, writer)
        self._write(rows, seq)
        return seq


def _joined(ranges: list[list[int]]) -> list[list[int]]:
    """Ranges of whole numbers, neighbours joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scroll(df: DataFrame, id_col: str, cond: Column | None = None, batch_size: int = 10,
           offset=None) -> tuple[DataFrame, Column]:
    """One page of ``batch_size`` rows after ``offset`` in id order.

    Returns the page and the next offset (the page's last id) as a scalar
    Column; keyset paging, so page n never rescans pages 1..n-1.
    """
    src = df if cond is None else df.where(F.coalesce(cond, F.lit(False)))
    if offset is not None:
        src = src.where(F.col(id_col) > F.lit(offset))
    page = src.orderBy(id_col).limit(batch_size)
    return page, page.select(F.max(id_col)).scalar()


def near_occurrences(lookup: DataFrame, ids) -> DataFrame:
    """``(id, closest_log_id, similarity)`` for the given ids.

    ``ids`` is a list (small, a literal filter) or a DataFrame with an ``id``
    column (any size, a semi join).  Unknown ids give no rows.
    """
    cols = ["id", "closest_log_id", "similarity"]
    if isinstance(ids, DataFrame):
        return lookup.join(ids.select("id"), "id", "left_semi").select(*cols)
    return lookup.where(F.col("id").isin(list(ids))).select(*cols)


def occurrences(lookup: DataFrame) -> DataFrame:
    """how many logs each representative stands for (an aggregate, never a list)."""
    return lookup.groupBy("closest_log_id").agg(F.count(F.lit(1)).alias("occurrences"))


POINT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("signature", T.ArrayType(T.LongType())),
    T.StructField("band_keys", T.ArrayType(T.StringType())),
    T.StructField("text_payload", T.StringType()),
    T.StructField("pod_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("sim_sync", T.BooleanType()),
    T.StructField("insert_ts", T.TimestampType()),
])

LOOKUP_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("closest_log_id", T.StringType()),
    T.StructField("similarity", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("location", T.StringType()),
])


def point_store(spark: SparkSession, root: str) -> TableStore:
    return TableStore(spark, root + "/points", POINT_SCHEMA, "id", "last_wins", ["insert_ts"])


def lookup_store(spark: SparkSession, root: str) -> TableStore:
    return TableStore(spark, root + "/lookup", LOOKUP_SCHEMA, "id", "first_wins", ["timestamp", "closest_log_id"])
