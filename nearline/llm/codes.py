"""Vector code compression (operator 13): product codes learnt on integer vectors.

Every component x becomes the integer floor(256 * x); a vector is cut into
``parts`` equal consecutive parts, and each part is replaced by the number of
its nearest entry in the part's codebook (squared Euclidean distance, ties to
the lower number).  Codebooks start as the parts of the ``entries`` smallest
ids and move to the componentwise floor of their parts' mean, ``rounds`` times.

Method: per-dimension value dictionaries.  Once, every block of vectors (one
Arrow batch, at most ``BLOCK`` components) is written as its distinct integers
per dimension and, per vector, their places in these dictionaries.  A pass
tabulates, per dimension, the squared differences of every distinct integer to
all entries; the distances of a part are then gathers from these tables by the
dictionary codes, and adds.  Tables are bounded by the block, whatever the
values, and equal values cost one multiplication a block.

A pass shuffles only sums: every task adds up its counts and component sums
per entry (``entries * (dim + parts)`` numbers), Spark adds the tasks' rows, and
the codebooks, which have that fixed size too, go through the driver.

Defined results:

* a vector that is null, empty, or holds a null or non-finite component is dropped;
* kept vectors must have one length, a multiple of ``parts``, else ``ValueError``;
* components whose integer is beyond 2**26 in size raise ``ArithmeticError``
  (an error could leave 64 bits);
* null ids come last among the ids, repeated ids are ordered by their vectors,
  and repeated rows stay rows of their own, first entries included;
* fewer than ``entries`` kept rows give so many entries; no rows give none;
* other columns are not read, but for the label column.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import salted_join
from ..session import cut_lineage
from .common import pack, squeeze, unpack, unsqueeze

BLOCK = 1 << 21          # components of a block
MOST = 1 << 26           # largest integer taken


@dataclass(frozen=True)
class CodeParams:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: float = 256.0

    def __post_init__(self):
        if self.parts < 1 or not 1 <= self.entries <= 256 or self.rounds < 0:
            raise ValueError("parts from 1, entries from 1 to 256 (two hex digits), rounds from 0")


def finite(vec: Column) -> Column:
    """True where a vector has components and all of them are finite numbers."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & ok, F.lit(False))


def _integers(lists, scale: float) -> np.ndarray:
    """The matrix of a block's integers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    values = np.floor(flat * scale)
    if len(values) and np.abs(values).max() > MOST:
        raise ArithmeticError(f"a component's integer is beyond {MOST}")
    return values.astype(np.int64).reshape(len(lists), -1)


def blocks(points: DataFrame, id_col: str, vec_col: str, label_col: str, params: CodeParams, dim: int) -> DataFrame:
    """``(ids, labels, values, sizes, codes)``: one row a block, with the distinct
    integers of every dimension behind one another and the codes by dimension."""
    src = points.where(finite(F.col(vec_col))).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    id_type, label_type = src.schema["id"].dataType, src.schema["label"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)),
                           T.StructField("values", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
                           T.StructField("codes", T.BinaryType())])
    rows = max(1, BLOCK // dim)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                b = batch.slice(a, rows)
                lists = b.column("v")
                if (np.diff(lists.offsets.to_numpy()) != dim).any():
                    raise ValueError("the vectors have several lengths")
                m = _integers(lists, params.scale)
                found = [np.unique(m[:, d], return_inverse=True) for d in range(dim)]
                sizes = np.array([len(v) for v, _ in found], np.int64)
                small = np.uint8 if sizes.max() <= 256 else np.uint16 if sizes.max() <= 65536 else np.uint32
                codes = np.stack([c for _, c in found]).astype(small)
                one = pa.array([0, len(b)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one, b.column("id")), pa.ListArray.from_arrays(one, b.column("label")),
                     pa.array([squeeze(np.concatenate([v for v, _ in found]))], pa.binary()),
                     pa.array([pack(sizes)], pa.binary()), pa.array([squeeze(codes)], pa.binary())],
                    names=["ids", "labels", "values", "sizes", "codes"])

    return src.mapInArrow(run, schema)


def _opened(values: bytes, sizes: bytes, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """``(dictionary per dimension, codes by dimension and row)`` of a block."""
    size = unpack(sizes, np.int64)
    kind = np.uint8 if size.max() <= 256 else np.uint16 if size.max() <= 65536 else np.uint32
    return np.split(unsqueeze(values, np.int64), np.cumsum(size)[:-1]), unsqueeze(codes, kind).reshape(len(size), -1)


def nearest(dictionary: list[np.ndarray], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` per part and row.  ``books[part, entry, place]``."""
    parts, entries, width = books.shape
    n = codes.shape[1]
    best, cost = np.empty((parts, n), np.uint8), np.empty((parts, n), np.int64)
    for p in range(parts):
        tables = [(dictionary[p * width + j][:, None] - books[p, :, j][None, :]) ** 2 for j in range(width)]
        for a in range(0, n, 4096):
            total = tables[0][codes[p * width, a:a + 4096]]
            for j in range(1, width):
                total += tables[j][codes[p * width + j, a:a + 4096]]
            k = total.argmin(axis=1)                             # the first least: the lower number
            best[p, a:a + 4096], cost[p, a:a + 4096] = k, total[np.arange(len(k)), k]
    return best, cost


def _sums(books: np.ndarray):
    """A task's counts and component sums per entry, as ``(slot, amount)`` rows:
    the counts of all parts' entries first, then the sums by dimension."""
    parts, entries, width = books.shape

    def run(batches):
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, width, entries), np.int64)
        for batch in batches:
            for values, sizes, codes in zip(*(batch.column(c).to_pylist() for c in ("values", "sizes", "codes"))):
                dictionary, code = _opened(values, sizes, codes)
                best, _ = nearest(dictionary, code, books)
                for p in range(parts):
                    count[p] += np.bincount(best[p], minlength=entries)
                    for j in range(width):
                        # occurrences of (entry, value), times the value: whole numbers throughout
                        d = dictionary[p * width + j]
                        seen = np.bincount(best[p].astype(np.int64) * len(d) + code[p * width + j], minlength=entries * len(d))
                        sums[p, j] += seen.reshape(entries, len(d)) @ d
        amount = np.concatenate([count.ravel(), sums.ravel()])
        used = np.flatnonzero(amount)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(amount[used], pa.int64())], names=["slot", "amount"])

    return run


def first_books(points: DataFrame, id_col: str, vec_col: str, params: CodeParams) -> np.ndarray | None:
    """The codebooks of the smallest ids (at most ``entries`` rows reach the driver); None: no rows."""
    kept = points.where(finite(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(params.entries).collect()
    if not rows:
        return None
    if len({len(r["v"]) for r in rows}) > 1 or len(rows[0]["v"]) % params.parts:
        raise ValueError(f"vectors must have one length, a multiple of {params.parts}")
    m = _integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), params.scale)
    return m.reshape(len(rows), params.parts, -1).transpose(1, 0, 2).copy()


def learn(coded: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Assign and move, ``rounds`` times; an entry without parts stays."""
    parts, entries, width = books.shape
    for _ in range(rounds):
        total = coded.mapInArrow(_sums(books), "slot long, amount long").groupBy("slot").agg(F.sum("amount").alias("amount"))
        amount = np.zeros(parts * entries * (width + 1), np.int64)
        for r in total.collect():                                # as many numbers as the codebooks have
            amount[r["slot"]] = r["amount"]
        count = amount[:parts * entries].reshape(parts, entries)
        sums = amount[parts * entries:].reshape(parts, width, entries).transpose(0, 2, 1)
        used = count > 0
        books = np.where(used[:, :, None], sums // np.where(used, count, 1)[:, :, None], books)
    return books


def assign(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``(id, label, code, error)`` of every vector: the part's entries as two hex
    digits each, and the squared distances added up."""
    schema = T.StructType([T.StructField("id", coded.schema["ids"].dataType.elementType),
                           T.StructField("label", coded.schema["labels"].dataType.elementType),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1)
                best, cost = nearest(*_opened(*(b.column(c)[0].as_py() for c in ("values", "sizes", "codes"))), books)
                text = np.ascontiguousarray(best.T).tobytes().hex()
                size = 2 * len(books)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids").flatten(), b.column("labels").flatten(),
                     pa.array([text[i:i + size] for i in range(0, len(text), size)], pa.string()),
                     pa.array(cost.sum(axis=0), pa.int64())], names=["id", "label", "code", "error"])

    return coded.mapInArrow(run, schema)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(points: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             params: CodeParams = CodeParams()) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, code, error, label_error)`` of every kept vector, and the
    codebooks ``[part, entry, place]``.  ``label_error``: the error of all
    vectors of the label, nulls together."""
    books = first_books(points, id_col, vec_col, params)
    if books is None:
        none = points.where(F.lit(False)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit("").alias("code"),
                                                 F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, np.zeros((params.parts, 0, 0), np.int64)
    coded = cut_lineage(blocks(points, id_col, vec_col, label_col, params, books.shape[0] * books.shape[2]), "vector_blocks")
    books = learn(coded, books, params.rounds)
    found = cut_lineage(assign(coded, books), "vector_codes").withColumn(
        "__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    total = found.groupBy("__label").agg(F.sum("error").alias("label_error"))
    # One label may hold any share of the rows: its rows are spread, its one total is repeated.
    out = salted_join(found, total, ["__label"], "inner", salt_by=["id", "code"])
    return out.select("id", "label", "code", "error", "label_error"), books


def decode(code: Column, books: np.ndarray, scale: float = 256.0) -> Column:
    """The approximate vector of a code: its entries' integers, moved back by the scale."""
    parts, entries, width = books.shape
    table = F.array(*[F.array(*[F.lit(float(x) / scale) for x in books[p].ravel()]) for p in range(parts)])
    entry = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*[F.slice(table[p], entry(p) * width + 1, width) for p in range(parts)])
