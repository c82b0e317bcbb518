"""Helpers shared by the operators: Arrow buffers as numpy arrays, packed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six characters that separate words in most of the contracts.
SPACE = "\\x20\\x09-\\x0D"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0]:o[-1]], o - o[0]


def byte_texts(column) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpack(b, dtype) -> np.ndarray:
    return np.frombuffer(b or b"", dtype)


_PACKER, _OPENER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()     # a task is one thread


def squeeze(a: np.ndarray) -> bytes:
    """A packed array, compressed: strings of text and small numbers travel in half the bytes."""
    return _PACKER.compress(pack(a))


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_OPENER.decompress(b), dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on unsigned 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """``(rows, bytes of text)`` of a table; two numbers reach the driver."""
    r = docs.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"])
