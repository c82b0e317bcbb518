"""Hash functions: gram hashes, the MinHash family, content ids.

The default gram hash is the first 32 bits of MD5, computed by the JVM
(``md5`` is a built-in, code-generated expression) and reproducible in
DuckDB for the oracle.  ``hash="blake2b"`` switches to the reference's byte
hash.  Grams, their hashes and signatures are small numpy helpers over blocks
of texts in Arrow UDFs; everything around them stays in Spark.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values of the hash family (must equal the reference's).
PRIME = 4294967311          # modulus of h_i(x) = (a_i * x + b_i) mod PRIME
MAX_HASH = (1 << 32) - 1    # start value of every signature slot
# --- end of fixed values


def gram_hash32(col: Column) -> Column:
    """Stable unsigned 32-bit hash of a string as BIGINT (md5, first 8 hex)."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def gram_hash32_sql(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


# Fixed values below: digest sizes, byte order and text forms give the same numbers as the reference's hashes.
@F.pandas_udf(T.ArrayType(T.StringType()))
def blake2b_hex8_each(chunks: pd.Series) -> pd.Series:
    """Reference-identical band digest (blake2b, 8-byte hex) of every element."""
    return chunks.map(lambda xs: [hashlib.blake2b(s.encode("utf-8"), digest_size=8).hexdigest() for s in xs])


@lru_cache(maxsize=64)
def hash_params(num_hashes: int, seed: int) -> tuple[tuple[int, int], ...]:
    """(a_i, b_i) for the MinHash family, reduced modulo PRIME.

    a_i / b_i come from a 16-byte blake2b of ``"{seed}:{i}"``: the low half
    little-endian with the lowest bit set, the high half little-endian.  The
    reduction keeps (a*x + b) mod p unchanged and lets the JVM compute it
    in 64-bit integers (see :func:`mod_affine`).
    """
    out = []
    for i in range(num_hashes):
        d = hashlib.blake2b(f"{seed}:{i}".encode("utf-8"), digest_size=16).digest()
        a = int.from_bytes(d[:8], "little") | 1
        b = int.from_bytes(d[8:], "little")
        out.append((a % PRIME, b % PRIME))
    return tuple(out)


def mod_affine(x: Column, a: int, b: int) -> Column:
    """(a*x + b) mod PRIME for 0 <= x < 2^32 without 64-bit overflow.

    x = hi*2^16 + lo, so a*x = (a*hi mod p)*2^16 + a*lo; every partial
    stays below 2^50.
    """
    hi = F.shiftright(x, 16)
    lo = x.bitwiseAND(F.lit(65535))
    t = F.shiftleft((F.lit(a) * hi) % F.lit(PRIME), 16) + F.lit(a) * lo + F.lit(b)
    return t % F.lit(PRIME)


def mod_affine_sql(x: str, a: int, b: int) -> str:
    return (f"(((({a} * ({x} >> 16)) % {PRIME}) * 65536) + {a} * ({x} & 65535) + {b}) % {PRIME}")


_BLOCK = 1 << 21   # characters or grams per numpy block; a longer row is a block of its own


def _md5_u32(gram: str) -> int:
    return int.from_bytes(hashlib.md5(gram.encode("utf-8")).digest()[:4], "big")


def _blake2b_u32(gram: str) -> int:
    """Reference-identical gram hash: little-endian, 4-byte digest."""
    return int.from_bytes(hashlib.blake2b(gram.encode("utf-8"), digest_size=4).digest(), "little")


GRAM_HASHES = {"md5": _md5_u32, "blake2b": _blake2b_u32}


def _blocks(sizes: np.ndarray):
    """Consecutive rows in blocks of about ``_BLOCK`` in all."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _BLOCK, side="right")))
        yield a, z
        a = z


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(number of each key's value, a place of each value)``."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = np.diff(keys[order]) != 0
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _ranked(keys: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """``(number of each key's value, how many there are)`` of keys below ``most``,
    by a table where it is not much longer than the keys."""
    if most > max(1 << 16, 4 * len(keys)):
        number, first = _numbered(keys)
        return number.astype(np.int32), len(first)
    seen = np.zeros(most, bool)
    seen[keys] = True
    rank = np.cumsum(seen, dtype=np.int32)
    rank -= 1
    return rank[keys], int(rank[-1]) + 1


_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]


def _md5_words(words: np.ndarray) -> np.ndarray:
    """The first 32 bits of MD5, as :func:`_md5_u32` gives them, of messages of one
    padded block each; ``words[i]`` has the i-th little-endian words of all, 0-d where equal."""
    u = np.uint32
    a, b, c, d = (np.full(words[0].shape, x, u) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += u(_MD5_SINES[i])
        by = _MD5_TURNS[turn][i % 4]
        a, d, c, b = d, c, b, b + ((f << u(by)) | (f >> u(32 - by)))
    return (a + u(0x67452301)).byteswap()


def _hash_runs(joined: str, at: np.ndarray, n: int, digest) -> np.ndarray:
    """``digest`` of the runs of ``n`` characters that begin at ``at``; MD5 of runs
    that fit one of its blocks is computed for many at once."""
    if digest is not _md5_u32 or 4 * n > 55:
        return np.array([digest(joined[k:k + n]) for k in at.tolist()], np.int64)
    raw = np.frombuffer(joined.encode("utf-8") + bytes(64), np.uint8)
    begin = np.arange(len(joined) + 1) if len(raw) == len(joined) + 64 else np.flatnonzero((raw & 0xC0) != 0x80)
    out = np.empty(len(at), np.int64)
    for k in range(0, len(at), 8192):
        first, end = begin[at[k:k + 8192]], begin[at[k:k + 8192] + n]
        size = end - first
        block = np.zeros((len(size), 64), np.uint8)
        for j in range(int(size.max())):
            block[:, j] = np.where(j < size, raw[first + j], 0)
        block[np.arange(len(size)), size] = 0x80
        block[:, 56], block[:, 57] = (size * 8) & 0xFF, (size * 8) >> 8
        out[k:k + 8192] = _md5_words(np.ascontiguousarray(block.view("<u4").T))
    return out


def ranked_block(texts: list[str], n: int, digest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(values, places, offsets)``: the distinct hashes of the runs of ``n``
    characters of all texts, ascending, and of each text the places of its own
    among them, ascending.  Each distinct run of the block is hashed once; runs
    are numbered by tables, so no table of all of them is sorted."""
    joined = "".join(texts)
    length = np.array([len(t) for t in texts], np.int64)
    count, begin = np.maximum(length - n + 1, 0), np.cumsum(length) - length
    if not count.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    char, kinds = _ranked(c := np.frombuffer(joined.encode("utf-32-le"), np.uint32), int(c.max()) + 1)
    key, most = char, kinds
    for j in range(1, n):
        if most * kinds >= 1 << 31:
            key = key.astype(np.int64)
        key, most = _ranked(key[:-1] * key.dtype.type(kinds) + char[j:], most * kinds)
    # Runs within a text only; of each number the place of one run, -1: runs over two texts.
    some = np.flatnonzero(count)
    step = np.zeros(len(key) + 1, np.int64)
    np.add.at(step, begin[some], 1)
    np.subtract.at(step, begin[some] + count[some], 1)
    at = np.flatnonzero(np.cumsum(step[:-1]))
    place = np.full(most, -1)
    place[key[at]] = at
    runs = np.flatnonzero(place >= 0)
    values, back = np.unique(_hash_runs(joined, place[runs], n, digest), return_inverse=True)
    of_run = np.zeros(most, np.int32)
    of_run[runs] = back
    rank = of_run[key]
    mark, parts = np.zeros(len(values), bool), []
    for a, k in zip(begin.tolist(), count.tolist()):
        own = rank[a:a + k]
        if 16 * k > len(values):
            mark[own] = True
            own = np.flatnonzero(mark).astype(np.int32)
            mark[own] = False
        elif k:
            own = np.sort(own)
            own = own[np.append(True, own[1:] != own[:-1])]
        parts.append(own)
    return values, np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


def gram_block(texts: list[str], n: int, digest) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)``: the distinct hashes of the runs of ``n``
    characters of each text, ascending.  Each distinct run of the block is
    hashed once."""
    values, places, offs = ranked_block(texts, n, digest)
    return values[places], offs


def _family(x: np.ndarray, params) -> np.ndarray:
    """(a*x + b) mod p below 2^32 of every value, a row each: 2^32 is -15 modulo
    p, so upper halves are folded in, twice, and nothing is divided."""
    x, out = x.astype(np.uint64), np.empty((len(x), len(params)), np.uint32)
    half = np.empty((len(params), min(len(x), 4096)), np.uint32)
    p, low, bits, by = np.uint64(PRIME), np.uint64(MAX_HASH), np.uint64(32), np.uint64(15)
    for k in range(0, len(x), 4096):
        y = x[k:k + 4096]
        for i, (a, b) in enumerate(params):
            if a > MAX_HASH:                                 # 2^32 and a rest below 15
                t = y * np.uint64(a - MAX_HASH - 1) + np.uint64(16 * PRIME + b) - y * by
            else:
                t = y * np.uint64(a)
                high = t >> bits
                high *= by
                t &= low
                t += np.uint64(16 * PRIME + b)
                t -= high
            high = t >> bits
            high *= by
            t &= low
            t += p
            t -= high
            np.minimum(t, t - p, out=t)
            np.minimum(t, low, out=half[i, :len(y)], casting="unsafe")
        out[k:k + 4096] = half[:, :len(y)].T
    return out


_TABLE = 1 << 23   # hashes of a family held at once
_LIKELY = 8        # all least values of m are below this share / m, but for one signature in 2,000 a hash


def least_block(values: np.ndarray, places: np.ndarray, offs: np.ndarray, num_hashes: int, seed: int) -> np.ndarray:
    """Signatures of sets of ``values``, a row each: a hash is computed once for
    every value.  In a long set only values with a small hash are looked at; where one hash has no
    small value there, all are.  All-max for an empty set."""
    out = np.full((len(offs) - 1, num_hashes), MAX_HASH, np.int64)
    if not len(places):
        return out
    family, ends = hash_params(num_hashes, seed), offs.tolist()
    step = max(1, _TABLE // len(values))
    for i in range(0, num_hashes, step):
        table = _family(values, family[i:i + step])
        width = table.shape[1]
        low = table.min(axis=1)[places]
        for d, (a, z) in enumerate(zip(ends[:-1], ends[1:])):
            own, cut = places[a:z], _LIKELY * (MAX_HASH + 1) // max(z - a, 1)
            if z - a > _LIKELY * width:
                few = own[low[a:z] < cut]
                if len(few) and (least := table[few].min(axis=0)).max() < cut:
                    out[d, i:i + width] = least
                    continue
            for k in range(0, z - a, 4096):
                out[d, i:i + width] = np.minimum(out[d, i:i + width], table[own[k:k + 4096]].min(axis=0))
    return out


def signature_block(flat: np.ndarray, offs: np.ndarray, num_hashes: int, seed: int) -> np.ndarray:
    """Signatures of gram-hash sets, a row each; all-max for an empty set."""
    number, first = _numbered(flat)
    return least_block(flat[first], number, offs, num_hashes, seed)


def _lists(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32), pa.int32()), pa.array(values, pa.int64()))


def _gram_blocks(texts: pa.Array, n: int, hash: str):
    """The sets of a batch of texts by blocks; null is an empty set."""
    rows = [t or "" for t in texts.to_pylist()]
    for a, z in _blocks(np.array([len(t) for t in rows], np.int64)):
        yield gram_block(rows[a:z], n, GRAM_HASHES[hash])


def _ranked_blocks(texts: pa.Array, n: int, hash: str):
    """The same as values and places among them (:func:`ranked_block`)."""
    rows = [t or "" for t in texts.to_pylist()]
    for a, z in _blocks(np.array([len(t) for t in rows], np.int64)):
        yield ranked_block(rows[a:z], n, GRAM_HASHES[hash])


def _distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct texts of a batch (null as an empty one) and the place of
    each row's among them: masked lines repeat, and equal texts are hashed once."""
    coded = texts.fill_null("").dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


@lru_cache(maxsize=64)
def gram_set_udf(n: int, hash: str, least: int = 0):
    """Arrow UDF: text -> its distinct gram hashes; none of texts below ``least`` characters."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def grams(texts: pa.Array) -> pa.Array:
        if least:
            texts = pa.compute.if_else(pa.compute.greater_equal(pa.compute.utf8_length(texts), least), texts, None)
        parts = [(f, np.diff(o)) for f, o in _gram_blocks(texts, n, hash)]
        if not parts:
            return pa.array([], pa.list_(pa.int64()))
        flat, sizes = (np.concatenate(x) for x in zip(*parts))
        return _lists(flat, np.append(0, np.cumsum(sizes)))

    return grams


@lru_cache(maxsize=64)
def text_signature_udf(n: int, hash: str, num_hashes: int, seed: int):
    """Arrow UDF: text -> (MinHash signature, number of distinct grams); the
    set itself never leaves the task's Python side."""
    kind = T.StructType([T.StructField("signature", T.ArrayType(T.LongType())), T.StructField("shingle_count", T.IntegerType())])

    @F.arrow_udf(kind)
    def signature(texts: pa.Array) -> pa.Array:
        some, place = _distinct(texts)
        sigs, sizes = [np.zeros((0, num_hashes), np.int64)], [np.zeros(0, np.int64)]
        for values, places, offs in _ranked_blocks(some, n, hash):
            sigs.append(least_block(values, places, offs, num_hashes, seed))
            sizes.append(np.diff(offs))
        m, sizes = np.concatenate(sigs), np.concatenate(sizes)
        return pa.StructArray.from_arrays([_lists(m[place].ravel(), np.arange(len(place) + 1) * num_hashes), pa.array(sizes[place], pa.int32())],
                                          names=["signature", "shingle_count"])

    return signature


def _signatures(texts: pa.Array, n: int, hash: str, num_hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and set sizes of a batch of texts."""
    sigs, sizes = [np.zeros((0, num_hashes), np.int64)], [np.zeros(0, np.int64)]
    for flat, offs in _gram_blocks(texts, n, hash):
        sigs.append(signature_block(flat, offs, num_hashes, seed))
        sizes.append(np.diff(offs))
    return np.concatenate(sigs), np.concatenate(sizes)


@lru_cache(maxsize=64)
def text_embed_udf(n: int, num_hashes: int, bands: int, seed: int):
    """Arrow UDF: text -> (MinHash signature, number of distinct grams, band keys
    ``lsh:{b}:{16 hex}``), md5 throughout."""
    kind = T.StructType([T.StructField("signature", T.ArrayType(T.LongType())), T.StructField("shingle_count", T.IntegerType()),
                         T.StructField("band_keys", T.ArrayType(T.StringType()))])
    r = num_hashes // bands

    @F.arrow_udf(kind)
    def embedded(texts: pa.Array) -> pa.Array:
        some, place = _distinct(texts)
        m, sizes = _signatures(some, n, "md5", num_hashes, seed)
        keys = pa.array([f"lsh:{b}:" + hashlib.md5(",".join(row[b * r:b * r + r]).encode()).hexdigest()[:16]
                         for row in (list(map(str, x)) for x in m.tolist()) for b in range(bands)], pa.string())
        of_row = (place.astype(np.int64)[:, None] * bands + np.arange(bands)[None, :]).ravel()
        return pa.StructArray.from_arrays([_lists(m[place].ravel(), np.arange(len(place) + 1) * num_hashes), pa.array(sizes[place], pa.int32()),
                                           pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * bands), keys.take(pa.array(of_row)))],
                                          names=["signature", "shingle_count", "band_keys"])

    return embedded


@lru_cache(maxsize=64)
def union_signature_udf(n: int, hash: str, num_hashes: int, seed: int):
    """Arrow UDF: list of texts -> (MinHash signature, number of distinct grams) of all of them together."""
    kind = T.StructType([T.StructField("signature", T.ArrayType(T.LongType())), T.StructField("shingle_count", T.IntegerType())])

    @F.arrow_udf(kind)
    def signature(lists: pa.Array) -> pa.Array:
        sigs, sizes = [np.zeros((0, num_hashes), np.int64)], [np.zeros(0, np.int64)]
        for texts in lists:
            texts = texts.values if texts.is_valid else pa.array([], pa.string())
            sets = [flat for flat, _ in _gram_blocks(texts, n, hash)]
            flat = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]))
            sigs.append(signature_block(flat, np.array([0, len(flat)]), num_hashes, seed))
            sizes.append([len(flat)])
        m = np.concatenate(sigs)
        return pa.StructArray.from_arrays([_lists(m.ravel(), np.arange(len(m) + 1) * num_hashes), pa.array(np.concatenate(sizes), pa.int32())],
                                          names=["signature", "shingle_count"])

    return signature


SKETCH_BITS = 4096


def sketch_bits(size: int) -> int:
    """Parity bits for a set: about one a gram.  Fewer tell nothing of long sets."""
    return 1 << min(max(size - 1, SKETCH_BITS // 4 - 1).bit_length(), 16)


@lru_cache(maxsize=64)
def text_sketch_udf(n: int, hash: str, num_hashes: int, seed: int):
    """Arrow UDF: text -> (signature, size, md5 of the gram set, parity bits).

    Bit k of the parity bits is the number of grams with hash k modulo their
    number (:func:`sketch_bits`), odd or even: two sets differ in at least as many
    grams as their parities differ in bits.  The halves of the longer, one XOR the
    other, are what it has with half the bits."""
    kind = T.StructType([T.StructField("signature", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType()),
                         T.StructField("set", T.BinaryType()), T.StructField("parity", T.BinaryType())])

    @F.arrow_udf(kind)
    def sketch(texts: pa.Array) -> pa.Array:
        sigs, sizes, sets, parities = [np.zeros((0, num_hashes), np.int64)], [np.zeros(0, np.int64)], [], []
        for values, places, offs in _ranked_blocks(texts, n, hash):
            sigs.append(least_block(values, places, offs, num_hashes, seed))
            sizes.append(np.diff(offs))
            flat = values.astype(np.uint32)[places]
            for a, z in zip(offs[:-1].tolist(), offs[1:].tolist()):
                sets.append(hashlib.md5(flat[a:z]).digest())
                bits = sketch_bits(z - a)
                parities.append(np.packbits((np.bincount(flat[a:z] & np.uint32(bits - 1), minlength=bits) & 1).astype(bool)).tobytes())
        m = np.concatenate(sigs)
        return pa.StructArray.from_arrays([_lists(m.ravel(), np.arange(len(m) + 1) * num_hashes), pa.array(np.concatenate(sizes), pa.int32()),
                                           pa.array(sets, pa.binary()), pa.array(parities, pa.binary())], names=["signature", "size", "set", "parity"])

    return sketch


@lru_cache(maxsize=64)
def packed_set_udf(n: int, hash: str):
    """Arrow UDF: text -> (md5 of the gram set, its hashes as packed 32-bit numbers)."""
    @F.arrow_udf(T.StructType([T.StructField("set", T.BinaryType()), T.StructField("grams", T.BinaryType())]))
    def packed(texts: pa.Array) -> pa.Array:
        parts = [flat[a:z].astype(np.uint32).tobytes() for flat, offs in _gram_blocks(texts, n, hash) for a, z in zip(offs[:-1].tolist(), offs[1:].tolist())]
        return pa.StructArray.from_arrays([pa.array([hashlib.md5(x).digest() for x in parts], pa.binary()), pa.array(parts, pa.binary())], names=["set", "grams"])

    return packed


@lru_cache(maxsize=64)
def minhash_udf(num_hashes: int, seed: int):
    """Arrow UDF: gram-hash set -> MinHash signature (same values as the JVM path)."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def minhash(sets: pa.Array) -> pa.Array:
        sigs = [np.zeros((0, num_hashes), np.int64)]
        sizes = sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = sets.flatten().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes))
        for a, z in _blocks(sizes):
            sigs.append(signature_block(flat[ends[a]:ends[z]], ends[a:z + 1] - ends[a], num_hashes, seed))
        m = np.concatenate(sigs)
        return _lists(m.ravel(), np.arange(len(m) + 1) * num_hashes)

    return minhash


def md5_hex(col: Column) -> Column:
    """Content hash as 32 hex digits."""
    return F.md5(col)


def md5_mod(col: Column, n: int) -> Column:
    """Integer form of the content hash, reduced modulo ``n``.

    The full 128-bit value does not fit any Spark numeric type; the low 60
    bits (15 hex digits) are exact in BIGINT and are what we reduce.
    """
    return F.pmod(F.conv(F.substring(F.md5(col), 18, 15), 16, 10).cast("bigint"), F.lit(n))


def content_id(text: Column, metadata_json: Column) -> Column:
    """id = md5("{text}-{metadata}") with canonical JSON metadata."""
    return F.md5(F.concat_ws("-", text, metadata_json))
