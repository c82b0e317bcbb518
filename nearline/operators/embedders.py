"""Pluggable embedders (C13) and the functions they give to SQL (K8).

An embedder turns texts into vectors of whole numbers with band keys, all as
Columns.  The store, the ingest gate and the searches take any embedder; they
use nothing but this protocol:

* ``embed(text)``: Column of the vector, ``array<bigint>``;
* ``band_keys(vector)``: Column of the band keys, ``array<string>``;
* ``embeds(rows, text_col)``: both, added to a DataFrame;
* ``compare(a, b)``: Column of the score of two vectors;
* ``size``: the length of a vector; ``distance``: how ``compare`` scores.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing as H
from ..functions.text import normalise
from . import minhash as M
from . import vectors as V

DISTANCES = ("cosine", "euclidean", "dot", "jaccard")


class Embedder(ABC):
    def __init__(self, size: int, distance: str):
        if size < 1:
            raise ValueError(f"size from 1, not {size}")
        if distance not in DISTANCES:
            raise ValueError(f"distance is one of {DISTANCES}, not {distance!r}")
        self.size, self.distance = size, distance

    @abstractmethod
    def embed(self, text: Column) -> Column:
        """The vector of a text; null counts as an empty text."""

    @abstractmethod
    def band_keys(self, vector: Column) -> Column:
        """Keys that similar vectors are likely to share."""

    def embeds(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """``rows`` with ``signature`` and ``band_keys``: row by row, no shuffle."""
        return rows.withColumn("signature", self.embed(F.col(text_col))).withColumn("band_keys", self.band_keys(F.col("signature")))

    def compare(self, a: Column, b: Column) -> Column:
        return M.signature_similarity(a, b) if self.distance == "jaccard" else V.score(self.distance, a, b)


class MinHashEmbedder(Embedder):
    """MinHash signatures of character n-grams, with LSH bands."""

    def __init__(self, params: M.MinHashParams = M.MinHashParams(), distance: str = "cosine"):
        super().__init__(params.num_hashes, distance)
        if params.hash != "md5":
            raise ValueError("an embedder hashes grams with md5; signatures() takes other hashes")
        self.params = params

    def embed(self, text: Column) -> Column:
        return M.text_signature(self.params.norm(text), self.params)

    def band_keys(self, vector: Column) -> Column:
        return M.band_keys(vector, self.params)

    def embeds(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        return M.embed_rows(rows, text_col, self.params).drop("shingle_count")        # the normalised text staged as a column


class WordCountEmbedder(Embedder):
    """Counts of words hashed into ``size`` places; bands are the sign bits of
    random projections of the counts less their mean."""

    def __init__(self, size: int = 256, bands: int = 16, bits: int = 6, seed: int = 1, distance: str = "cosine", profile: str = "full"):
        super().__init__(size, distance)
        if bands < 1 or bits < 1:
            raise ValueError("bands and bits from 1")
        self.bands, self.bits, self.seed, self.profile = bands, bits, seed, profile

    def embed(self, text: Column) -> Column:
        words = F.regexp_extract_all(normalise(F.coalesce(text, F.lit("")), self.profile), F.lit(r"([^\s]+)"), 1)
        places = F.transform(words, lambda w: F.pmod(F.xxhash64(F.lit(self.seed), w), F.lit(self.size)))
        size = self.size

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def counted(found: pd.Series) -> pd.Series:
            return found.map(lambda x: np.bincount(np.asarray(x if x is not None else [], np.int64), minlength=size))

        return counted(places)

    def planes(self) -> np.ndarray:
        """Random signs, from a hash of seed, band and place."""
        raw = b"".join(hashlib.sha256(f"{self.seed}:{k}".encode()).digest() for k in range(-(-self.bands * self.bits * self.size // 256)))
        return np.unpackbits(np.frombuffer(raw, np.uint8))[:self.bands * self.bits * self.size].reshape(-1, self.size) * 2.0 - 1

    def band_keys(self, vector: Column) -> Column:
        planes, bands, bits = self.planes(), self.bands, self.bits

        @F.pandas_udf(T.ArrayType(T.StringType()))
        def keys(found: pd.Series) -> pd.Series:
            if not len(found):
                return pd.Series([], dtype=object)
            m = np.stack(found.to_list()).astype(np.float64)
            signs = ((m - m.mean(axis=1, keepdims=True)) @ planes.T >= 0).reshape(len(m), bands, bits)
            return pd.Series([[f"wc:{b}:" + "".join("1" if s else "0" for s in row) for b, row in enumerate(r)] for r in signs])

        return keys(vector)


@F.udtf(returnType="gram string, place int", useArrow=True)
class WordShingles:
    """Table function: the runs of ``n`` words of a text, or of each of an array of
    texts, with their places; ``distinct``: each run once, at its first place."""

    def eval(self, text, n: int, distinct: bool = False):
        first = {}
        for t in [text] if text is None or isinstance(text, str) else text:
            words = (t or "").split()
            grams = list(map(" ".join, zip(*(words[k:] for k in range(n))))) if n > 0 else [""] * (len(words) - n + 1)
            if distinct:
                for i, gram in enumerate(grams):
                    first.setdefault(gram, i)
            else:
                yield from zip(grams, range(len(grams)))
        yield from first.items()


def register_functions(spark: SparkSession, embedder: Embedder, prefix: str = "text") -> list[str]:
    """K8: the embedder as SQL functions of the session.

    ``{prefix}_grams(text)`` (of a normalised text) makes a gram set and
    ``{prefix}_signature(grams)`` its vector, both on Arrow batches, where a set
    goes from one to the other inside the task's Python side;
    ``{prefix}_shingles(text, n[, distinct])`` is a table function;
    ``{prefix}_compare(a, b)`` is a SQL function in whose place Catalyst puts its expression.
    """
    if not isinstance(embedder, MinHashEmbedder) or embedder.distance == "euclidean":
        raise ValueError("SQL functions are made for a MinHashEmbedder that compares by cosine, dot or jaccard")
    p = embedder.params
    spark.udf.register(f"{prefix}_signature", H.minhash_udf(p.num_hashes, p.seed))
    spark.udf.register(f"{prefix}_grams", H.gram_set_udf(p.shingle_size, p.hash, max(0, p.stop_short_lines)))
    spark.udtf.register(f"{prefix}_shingles", WordShingles)
    said = {
        f"{prefix}_compare(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE":
            "aggregate(zip_with(a, b, (x, y) -> CASE WHEN x = y THEN 1 ELSE 0 END), 0, (s, v) -> s + v) / size(a)"
            if embedder.distance == "jaccard" else
            "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)" + (
                " / (sqrt(aggregate(a, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)))"
                if embedder.distance == "cosine" else ""),
    }
    for head, body in said.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [f"{prefix}_signature", f"{prefix}_shingles", f"{prefix}_grams", f"{prefix}_compare"]
