"""MinHash embedding queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lsh
from ..operators import minhash as M
from ..session import cut_lineage
from ..session import spread
from ..sources.tables import table
from .registry import register

P = M.MinHashParams(shingle_size=5, num_hashes=16, bands=8, seed=42, profile="basic")
# Reference-identical hashing (blake2b) with its usual 128 / 32 setting.
P_COMPAT = M.MinHashParams(shingle_size=5, num_hashes=128, bands=32, seed=123, profile="full", hash="blake2b")


def _sig_sql() -> str:
    return M.signature_sql("documents", "doc_id", "text", P)


@register("shingle_count", "C2 C3 G2", lambda: f"SELECT doc_id, shingle_count FROM ({_sig_sql()})")
def q_shingle_count(spark, sf):
    return M.signatures(spread(table(spark, sf, "documents"), "doc_id"), "doc_id", "text", P).select("doc_id", "shingle_count")


@register("minhash_signature", "C4 C5 C7 C8 G1",
          lambda: f"SELECT doc_id, array_to_string(signature, ',') AS signature FROM ({_sig_sql()})")
def q_minhash_signature(spark, sf):
    sig = M.signatures(spread(table(spark, sf, "documents"), "doc_id"), "doc_id", "text", P)
    return sig.select("doc_id", F.array_join("signature", ",").alias("signature"))


@register("band_keys", "C6", lambda: M.band_rows_sql(f"SELECT * FROM ({_sig_sql()})", "doc_id", P)
          .replace("SELECT doc_id, b AS band,", "SELECT doc_id, b::INTEGER AS band,"))
def q_band_keys(spark, sf):
    sig = M.signatures(spread(table(spark, sf, "documents"), "doc_id"), "doc_id", "text", P)
    # Never empty; a plain explode would compute all keys a second time, before the shuffle, to ask for that.
    return sig.select("doc_id", F.posexplode_outer("band_keys").alias("band", "band_key"))


def _pair_sql() -> str:
    n = P.num_hashes
    bands = M.band_rows_sql("SELECT * FROM sig", "doc_id", P)
    eq = f"list_sum(list_transform(range(1, {n} + 1), lambda i: (a.signature[i] = b.signature[i])::INTEGER))"
    dotp = "list_reduce(list_transform(range(1, len(a.signature) + 1), lambda i: a.signature[i]::DOUBLE * b.signature[i]::DOUBLE), lambda x, y: x + y, 0.0)"
    na = "sqrt(list_reduce(list_transform(a.signature, lambda x: x::DOUBLE * x::DOUBLE), lambda x, y: x + y, 0.0))"
    nb = "sqrt(list_reduce(list_transform(b.signature, lambda x: x::DOUBLE * x::DOUBLE), lambda x, y: x + y, 0.0))"
    return f"""WITH sig AS ({_sig_sql()}),
bands AS ({bands}),
bk AS (SELECT doc_id, list(band_key) AS keys FROM bands GROUP BY doc_id),
both_ AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band_key = y.band_key AND x.doc_id <> y.doc_id),
rated AS (SELECT z.a, z.b, {eq} / {n} AS est FROM both_ z JOIN sig a ON a.doc_id = z.a JOIN sig b ON b.doc_id = z.b),
edges AS (SELECT a AS doc_id, b AS rep, est FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY est DESC, b) AS rn FROM rated) WHERE rn = 1)
SELECT e.doc_id, e.rep, round(est, 6) AS est_jaccard,
  round(CASE WHEN {na} * {nb} = 0 THEN 0.0 ELSE {dotp} / ({na} * {nb}) END, 6) AS cosine,
  len(list_intersect(ka.keys, kb.keys))::INTEGER AS band_overlap
FROM edges e JOIN sig a ON a.doc_id = e.doc_id JOIN sig b ON b.doc_id = e.rep
JOIN bk ka ON ka.doc_id = e.doc_id JOIN bk kb ON kb.doc_id = e.rep"""


@register("signature_similarity", "C9 C10 C12 H6 D8 F3", _pair_sql)
def q_signature_similarity(spark, sf):
    from ..operators.vectors import cosine
    from ..sources.band_index import band_hashes, signature_key
    from ..streaming.neighbours import nearest_edges
    sig = cut_lineage(M.signatures(spread(table(spark, sf, "documents"), "doc_id"), "doc_id", "text", P), "signatures")
    # The most similar of all documents that share a band (ids as text of equal length, so ties go to the smaller).
    members = sig.select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("id"), signature_key(F.col("signature")).alias("key"), "signature",
                         band_hashes(F.col("band_keys")).alias("bands"))
    edges = nearest_edges(members, "jaccard").select(F.col("src").cast("long").alias("doc_id"), F.col("dst").cast("long").alias("rep"))
    a = sig.select("doc_id", F.col("signature").alias("sa"), F.col("band_keys").alias("ka"))
    b = sig.select(F.col("doc_id").alias("rep"), F.col("signature").alias("sb"), F.col("band_keys").alias("kb"))
    j = lsh.salted_join(edges.join(a, "doc_id"), b, ["rep"], "inner", salt_by=["doc_id"])
    return j.select("doc_id", "rep",
                    F.round(M.signature_similarity(F.col("sa"), F.col("sb")), 6).alias("est_jaccard"),
                    F.round(cosine(F.col("sa"), F.col("sb")), 6).alias("cosine"),
                    M.band_overlap(F.col("ka"), F.col("kb")).alias("band_overlap"))


@register("minhash_blake2b", "C3 C13 K8", None,
          note="reference-identical blake2b hashing through an Arrow UDF; DuckDB has no blake2b, "
               "pytest compares it with a plain-Python MinHash on sample texts")
def q_minhash_blake2b(spark, sf):
    sig = M.signatures(spread(table(spark, sf, "documents"), "doc_id"), "doc_id", "text", P_COMPAT)
    return sig.select("doc_id", "shingle_count", F.array_join("signature", ",").alias("signature"),
                      F.array_join("band_keys", " ").alias("band_keys"))


P_SQL = M.MinHashParams(shingle_size=5, num_hashes=16, bands=8, seed=42, profile="basic", normalize=False, lowercase=False, collapse_whitespace=False)


def _sql_functions_sql() -> str:
    eq = f"list_sum(list_transform(range(1, {P_SQL.num_hashes} + 1), lambda i: (a.signature[i] = b.signature[i])::INTEGER)) / {P_SQL.num_hashes}"
    return f"""WITH sig AS ({M.signature_sql("documents", "doc_id", "text", P_SQL)}),
w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, count(DISTINCT array_to_string(w[k:k + 2], ' ')) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w) GROUP BY doc_id)
SELECT a.doc_id, b.doc_id AS next_id, round({eq}, 6) AS similarity, coalesce(n, 0) AS word_shingles
FROM sig a JOIN sig b ON b.doc_id = a.doc_id + 1 LEFT JOIN s ON s.doc_id = a.doc_id"""


@register("sql_functions", "C13 K8 C2", _sql_functions_sql,
          note="SQL text only: registered embedder functions and a table function")
def q_sql_functions(spark, sf):
    from ..operators.embedders import MinHashEmbedder, register_functions
    register_functions(spark, MinHashEmbedder(P_SQL, "jaccard"), "doc")
    docs = spread(table(spark, sf, "documents"), "doc_id")
    # Written: both sides of the join read the signatures, each made once.
    sig = cut_lineage(spark.sql("SELECT doc_id, doc_signature(doc_grams(text)) AS signature FROM {docs}", docs=docs), "sql_signatures")
    # The texts of an id meet, so their runs are told apart where they are made and none is shuffled.
    return spark.sql("""
        WITH t AS (SELECT doc_id, collect_set(text) AS texts FROM {docs} GROUP BY doc_id),
             s AS (SELECT doc_id, count(gram) AS n FROM t, LATERAL doc_shingles(texts, 3, true) GROUP BY doc_id)
        SELECT a.doc_id, b.doc_id AS next_id, round(doc_compare(a.signature, b.signature), 6) AS similarity, coalesce(n, 0) AS word_shingles
        FROM {sig} a JOIN {sig} b ON b.doc_id = a.doc_id + 1 LEFT JOIN s ON s.doc_id = a.doc_id""", docs=docs, sig=sig)
