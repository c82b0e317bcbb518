"""Near-duplicate queries over the whole ``documents`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lsh
from ..operators import minhash as M
from ..operators import setjoin
from ..session import spread
from ..sources.tables import table
from .registry import register

# Flagship parameters: 5-grams, 64 hashes in 16 bands of 4 rows, basic profile.
FLAGSHIP = M.MinHashParams(shingle_size=5, num_hashes=64, bands=16, seed=42, profile="basic")
THRESHOLD = 0.8


def _jaccard_sql(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return (f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 "
            f"WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 "
            f"ELSE {inter} / (len({a}) + len({b}) - {inter}) END")


def _verified_sql(p: M.MinHashParams) -> str:
    """CTE list up to ``nn(doc_id, rep, jaccard)``: by definition, every two that share a band."""
    g = M.grams_sql("documents", "doc_id", "text", p)
    sig = M.signature_sql("documents", "doc_id", "text", p)
    bands = M.band_rows_sql("SELECT * FROM sig", "doc_id", p)
    return f"""
g AS ({g}),
sig AS ({sig}),
bands AS ({bands}),
edges AS (SELECT DISTINCT x.doc_id, y.doc_id AS rep FROM bands x JOIN bands y ON x.band_key = y.band_key AND x.doc_id <> y.doc_id),
sets AS (SELECT d.doc_id, coalesce(x.grams, []::BIGINT[]) AS grams FROM documents d
         LEFT JOIN (SELECT doc_id, list(DISTINCT gram_hash) AS grams FROM g GROUP BY doc_id) x USING (doc_id)),
ver AS (SELECT e.doc_id, e.rep, {_jaccard_sql('a.grams', 'b.grams')} AS jaccard
        FROM edges e JOIN sets a ON a.doc_id = e.doc_id JOIN sets b ON b.doc_id = e.rep),
nn AS (SELECT doc_id, rep, jaccard FROM (
         SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, rep) AS rn
         FROM ver WHERE jaccard >= {THRESHOLD}) WHERE rn = 1)"""


def near_dup_clusters_sql(p: M.MinHashParams = FLAGSHIP) -> str:
    return f"""WITH RECURSIVE {_verified_sql(p)},
fwd AS (SELECT n.* FROM nn n LEFT JOIN nn m ON m.doc_id = n.rep AND m.rep = n.doc_id WHERE m.doc_id IS NULL OR n.rep < n.doc_id),
walk AS (
  SELECT d.doc_id, d.doc_id AS root, 1.0::DOUBLE AS similarity FROM documents d
  WHERE d.doc_id NOT IN (SELECT doc_id FROM fwd)
  UNION ALL
  SELECT f.doc_id, w.root, least(w.similarity, f.jaccard) FROM fwd f JOIN walk w ON f.rep = w.doc_id)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS cluster_id, round(similarity, 6) AS similarity FROM walk"""


@register("near_dup_clusters", "B18 C2 C3 C5 C6 C7 D8 F3 C11 F1 G1 H7 I6", near_dup_clusters_sql,
          note="flagship: every document with its near-duplicate cluster root")
def q_near_dup_clusters(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return lsh.near_dup_clusters(docs, "doc_id", "text", FLAGSHIP, THRESHOLD)


def near_dup_pairs_sql(p: M.MinHashParams = FLAGSHIP) -> str:
    return f"""WITH {_verified_sql(p)}
SELECT doc_id, rep, round(jaccard, 6) AS jaccard FROM nn"""


@register("near_dup_pairs", "D8 F3 C11 H6", near_dup_pairs_sql,
          note="best verified link of each document")
def q_near_dup_pairs(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return lsh.near_dup_pairs(docs, "doc_id", "text", FLAGSHIP, THRESHOLD)


# The exact join: five-word shingles, from 80 %.
WORDS, PERCENT = 5, 80


def _word_sets_sql() -> str:
    """CTE list up to ``near(a, b, n_common, n_union)``: a plain self-join of the shingles of distinct sets."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^ \t\n\x0B\f\r]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {WORDS - 1}], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, least(len(w), 1) + 1))) AS k FROM w)),
k AS (SELECT w.doc_id, coalesce(md5(string_agg(sh, chr(10) ORDER BY sh)), 'empty ' || w.doc_id) AS k, count(sh) AS size FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
c AS (SELECT doc_id, size, min(doc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS class_rows FROM k),
r AS (SELECT s.doc_id, s.sh, c.size FROM s JOIN c ON c.doc_id = s.doc_id AND c.class_id = c.doc_id),
near AS (SELECT a, b, n_common, sa + sb - n_common AS n_union
         FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.size) AS sa, any_value(y.size) AS sb, count(*) AS n_common FROM r x JOIN r y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL)
         WHERE 100 * n_common >= {PERCENT} * (sa + sb - n_common))"""


def _word_sets(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", setjoin.word_shingles(F.col("text"), WORDS).alias("shingles"))


@register("set_similarity_pairs", "D8 C11 F3", lambda: f"WITH {_word_sets_sql()}\nSELECT a, b, n_common, n_union FROM near",
          note="all pairs of distinct five-word shingle sets from a Jaccard of 0.8, exact")
def q_set_similarity_pairs(spark, sf):
    return setjoin.similar_pairs(_word_sets(spark, sf), "doc_id", "shingles", PERCENT)


@register("set_similarity_links", "D8 C11 G2", lambda: f"""WITH {_word_sets_sql()},
o AS (SELECT n.a AS class_id, c.class_rows AS n FROM near n JOIN c ON c.doc_id = n.b UNION ALL SELECT n.b, c.class_rows FROM near n JOIN c ON c.doc_id = n.a)
SELECT c.doc_id, c.class_id, (c.class_rows - 1 + coalesce(t.n, 0))::BIGINT AS n_links
FROM c LEFT JOIN (SELECT class_id, sum(n) AS n FROM o GROUP BY class_id) t USING (class_id)""",
          note="every document with its class of equal sets and its number of similar documents, exact")
def q_set_similarity_links(spark, sf):
    return setjoin.similar_counts(_word_sets(spark, sf), "doc_id", "shingles", PERCENT)
