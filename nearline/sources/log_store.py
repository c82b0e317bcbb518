"""One object over the point store and the lookup table.

Everything is a DataFrame operation on the two log-structured tables; the
object only holds their names and the embedding settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import filters as FL
from ..operators.vectors import search_blocks
from ..session import cut_lineage
from . import store as S
from .band_index import signature_key


class LogStore:
    """Insert, search, scroll, count near occurrences, sync, clear, reset."""

    def __init__(self, spark: SparkSession, root: str, config=None):
        from ..streaming.ingest import GateConfig
        self.spark, self.config = spark, config or GateConfig()
        self.embedder = self.config.embedder
        if self.embedder is None:
            raise ValueError("a log store embeds single texts: give it an embedder, or parameters with hash='md5'")
        self.points, self.lookup = S.point_store(spark, root), S.lookup_store(spark, root)

    def create(self) -> bool:
        """Both tables; False where both are there already."""
        made = [self.points.create_if_absent(dim=self.embedder.size, distance=self.embedder.distance), self.lookup.create_if_absent()]
        return any(made)

    def insert(self, logs: DataFrame, **kw) -> DataFrame:
        """Gate a batch of logs (K1); returns its decisions."""
        from ..streaming.ingest import ingest
        return ingest(logs, self.points, self.lookup, self.config, **kw)

    def embed_text(self, text: str) -> list[int]:
        """The signature of one text, made by the same steps as the stored ones."""
        row = self.spark.createDataFrame([(text,)], "text string")
        return [int(x) for x in self.embedder.embeds(row, "text").first()["signature"]]

    def search_text(self, text: str, k: int = 5, specs=None) -> DataFrame:
        """The ``k`` stored points most like a text, ``(id, score,
        payload columns)``; ``specs`` (filter DSL) restrict them first."""
        probe = F.array(*[F.lit(x) for x in self.embed_text(text)])
        sim = self.embedder.compare(F.col("signature"), probe)
        rows = FL.apply(self.points.current(), specs).withColumn("score", sim)
        return rows.select("id", "score", "text_payload", "pod_name", "severity", "ts").orderBy(F.desc("score"), "id").limit(k)

    def search_batch(self, texts: DataFrame, k: int = 5, filters: list | None = None) -> DataFrame:
        """The ``k`` stored points most like each text of a table, ``(qid,
        rank, id, score, payload columns)``.

        ``texts(qid, text[, filter])``: ``filter`` is the place of a filter (DSL
        specs) in ``filters``, null for none.  A filter restricts its queries'
        points before they are ranked.  Points of equal signature and filters
        are compared once, the ``k`` smallest ids of each stand for them.
        """
        points = self.points.current()
        conds = [FL.compile_specs(f, points) for f in filters or []]
        ok = F.array(*[F.coalesce(c, F.lit(False)) for c in conds]).cast("array<boolean>")
        keyed = points.select("id", "signature", signature_key(F.col("signature")).alias("key"), ok.alias("ok"))
        alike = Window.partitionBy("key", "ok", F.pmod(F.xxhash64("id"), F.lit(64)))
        few = keyed.withColumn("n", F.row_number().over(alike.orderBy("id"))).where(F.col("n") <= k).drop("n")   # a hot signature in 64 slices
        few = cut_lineage(few.withColumn("n", F.row_number().over(Window.partitionBy("key", "ok").orderBy("id"))).where(F.col("n") <= k).drop("n"), "search_points")
        place = F.col("filter").cast("int") if "filter" in texts.columns else F.lit(None).cast("int")
        asked = self.embedder.embeds(texts.select("qid", "text", place.alias("filter")), "text")
        asked = cut_lineage(asked.select("qid", "filter", "signature"), "search_texts")
        ok_at = [F.element_at("ok", i + 1) for i in range(len(conds))]
        found = search_blocks(few, "id", "signature", asked, "qid", "signature", k, self.config.metric,
                              ok_at if conds else None, "filter" if conds else None)
        payload = points.select("id", "text_payload", "pod_name", "severity", "ts")
        return found.join(payload, "id").select("qid", "rank", "id", "score", "text_payload", "pod_name", "severity", "ts")

    def scroll(self, specs=None, batch_size: int = 10, offset=None):
        rows = FL.apply(self.points.current(), specs)
        return S.scroll(rows, "id", None, batch_size, offset)

    def near_occurrences(self, ids) -> DataFrame:
        return S.near_occurrences(self.lookup.current(), ids)

    def sync(self) -> DataFrame:
        """K3: brings every point's edge to its nearest other point up to date
        and marks the points as synced; the edges that changed."""
        from ..streaming.neighbours import sync
        return sync(self.points, self.config.metric)

    def edges(self) -> DataFrame:
        """``(src, dst, sim)``: the nearest other point of every synced point."""
        from ..streaming.neighbours import edge_store
        return edge_store(self.points).current()

    def delete_conditional(self, specs) -> DataFrame:
        """Delete the points that the filter holds for; their ids."""
        from ..streaming.neighbours import forget
        gone = cut_lineage(FL.apply(self.points.current(), specs).select("id"), "deleted_ids")
        self.points.delete_keys(gone)
        forget(self.points, gone)
        return gone

    def update_payload_conditional(self, values: dict, specs=None) -> int:
        """Set payload columns of the points that the filter holds for.  Text,
        signature and id stay as they are, so neither index nor edges change."""
        fixed = {"id", "signature", "band_keys", "text_payload"} & set(values)
        if fixed:
            raise ValueError(f"{sorted(fixed)} cannot be updated")
        rows = FL.apply(self.points.current(), specs)
        return self.points.replace(rows.withColumns({k: F.lit(v) for k, v in values.items()}))

    def clear(self) -> None:
        """All rows of both tables go, their definitions stay."""
        self.points.truncate()
        self.lookup.truncate()

    def reset(self) -> None:
        """Both tables go and are made anew."""
        self.points.drop_if_present()
        self.lookup.drop_if_present()
        self.create()
