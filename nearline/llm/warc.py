"""WARC archives of captured pages (operator 12): write, read back, assemble.

Writing.  Every page becomes one transaction of three records: a request, the
response (or a revisit, which has no payload), and a metadata record of
``application/warc-fields``.  Request and metadata name the response in
``WARC-Concurrent-To``.  Spark's own text writer writes the files: a record is
one string, and the two line ends that close a WARC record are the writer's
line separator, so files are committed like those of any table and a lost
executor costs its tasks only.  Files are gzip streams of about ``file_bytes``
of payload; a file has no ``warcinfo`` record.

Of the pages with equal payloads of ``least_bytes`` or more, that with the
largest (id, url) is a response and the others revisit it; null ids are the
smallest, and rows that repeat the largest (id, url) are responses all.

Reading.  ``binaryFile`` brings whole files, from any store that Spark reads; a
task walks a file's stream record by record, by ``Content-Length``, so payloads
may hold anything, also text that looks like a record.  Digests and lengths of
payloads are taken from the bytes read.  WARC 1.0 and 1.1, plain or gzip, one
member or a member per record.  A last record that is cut off is kept with
``truncated`` set; other things between records raise ``ValueError``.

Assembly.  The records of a capture event are joined through their
concurrent-to identifiers, in either direction and over any number of steps
(metadata that names only the request, say): known records pass their anchor
(response, revisit or resource) on to the records one step away, a round of
joins on identifiers per step, until nothing is left or nothing is found.  Of
several anchors at the same distance the smallest identifier counts.  One
nested row per anchor leaves; requests and metadata without an anchor make a
capture of their own with a null response; repeated identifiers count once;
``warcinfo`` belongs to no capture.

Null html is an empty payload, null urls give records without a target, line
ends inside urls are percent-encoded, an empty table gives empty archives and
no captures, other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import DEFAULT_SHARE, salted_join
from ..session import cut_lineage, ensure_checkpoint_dir

ANCHORS = ("response", "revisit", "resource")
END = "\r\n"


@dataclass(frozen=True)
class WarcParams:
    least_bytes: int = 1000                  # smaller payloads are never revisits
    file_bytes: int = 32 << 20               # payload bytes of a file, about
    date: str = "1970-01-01T00:00:00Z"       # capture time of pages that have none


# ------------------------------------------------------------ writing

def _record_id(transaction: Column, kind: str) -> Column:
    h = F.md5(F.concat(transaction, F.lit(kind)))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _record(kind: Column, record_id: Column, block: Column, content_type: Column, more: list[tuple[str, Column]], date: str) -> Column:
    """One record without its closing line ends; header fields whose value is null are left out."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(date)), *more,
              ("Content-Type", content_type), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(END, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{n}: "), v) for n, v in fields]), F.lit(END * 2), block)


def _originals(pages: DataFrame, params: WarcParams) -> tuple[DataFrame, int, int]:
    """``(same, n, id, url)`` of every payload that several pages have, and
    the rows and payload bytes of the table.  Payloads are told apart by SHA-256."""
    narrow = cut_lineage(pages.select("id", "url", "same", "size"), "warc_payloads")
    rows, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    found = (narrow.where(F.col("size") >= params.least_bytes).groupBy("same")
             .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "url")).alias("top")).where("n > 1"))
    return cut_lineage(found.select("same", "n", "top"), "warc_originals"), int(rows), int(total)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  params: WarcParams = WarcParams()) -> None:
    """Write the pages' transactions as WARC files under ``path``."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    url = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), body.alias("body"), F.octet_length(body).cast("long").alias("size"),
                        F.sha1(body.cast("binary")).alias("sha1"), F.sha2(body.cast("binary"), 256).alias("same"))
    originals, n, total = _originals(rows, params)
    # A payload may belong to any share of the pages: its rows are spread over as many
    # sub-keys as it would fill partitions; at most 1 / DEFAULT_SHARE payloads are that frequent.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    hot = F.broadcast(originals.where(F.col("n") >= max(2.0, DEFAULT_SHARE * n)).select("same", F.ceil(F.col("n") * parts / max(n, 1)).cast("int").alias("__n")))
    rows = (rows.withColumn("nr", F.monotonically_increasing_id()).join(hot, "same", "left")
            .withColumn("__salt", F.coalesce(F.pmod(F.col("nr"), F.col("__n")), F.lit(0)).cast("int")).drop("__n"))
    tops = originals.join(hot, "same", "left").select(
        "same", "top", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1)).alias("__salt"))
    rows = rows.join(tops, ["same", "__salt"], "left")

    revisit = F.col("top").isNotNull() & ~F.struct("id", "url").eqNullSafe(F.struct(F.col("top.id").alias("id"), F.col("top.url").alias("url")))
    transaction = F.md5(F.concat_ws("|", F.col("id").cast("string"), "url", "sha1", F.col("nr").cast("string")))
    rows = rows.select("id", "url", "body", "size", "sha1", "top", revisit.alias("again"), transaction.alias("tx"))
    main_id, again = _record_id(F.col("tx"), "response"), F.col("again")
    target = ("WARC-Target-URI", F.col("url"))
    host, at = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(F.startswith(at, F.lit("/")), at).otherwise(F.concat(F.lit("/"), F.coalesce(at, F.lit("")))), F.lit(" HTTP/1.1" + END),
                     F.lit("Host: "), F.coalesce(host, F.lit("")), F.lit(END * 2))
    head = F.concat(F.lit(END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.col("size").cast("string"), F.lit(END * 2))
    same = lambda c: F.when(again, c)
    records = [
        _record(F.lit("request"), _record_id(F.col("tx"), "request"), asked, F.lit("application/http; msgtype=request"),
                [target, ("WARC-Concurrent-To", main_id)], params.date),
        _record(F.when(again, "revisit").otherwise("response"), main_id, F.concat(head, F.when(again, F.lit("")).otherwise(F.col("body"))),
                F.lit("application/http; msgtype=response"),
                [target, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
                 ("WARC-Profile", same(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                 ("WARC-Refers-To-Target-URI", same(F.col("top.url"))), ("WARC-Refers-To-Date", same(F.lit(params.date)))], params.date),
        _record(F.lit("metadata"), _record_id(F.col("tx"), "metadata"), F.concat(F.concat(F.lit("via: archive" + END),
                F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(END)), F.lit("")))), F.lit("application/warc-fields"),
                [target, ("WARC-Concurrent-To", main_id)], params.date)]
    per_file = max(3, int(3 * params.file_bytes / max(1, total / max(1, n))))
    (rows.select(F.explode(F.array(*records)).alias("value")).write.option("lineSep", END * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).mode("errorifexists").text(path))


# ------------------------------------------------------------ reading

RECORD = ("record_id string, kind string, target_uri string, date string, concurrent_to array<string>, content_type string, truncated boolean, "
          "payload_bytes long, payload_digest string, refers_to_uri string, fields map<string,string>, payload binary")


def walk(stream):
    """``(headers, concurrent_to, block, truncated)`` of every record of a stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head, linked, last = {}, [], None
        for line in iter(stream.readline, b""):
            if line in (b"\r\n", b"\n"):
                break
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and last:                       # a folded line goes on with the field above
                head[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            if last == "warc-concurrent-to":
                linked.append(value.strip())
            else:
                head[last] = value.strip()
        size = int(head.get("content-length", 0))
        block = stream.read(size)
        yield head, linked, block, len(block) < size


def _body(block: bytes) -> bytes:
    """What follows the HTTP header of a block."""
    at = block.find(b"\r\n\r\n")
    return block[at + 4:] if at >= 0 else b""


def _row(head: dict, linked: list, block: bytes, cut: bool, with_payload: bool) -> dict:
    kind, fields, payload = head.get("warc-type"), None, None
    digest = head.get("warc-payload-digest", "").partition(":")[2] or None
    if kind == "response" and head.get("content-type", "").startswith("application/http"):
        payload = _body(block)
    elif kind in ("response", "resource"):
        payload = block
    elif kind == "metadata" and head.get("content-type", "").startswith("application/warc-fields"):
        pairs = [x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x]
        fields = list({k.strip().lower(): v.strip() for k, _, v in pairs}.items())
    if payload is not None:
        digest = hashlib.sha1(payload).hexdigest()
    return {"record_id": head.get("warc-record-id"), "kind": kind, "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "concurrent_to": linked, "content_type": head.get("content-type"), "truncated": cut,
            "payload_bytes": None if payload is None else len(payload), "payload_digest": digest,
            "refers_to_uri": head.get("warc-refers-to-target-uri"), "fields": fields, "payload": payload if with_payload else None}


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``; ``payload_bytes`` and
    ``payload_digest`` (SHA-1) are those of the bytes read, but for revisits,
    which have the digest of their header and no length."""
    text, words = pa.string(), pa.list_(pa.string())
    schema = pa.schema([("record_id", text), ("kind", text), ("target_uri", text), ("date", text), ("concurrent_to", words), ("content_type", text),
                        ("truncated", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", text), ("refers_to_uri", text),
                        ("fields", pa.map_(text, text)), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = io.BytesIO(content.as_buffer())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                rows, held = [], 0
                for record in walk(stream):
                    rows.append(_row(*record, with_payload))
                    held += len(record[2]) if with_payload else 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


# ------------------------------------------------------------ assembly

def _anchored(records: DataFrame) -> DataFrame:
    """``(record_id, anchor)`` of the records that are no anchors themselves but tied to one."""
    ids = cut_lineage(records.where("record_id IS NOT NULL AND kind <> 'warcinfo'").groupBy("record_id").agg(
        F.max(F.col("kind").isin(*ANCHORS)).alias("is_anchor")), "warc_ids")
    links = records.select(F.col("record_id").alias("x"), F.explode("concurrent_to").alias("y")).where("x <> y")
    links = cut_lineage(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "warc_links")
    known, left = ids.where("is_anchor").select("record_id", F.col("record_id").alias("anchor")), ids.where("NOT is_anchor").select("record_id")
    found = []
    waiting = left.count()
    while waiting:
        step = salted_join(links, known.select(F.col("record_id").alias("y"), "anchor"), ["y"], "inner", salt_by=["x"])
        step = step.join(left, step["x"] == left["record_id"], "left_semi").groupBy(F.col("x").alias("record_id")).agg(F.min("anchor").alias("anchor"))
        known = cut_lineage(step, "warc_step")
        n = known.count()
        if not n:
            break
        found.append(known)
        waiting -= n
        if waiting:
            left = cut_lineage(left.join(known, "record_id", "left_anti"), "warc_left")
    out = known.limit(0) if not found else found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``target_uri``, ``date``,
    ``response`` (null for records without one), ``requests``, ``metadata``."""
    anchor_of = _anchored(records)
    other = records.where(~F.coalesce(F.col("kind"), F.lit("")).isin(*ANCHORS, "warcinfo")).dropDuplicates(["record_id"]).join(anchor_of, "record_id", "left")
    part = F.struct("record_id", "target_uri", "date", "content_type", "fields")
    grouped = other.groupBy(F.coalesce("anchor", "record_id").alias("capture_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "request", F.struct("record_id", "target_uri", "date", "content_type")))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "request", part)), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)).alias("metadata"),
        F.min("target_uri").alias("__uri"), F.min("date").alias("__date"))
    main = records.where(F.col("kind").isin(*ANCHORS)).dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("capture_id"),
        F.struct("kind", "target_uri", "date", "content_type", "truncated", "payload_bytes", "payload_digest", "refers_to_uri", "payload").alias("response"))
    return main.join(grouped, "capture_id", "full").select(
        "capture_id", F.coalesce("response.target_uri", "__uri").alias("target_uri"), F.coalesce("response.date", "__date").alias("date"),
        "response", F.coalesce("requests", F.array()).alias("requests"), F.coalesce("metadata", F.array()).alias("metadata"))


def resolve_revisits(captures: DataFrame, id_field: str = "page-id") -> DataFrame:
    """``(id, payload_bytes, payload_digest, record_type, refers_to)`` of every
    capture with a response: revisits take length and id from the response with
    their digest and the target they refer to (the largest id of several)."""
    ids = F.filter(F.transform("metadata", lambda m: F.element_at(m["fields"], F.lit(id_field))), lambda x: x.isNotNull())
    rows = captures.where("response IS NOT NULL").select(
        "capture_id", F.try_element_at(ids, F.lit(1)).alias("id"), F.col("response.kind").alias("record_type"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.coalesce("response.target_uri", F.lit("")).alias("uri"),
        F.coalesce("response.refers_to_uri", F.lit("")).alias("refers_to_uri"))
    rows = cut_lineage(rows, "warc_captures")
    again = F.col("record_type") == "revisit"
    whole = rows.where(~again).groupBy("payload_digest", F.col("uri").alias("refers_to_uri")).agg(
        F.max(F.struct(F.length("id").alias("n"), F.col("id"))).alias("top"), F.max("payload_bytes").alias("bytes"))
    found = salted_join(rows.where(again), whole, ["payload_digest", "refers_to_uri"], "left", salt_by=["capture_id"])
    cols = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.where(~again).withColumn("refers_to", F.lit(None).cast("string")).select(*cols).unionByName(
        found.select("id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("top.id").alias("refers_to")))


def archive_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
