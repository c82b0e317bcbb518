"""Secret scan by dictionary-primed zstandard novelty.

Three fixed patterns give the base spans.  Further candidates are the strings
of 12 characters or more that follow a sensitive word, or each other, within
``GAP`` characters, line ends included; each one's novelty is its marginal cost: the compressed size of
context plus candidate less that of the context alone, from which further
copies of the candidate are removed, under a raw zstandard dictionary made of identifiers that
the corpus itself uses next to sensitive words.  A string that costs nearly
its own length is reported (kind ``novel``).  Strings without a digit and dotted
strings may be long words and host names that compression knows no better, so
they must cost ``STRICT_RATIO`` of their length and ``STRICT_BYTES`` bytes, as
much as 128 random bits.

One pass over the texts finds spans and candidates (a narrow table, written
once); identifiers are counted over all candidates' contexts by a combinable
aggregate, the most frequent ones fill a dictionary of ``dict_bytes``.

Defined cases: a null text is empty and has no spans; an empty table gives no
rows; very long texts are read whole; rows with a null or
repeated ``doc_id`` are scanned like others, one row out for each row in;
only ``doc_id`` and ``text`` are read.  Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CUE = re.compile(r"password|passwd|secret|token|api_?key|pwd|bearer|credential|private|auth|signature|access", re.I | re.A)
GAP = 80                     # characters between a sensitive word, or a string, and the next string
STRICT_RATIO, STRICT_BYTES = 0.9, 16
#: The next long string, ``GAP`` characters on at most; it may follow a sign ``=`` and hold single points.
NEXT = re.compile(r"[\s\S]{0,%d}?(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-](?:[A-Za-z0-9+/_=-]|\.(?=[A-Za-z0-9+/_=-])){11,})" % GAP, re.A)
CUES = ("passw", "secret", "token", "api", "pwd", "bearer", "credential", "private", "auth", "signature", "access")
#: Words of the dictionary; without digits, so that a secret that was copied does not become one.  Of an
#: identifier that goes on with a digit, as ``config_name2``, the parts before count: its copies are no context.
IDENT = r"(?<![A-Za-z0-9_])[A-Za-z_]{4,32}(?![A-Za-z0-9])"
CONTEXT = 256
#: Ordinary identifiers and words beside secrets; always part of the dictionary.
SEED_IDENTIFIERS = ("authorization bearer access_token refresh_token client_secret client_id private_key public_key api_key apikey "
                    "password passwd username credentials signature session_id connection_string database_url config settings "
                    "environment export import return function string value default example placeholder changeme your_secret_here "
                    "your_api_key_here xxxxxxxxxxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ")

SPAN = "array<struct<kind:string,start:int,end:int>>"
FOUND = f"doc_id long, base {SPAN}, cands array<struct<start:int,end:int,value:string,context:string>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str]]:
    """Strings in sensitive context outside the base spans, with the text around them."""
    low = text.lower()
    if not any(w in low for w in CUES):
        return []
    out, done = [], 0
    for cue in CUE.finditer(text):
        if cue.end() <= done:                                # the walk from an earlier word has passed here
            continue
        done = cue.end()
        while m := NEXT.match(text, done):
            a, done = m.span(1)
            if not any(a < e and s < done for _, s, e in taken):
                out.append((a, done, m.group(1), context_of(text, a, done)))
    return out


def context_of(text: str, a: int, z: int) -> str:
    """``CONTEXT`` characters on either side of ``text[a:z]`` without further
    copies of that string, whole or cut by the edge."""
    size, value = z - a, text[a:z]

    def without(lo: int, hi: int, start: int, stop: int) -> str:
        parts, at, k = [], lo, text.find(value, start, stop)
        while k >= 0:
            parts.append(text[at:max(at, k)])
            at = max(at, k + size)
            k = text.find(value, k + size, stop)
        return "".join([*parts, text[at:hi]])

    lo, hi = max(0, a - CONTEXT), min(len(text), z + CONTEXT)
    return without(lo, a, max(0, lo - size + 1), a) + "\n" + without(z, hi, z, hi + size - 1)


def find_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, base spans, candidates with context)`` of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("context", pa.string())]))
        for b in batches:
            base, more = [], []
            for text in b.column("text").to_pylist():
                found = base_spans(text or "")
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                more.append([{"start": s, "end": e, "value": v, "context": c} for s, e, v, c in candidates(text or "", found)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, span), pa.array(more, cand)], names=["doc_id", "base", "cands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def identifier_dictionary(found: DataFrame, dict_bytes: int) -> bytes:
    """The identifiers that two texts or more use around candidates, most frequent last (zstandard finds
    the end of a dictionary cheapest).  At most ``dict_bytes / 5`` rows and
    ``dict_bytes`` bytes reach the driver."""
    said = F.concat_ws("\n", F.transform("cands", lambda c: F.concat_ws("\n", c["context"], c["value"])))
    words = (found.where("size(cands) > 0").select(F.explode(F.array_distinct(F.regexp_extract_all(said, F.lit(IDENT), F.lit(0)))).alias("w"))
             .groupBy("w").count().where("count >= 2").orderBy(F.desc("count"), "w").limit(dict_bytes // 5))
    kept, size = [], 0
    for r in words.toLocalIterator():
        size += len(r["w"]) + 1
        if size > dict_bytes:
            break
        kept.append(r["w"])
    return " ".join([*reversed(kept), SEED_IDENTIFIERS]).encode()


class Novelty:
    """Marginal compressed bytes of a candidate in its context, under a
    dictionary read as raw content."""

    def __init__(self, dictionary: bytes, min_ratio: float):
        import zstandard
        self.min_ratio = min_ratio
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=False,
                                               dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def marginal(self, value: str, context: str) -> int | None:
        """That cost if the candidate is novel, else None."""
        base = context.encode() + b"\n"
        extra = len(self.packer.compress(base + value.encode())) - len(self.packer.compress(base))
        strict = "." in value or not any(c in "0123456789" for c in value)
        enough = extra >= STRICT_BYTES and extra >= STRICT_RATIO * len(value) if strict else extra >= self.min_ratio * len(value)
        return extra if enough else None


def score_novelty(found: DataFrame, dictionary: bytes, min_ratio: float) -> DataFrame:
    """Adds ``novel``: the candidates that are novel, with that figure."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal_bytes", pa.int32())]))
        novelty = Novelty(dictionary, min_ratio)
        for b in batches:
            novel = []
            for cands in b.column("cands").to_pylist():
                scored = [(c["start"], c["end"], novelty.marginal(c["value"], c["context"])) for c in cands or []]
                novel.append([{"start": s, "end": e, "marginal_bytes": m} for s, e, m in scored if m is not None])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("base"), pa.array(novel, kind)], names=["doc_id", "base", "novel"])

    return found.mapInArrow(run, f"doc_id long, base {SPAN}, novel array<struct<start:int,end:int,marginal_bytes:int>>")


def scan_secrets(docs: DataFrame, dict_bytes: int = 65536, min_ratio: float = 0.6) -> DataFrame:
    """``(doc_id, base, novel)`` for every row of ``docs``: base spans and the
    novel strings with their marginal compressed bytes."""
    found = cut_lineage(find_spans(docs), "secret_spans")
    return score_novelty(found, identifier_dictionary(found, dict_bytes), min_ratio)


MASK = "[SECRET]"


def redact_secrets(docs: DataFrame, dict_bytes: int = 65536, min_ratio: float = 0.6) -> DataFrame:
    """``docs`` with every secret span (base or novel) of ``text`` replaced by
    ``MASK`` and ``n_chars``, where there is such a column, counted anew.  All
    rows and columns stay; overlapping spans become one mask; null stays null.
    """
    dictionary = identifier_dictionary(cut_lineage(find_spans(docs), "secret_spans"), dict_bytes)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary, min_ratio)
        for b in batches:
            at = names.index("text")
            out = []
            for text in b.column(at).to_pylist():
                if text:
                    found = base_spans(text)
                    spans = [(s, e) for _, s, e in found] + [(c[0], c[1]) for c in candidates(text, found) if novelty.marginal(c[2], c[3]) is not None]
                    stop, parts = 0, []
                    for s, e in sorted(spans):
                        if s >= stop:
                            parts += [text[stop:s], MASK]
                        stop = max(stop, e)
                    text = "".join([*parts, text[stop:]]) if spans else text
                out.append(text)
            b = b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))
            if "n_chars" in names:
                k = names.index("n_chars")
                n = [old if t is None else len(t) for t, old in zip(out, b.column(k).to_pylist())]
                b = b.set_column(k, b.schema.field(k), pa.array(n, b.schema.field(k).type))
            yield b

    return docs.mapInArrow(run, schema)
