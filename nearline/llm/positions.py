"""Benchmark decontamination on a distributed positional inverted index.

:func:`build_index` stores the postings of every token of the training
texts.  The index is cut by documents into segments of about
``segment_bytes`` of text; one row holds a segment's sorted terms and, for
each, the ascending positions (one number line per segment: documents lie on
it one after another, a gap of ``GAP`` between them, so no phrase can run
across).  Segments are built and searched independently; nothing is shuffled.

Phrases are searched in blocks of bounded size.  Corpus frequencies (summed
over all segments) order the terms of each phrase; a segment takes the
postings of the phrase's rarest term, moved back by the term's place, and
intersects them with the lists of the next rarest terms in turn, all phrases
of a block together as sorted arrays.  Candidates are taken in runs of
bounded size, so a phrase of very common words costs time, not memory.

Defined cases: a null text has no words; items or documents without words
match nothing; repeated rows are separate documents or one more item with
the same id; a null item id is left out of ``items``; empty tables work.
Only the named id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import byte_texts, pack, unpack

#: Words of the lower-cased UTF-8 bytes: digits, letters, everything that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = 64
SEGMENT_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
RUN = 1 << 20

INDEX = ("segment long, doc_ids array<long>, starts binary, lengths binary, terms array<binary>, counts binary, postings binary")


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per segment: its documents (id, place on the number line,
    number of words) and its postings (terms in byte order, how many
    positions each has, the positions as 32-bit numbers)."""
    def segment(ids: list, texts: list[bytes], number: int) -> dict:
        words, starts, lengths, at = [], [], [], 0
        places = []
        for t in texts:
            w = WORD.findall(t.lower())
            starts.append(at)
            lengths.append(len(w))
            places.append(np.arange(at, at + len(w), dtype=np.int32))
            words += w
            at += len(w) + GAP
        coded = pa.array(words, pa.binary()).dictionary_encode()
        terms = coded.dictionary
        order = pc.array_sort_indices(terms).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number_of = rank[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.int32)
        line = np.sort((number_of << 32) | place)           # by term, then position
        return {"segment": number, "doc_ids": ids, "starts": pack(np.array(starts, np.int32)), "lengths": pack(np.array(lengths, np.int32)),
                "terms": terms.take(pa.array(order)), "counts": pack(np.bincount(number_of, minlength=len(order)).astype(np.int32)),
                "postings": pack((line & 0xFFFFFFFF).astype(np.int32))}

    def row(s: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([s["segment"]], pa.int64()), pa.array([s["doc_ids"]], pa.list_(pa.int64())), pa.array([s["starts"]], pa.binary()),
            pa.array([s["lengths"]], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(s["terms"])], pa.int32()), s["terms"]),
            pa.array([s["counts"]], pa.binary()), pa.array([s["postings"]], pa.binary())],
            names=["segment", "doc_ids", "starts", "lengths", "terms", "counts", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for b in batches:
            for s in range(0, b.num_rows, 128):              # few texts at a time as Python objects
                part = b.slice(s, 128)
                for i, t in zip(part.column("doc_id").to_pylist(), byte_texts(part.column("text"))):
                    ids.append(i)
                    texts.append(t)
                    size += len(t) + 8
                    if size >= segment_bytes:
                        yield row(segment(ids, texts, number))
                        number += 1
                        ids, texts, size = [], [], 0
        if ids:
            yield row(segment(ids, texts, number))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class Segment:
    """A segment's row as arrays, with its terms numbered as in a phrase list."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        self.doc_ids = row["doc_ids"]
        self.starts, self.lengths = unpack(row["starts"], np.int32).astype(np.int64), unpack(row["lengths"], np.int32)
        counts = unpack(row["counts"], np.int32).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(counts)])
        here = pc.index_in(vocabulary, value_set=row["terms"]).to_numpy(zero_copy_only=False).astype(np.float64)
        known = ~np.isnan(here)
        place = np.where(known, here, 0).astype(np.int64)
        self.count = np.where(known, counts[place], 0) if len(counts) else np.zeros(len(vocabulary), np.int64)
        self.begin = np.where(known, begin[place], 0)
        # Positions of the listed terms, as (term, position) in one sorted array.
        take = np.repeat(self.begin, self.count) + _ramp(self.count)
        self.keys = (np.repeat(np.arange(len(self.count), dtype=np.int64), self.count) << 32) | unpack(row["postings"], np.int32)[take]
        self.at = np.concatenate([[0], np.cumsum(self.count)])

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = (term << 32) | position
        k = np.searchsorted(self.keys, want)
        return (position >= 0) & (k < len(self.keys)) & (self.keys[np.minimum(k, max(len(self.keys) - 1, 0))] == want) if len(self.keys) else np.zeros(len(want), bool)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {"segment": b.column("segment")[i].as_py(), "doc_ids": b.column("doc_ids")[i].values, "terms": b.column("terms")[i].values,
                   **{k: b.column(k)[i].as_py() for k in ("starts", "lengths", "counts", "postings")}}


def term_frequencies(index: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """Occurrences in the whole corpus of each listed term; at most one row
    per listed term reaches the driver."""
    words = pa.array(vocabulary, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                here = pc.index_in(words, value_set=b.column("terms")[i].values)
                counts = unpack(b.column("counts")[i].as_py(), np.int32)
                ok = pc.is_valid(here).to_numpy(zero_copy_only=False)
                total[ok] += counts[here.drop_null().to_numpy()]
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def match_phrases(seg: Segment, terms: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(phrase, start)`` of every occurrence, in runs.

    ``terms``: a row of term numbers per phrase (-1 beyond its size);
    ``order``: its places, rarest term first.
    """
    rows = np.arange(len(terms))
    lead = terms[rows, order[:, 0]]
    n = seg.count[lead]
    alive = np.flatnonzero(n > 0)
    # Cut into runs by candidates; a single long list is cut as well.
    ends = np.cumsum(n[alive])
    for lo in range(0, int(ends[-1]) if len(alive) else 0, RUN):
        hi = min(lo + RUN, int(ends[-1]))
        which = np.searchsorted(ends, np.arange(lo, hi), side="right")
        phrase = alive[which]
        nth = np.arange(lo, hi) - (ends[which] - n[phrase])
        start = (seg.keys[seg.at[lead[phrase]] + nth] & 0xFFFFFFFF) - order[phrase, 0]
        for r in range(1, terms.shape[1]):
            if not len(phrase):
                break
            place = order[phrase, r]
            used = r < sizes[phrase]
            ok = ~used
            ok[used] = seg.has(terms[phrase[used], place[used]], start[used] + place[used])
            phrase, start = phrase[ok], start[ok]
        keep = start >= 0
        if keep.any():
            yield phrase[keep], start[keep]


def match_near(seg: Segment, terms: np.ndarray, sizes: np.ndarray, order: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(phrase, position of its rarest term)`` wherever each other term of
    the phrase has a posting at most ``slop`` words away, in any order."""
    lead = terms[np.arange(len(terms)), order[:, 0]]
    for p in np.flatnonzero(seg.count[lead]):
        at = seg.keys[seg.at[lead[p]]:seg.at[lead[p] + 1]] & 0xFFFFFFFF
        for r in range(1, sizes[p]):
            t = terms[p, order[p, r]]
            other = seg.keys[seg.at[t]:seg.at[t + 1]] & 0xFFFFFFFF
            lo, hi = np.searchsorted(other, at - slop), np.searchsorted(other, at + slop, side="right")
            at = at[hi > lo]
        if len(at):
            yield np.full(len(at), p), at


def _windows(items: DataFrame, width: int, block: int, blocks: int) -> dict[tuple[bytes, ...], set]:
    """Distinct windows of a block of items, with the items that hold them."""
    out: dict[tuple[bytes, ...], set] = {}
    part = items.select(F.col("item_id"), "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
    for r in part.toLocalIterator():
        w = WORD.findall((r["text"] or "").encode().lower())
        for k in range(max(1, len(w) - width + 1) if w else 0):
            out.setdefault(tuple(w[k:k + width]), set()).add(r["item_id"])
    return out


def _plan(index: DataFrame, phrases: list[tuple[bytes, ...]]):
    """Term numbers of the phrases and their places in order of corpus frequency."""
    vocabulary = sorted({t for p in phrases for t in p})
    number = {t: k for k, t in enumerate(vocabulary)}
    frequency = term_frequencies(index, vocabulary)
    wide = max(map(len, phrases))
    sizes = np.array([len(p) for p in phrases], np.int64)
    terms = np.full((len(phrases), wide), -1, np.int64)
    for k, p in enumerate(phrases):
        terms[k, :len(p)] = [number[t] for t in p]
    rank = np.where(terms >= 0, frequency[terms], np.iinfo(np.int64).max)
    return vocabulary, terms, sizes, np.argsort(rank, axis=1, kind="stable")


def search(index: DataFrame, phrases: list[tuple[bytes, ...]], slop: int | None = None) -> DataFrame:
    """``(phrase, doc_id, position)`` of each exact occurrence (or, with
    ``slop``, proximity match at its rarest term) of a bounded list of
    phrases; ``position`` counts words from the document's start."""
    vocabulary, terms, sizes, order = _plan(index, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            seg = Segment(row, pa.array(vocabulary, pa.binary()))
            for p, at in match_phrases(seg, terms, sizes, order) if slop is None else match_near(seg, terms, sizes, order, slop):
                d = np.searchsorted(seg.starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), seg.doc_ids.take(pa.array(d)), pa.array(at - seg.starts[d], pa.int64())],
                                                 names=["phrase", "doc_id", "position"])

    return index.mapInArrow(run, "phrase long, doc_id long, position long")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, segment_bytes: int = SEGMENT_BYTES,
                  block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, hits`` (merged half-open word
    ranges that item windows cover) and ``items`` (sorted ids of the items
    with occurring windows).

    The items are the query set: blocks of about ``block_bytes`` of their
    text, each searched over the whole index.
    """
    index = cut_lineage(build_index(docs, segment_bytes), "positions")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).first()["b"]
    blocks = int(size) // block_bytes + 1
    found = None
    for block in range(blocks):
        windows = _windows(items, width, block, blocks)
        part = _hits(index, windows, whole=block == 0)
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found.select("doc_id", "n_words", "hits", "items")
    merged = found.groupBy("segment", "nth").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.aggregate("hits", F.expr(f"cast(array() as {RANGES})"), lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] >= x["start"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(x))))
    return merged.select("doc_id", "n_words", joined.alias("hits"), "items")


RANGES = "array<struct<start:int,stop:int>>"


def _hits(index: DataFrame, windows: dict[tuple[bytes, ...], set], whole: bool) -> DataFrame:
    """Covered word ranges and items per document; every document if
    ``whole``, else those with a hit."""
    phrases = sorted(windows)
    owners = [sorted({str(i) for i in windows[p] if i is not None}) for p in phrases]
    vocabulary, terms, sizes, order = _plan(index, phrases) if phrases else ([], None, None, None)
    range_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocabulary, pa.binary())
        for row in _rows(batches):
            seg = Segment(row, words)
            n = len(seg.doc_ids)
            got = list(match_phrases(seg, terms, sizes, order)) if phrases else []
            hits: list[list] = [[] for _ in range(n)]
            owned: list[set] = [set() for _ in range(n)]
            if got:
                p, at = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
                by = np.argsort(at, kind="stable")
                p, at = p[by], at[by]
                doc = np.searchsorted(seg.starts, at, side="right") - 1
                for k, start, d in zip(p.tolist(), (at - seg.starts[doc]).tolist(), doc.tolist()):
                    owned[d].update(owners[k])
                    stop = start + int(sizes[k])
                    if hits[d] and hits[d][-1]["stop"] >= start:
                        hits[d][-1]["stop"] = max(hits[d][-1]["stop"], stop)
                    else:
                        hits[d].append({"start": start, "stop": stop})
            keep = range(n) if whole else [d for d in range(n) if hits[d]]
            yield pa.RecordBatch.from_arrays([
                pa.array([row["segment"]] * len(keep), pa.int64()), pa.array(list(keep), pa.int32()),
                seg.doc_ids.take(pa.array(list(keep), pa.int64())), pa.array(seg.lengths[list(keep)], pa.int64()),
                pa.array([hits[d] for d in keep], range_type), pa.array([sorted(owned[d]) for d in keep], pa.list_(pa.string()))],
                names=["segment", "nth", "doc_id", "n_words", "hits", "items"])

    return index.mapInArrow(run, f"segment long, nth int, doc_id long, n_words long, hits {RANGES}, items array<string>")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs; rows that
    repeat an id share its fate, rows without an id stay."""
    hit = decontaminate(docs, items, width).where("size(hits) > 0").select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, docs["doc_id"] == hit["__hit"], "left_anti")
