"""Chat formatting by incremental black-box rendering.

The template is a black box ``render(messages, first) -> str``.  For every
conversation the successive turn prefixes are rendered; the difference of two
consecutive outputs is the newest turn's span.  An output that does not begin
with its predecessor means that the template rewrote history: the turn is
flagged and its span starts where the two outputs part.  Where a turn's own
text lies inside its span is found by rendering the same prefix once more
with a probe in place of the text.

Every prefix is rendered whole, and all turns are rendered once more with a
probe in place of each text, to find where the finished conversation shows it.
A template may rewrite earlier output (a marker that follows the last turn, a
counter, rules for the last user turn): the parts are then cut from the finished
text, so joined they are always the template's own rendering of the whole
conversation, and a text that the template moved out of order, or dropped, has
an empty span.  A task holds one conversation, and k turns make k^2 turns of text.

A template that renders every turn by itself, as ChatML does, says so by
``turn_local`` beside its ``render``.  Its prefixes are then taken inside blocks of ``block_turns``
turns (``first`` tells the template whether a block opens the conversation),
the work is linear in the number of turns and a task holds one block.  Rows
are hash-partitioned by conversation, sorted by turn and streamed.

Defined cases: a null text or role is empty; a null ``conv_id`` is a
conversation of its own; rows with equal ``turn`` come in the order of role,
then text, and repeated rows are repeated turns; an empty table gives no
rows.  Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBE = "Zq7ProbeTextq7Z"
BLOCK_TURNS = 64

SPANS = "conv_id long, turn_no long, role string, formatted string, text_start int, text_end int, loss boolean, rewrites boolean"


class ChatML:
    """``<|im_start|>role\\ntext<|im_end|>\\n`` with reversible escapes.

    Inside roles and texts a backslash doubles and ``<|`` becomes ``<\\|``,
    so no control string can appear there; in roles a line feed becomes
    ``\\n``.
    """

    start, end = "<|im_start|>", "<|im_end|>"
    turn_local = True

    @staticmethod
    def escape(text: str) -> str:
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    @staticmethod
    def unescape(text: str) -> str:
        if "\\" not in text:
            return text
        out, at = [], 0
        while (k := text.find("\\", at)) >= 0:
            out.append(text[at:k])
            out.append("\n" if text[k + 1:k + 2] == "n" else text[k + 1:k + 2])
            at = k + 2
        out.append(text[at:])
        return "".join(out)

    def render(self, messages: list[tuple[str, str]], first: bool = True) -> str:
        return "".join(f"{self.start}{self.escape(role).replace(chr(10), chr(92) + 'n')}\n{self.escape(text)}{self.end}\n"
                       for role, text in messages)

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns that a formatted text shows, unescaped."""
        out, at = [], 0
        while (a := formatted.find(self.start, at)) >= 0:
            nl = formatted.index("\n", a)
            z = formatted.index(self.end, nl)
            out.append((self.unescape(formatted[a + len(self.start):nl]), self.unescape(formatted[nl + 1:z])))
            at = z + len(self.end)
        return out


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def turn_spans(messages: list[tuple[str, str]], render: Callable[..., str], first: bool) -> Iterator[tuple[str, int, int, bool]]:
    """``(newest part, text start, text end, rewrites)`` of each turn of a block.

    Offsets count from the start of the part.  A text that the template does
    not show verbatim at the probe's place (dropped, say) has an empty span.
    """
    before = ""
    for t in range(1, len(messages) + 1):
        now = render(messages[:t], first)
        rewrites = not now.startswith(before)
        at = _common(before, now) if rewrites else len(before)
        probed = render([*messages[:t - 1], (messages[t - 1][0], PROBE)], first)
        k = probed.find(PROBE, min(at, len(probed)))
        tail = len(probed) - k - len(PROBE)
        a, z = (k - at, len(now) - tail - at) if k >= 0 else (0, 0)
        yield now[at:], a, max(a, z), rewrites
        before = now


def is_turn_local(template) -> bool:
    """True where the very class that defines ``render`` says so; a subclass with
    a ``render`` of its own must say it again."""
    owner = next((c for c in type(template).__mro__ if "render" in vars(c)), None)
    return owner is not None and bool(vars(owner).get("turn_local", False))


def whole_spans(messages: list[tuple[str, str]], render: Callable[..., str]) -> Iterator[tuple[str, int, int, bool]]:
    """The same for a whole conversation and any template: the parts are pieces
    of the finished text, cut behind each turn's text there, or behind what the
    turn's own prefix has in common with it if that is more."""
    final = render(messages, True)
    before, stop = "", 0
    for t in range(1, len(messages) + 1):
        now = render(messages[:t], True)
        role, text = messages[t - 1]
        probed = render([*messages[:t - 1], (role, PROBE), *messages[t:]], True)
        k = probed.find(PROBE)
        a, z = (k, len(final) - (len(probed) - k - len(PROBE))) if k >= 0 else (0, 0)
        if not (stop <= a <= z):                                  # dropped, or shown among earlier turns
            a = z = stop
        end = len(final) if t == len(messages) else max(z, stop, _common(now, final))
        yield final[stop:end], a - stop, z - stop, not now.startswith(before)
        before, stop = now, end


def format_conversations(rows: DataFrame, template=None, loss_roles: tuple[str, ...] = ("assistant",),
                         block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per turn: its number, the formatted part, where its text lies
    in that part (code points), whether it is under the loss mask and whether
    rendering it changed earlier output.  Rows of a conversation come in
    order inside one partition; their parts joined are the formatted text.
    """
    template = template or ChatML()
    local = is_turn_local(template)
    sorted_rows = (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
                   .repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        conv, n = None, 0
        started = False
        out: list[tuple] = []

        def flush():
            nonlocal n
            found = turn_spans(held, template.render, n == 0) if local else whole_spans(held, template.render)
            for k, (part, a, z, rewrites) in enumerate(found):
                out.append((conv, n + k, held[k][0], part, a, z, held[k][0] in loss_roles, rewrites))
            n += len(held)
            held.clear()

        def batch():
            cols = list(zip(*out))
            out.clear()
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[
                "conv_id", "turn_no", "role", "formatted", "text_start", "text_end", "loss", "rewrites"])

        for b in batches:
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if not started or c != conv:
                    flush()
                    conv, n, started = c, 0, True
                elif local and len(held) >= block_turns:
                    flush()
                held.append((role, text))
                if len(out) >= 2000:
                    yield batch()
        flush()
        if out:
            yield batch()

    return sorted_rows.mapInArrow(run, SPANS)


def read_back(spans: DataFrame, template=None) -> DataFrame:
    """One row per conversation, read from the formatted parts alone: number
    of turns, digests of all turns and of the text under the loss mask,
    sizes.  Streams the rows that :func:`format_conversations` gives, in the
    same partitions; a digest is fed part by part.
    """
    template = template or ChatML()
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.replace(" long", "").replace(" string", "").split(", ")
        out, cur = [], None

        def close():
            out.append((cur[0], cur[1], cur[2].hexdigest(), cur[3], cur[4].hexdigest(), cur[5], cur[6]))

        def batch():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            r = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return r

        for b in batches:
            get = {k: b.column(k).to_pylist() for k in ("conv_id", "formatted", "text_start", "text_end", "loss", "rewrites")}
            for c, part, a, z, loss, rewrites in zip(*get.values()):
                if cur is None or c != cur[0]:
                    if cur is not None:
                        close()
                    cur = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in template.read(part):
                    cur[1] += 1
                    cur[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    text = template.unescape(part[a:z])
                    cur[3] += len(text)
                    cur[4].update(text.encode())
                cur[5] += len(part)
                cur[6] += rewrites
            if len(out) >= 2000:
                yield batch()
        if cur is not None:
            close()
        if out:
            yield batch()

    return spans.mapInArrow(run, schema)
