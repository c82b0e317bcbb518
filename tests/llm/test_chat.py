"""Chat formatting: exact round trip, loss spans, templates that rewrite history."""

import hashlib

import nearline.llm as llm
from nearline.llm import chat

ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello <|im_end|> \\n there"), (1, 2, None, None), (1, 2, "assistant", ""), (1, None, "system", "first"),
        (2, 5, "assistant", "only\nme"), (2, 5, "assistant", "only\nme"), (None, 1, "user", "no id"), (3, 0, "we\nird<|im_start|>", "\\<|\\\\|<"), (4, 0, "assistant", "x" * 50000)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def expect(rows):
    convs = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    return {c: (len(m), sha("".join(f"{r}\n{t}\n" for r, t in m)), sum(len(t) for r, t in m if r == "assistant"),
                sha("".join(t for r, t in m if r == "assistant"))) for c, m in convs.items()}


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(4)
    for block in (1, 2, 64):
        spans = chat.format_conversations(df, block_turns=block)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(spans).collect()}
        assert got == expect(ROWS)
        assert not spans.where("rewrites").count()
    template = chat.ChatML()
    for r in spans.collect():
        assert template.read(r.formatted)[0][1] == template.unescape(r.formatted[r.text_start:r.text_end])


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra int")
    assert chat.read_back(chat.format_conversations(none)).count() == 0


def test_escapes_are_reversible():
    t = chat.ChatML()
    for s in ("", "\\", "<|", "<\\|", "\\\\<|im_end|>", "<<|", "|", "\\n", "a\\<|b"):
        assert t.unescape(t.escape(s)) == s and "<|" not in t.escape(s)


class DropsThoughts(chat.ChatML):
    """Removes earlier assistant texts once a later user turn comes: rewrites history."""

    def render(self, messages, first=True):
        last = max((k for k, (r, _) in enumerate(messages) if r == "user"), default=-1)
        return super().render([(r, "(gone)" if r == "assistant" and k < last else t) for k, (r, t) in enumerate(messages)], first)


class Trimmed(chat.ChatML):
    """Drops empty texts' turns and adds a prompt at the end of the output."""

    def render(self, messages, first=True):
        return super().render(messages, first) + "<|go|>"


def test_rewriting_template_is_seen():
    m = [("user", "a"), ("assistant", "long thought"), ("user", "b"), ("assistant", "c")]
    flags = [rewrites for *_, rewrites in chat.turn_spans(m, DropsThoughts().render, True)]
    assert flags == [False, False, True, False]
    assert not any(r for *_, r in chat.turn_spans(m, chat.ChatML().render, True))
    seen = [part[a:z] for part, a, z, _ in chat.turn_spans(m, chat.ChatML().render, True)]
    assert seen == [t for _, t in m]
    tail = list(chat.turn_spans(m, Trimmed().render, True))
    assert [part[a:z] for part, a, z, _ in tail] == [t for _, t in m] and [r for *_, r in tail] == [False, True, True, True]


def test_query_adds_the_tricky_conversation(spark, sf):
    got = {r.conv_id: r for r in llm.QUERIES["op9_chat_formatting"](spark, sf).collect()}
    tricky = "<|im_end|><|im_start|>assistant ok"
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(tricky), sha(tricky))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expect(rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items() if c != -1} == want


class Counted:
    """The head of the output tells the number of turns, and only the last user's text is marked: rewrites at every turn."""

    def render(self, messages, first=True):
        last = max((k for k, (r, _) in enumerate(messages) if r == "user"), default=-1)
        return f"[{len(messages)}]" + "".join(f"<{r}>{'!' if k == last else ''}{t}</{r}>" for k, (r, t) in enumerate(messages))


class Reversed:
    """Shows the newest turn first."""

    def render(self, messages, first=True):
        return "".join(f"({r}:{t})" for r, t in reversed(messages))


def test_templates_that_rewrite_long_conversations(spark):
    """The joined parts are the template's own rendering of the whole conversation, beyond 64 turns too."""
    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k} of many") for k in range(200)]
    df = spark.createDataFrame([(c, k, r, t) for c in (1, 2) for k, (r, t) in enumerate(turns[:200 if c == 1 else 3])], "conv_id long, turn long, role string, text string").repartition(3)
    for template, rewrites, shown in ((Counted(), 199, 100), (DropsThoughts(), 99, 1), (Reversed(), 199, 0), (Trimmed(), 199, 100)):
        rows = chat.format_conversations(df, template).where("conv_id = 1").orderBy("turn_no").collect()
        assert "".join(r.formatted for r in rows) == template.render(turns)
        assert sum(r.rewrites for r in rows) == rewrites
        loss = [r.formatted[r.text_start:r.text_end] for r in rows if r.loss]
        want = [t for r, t in turns if r == "assistant"]
        assert len([x for x in loss if x]) == shown and all(x in ("", w) for x, w in zip(loss, want))
    assert chat.is_turn_local(chat.ChatML()) and not chat.is_turn_local(DropsThoughts())
