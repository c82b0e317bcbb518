"""Secret scan: base spans against the plain patterns, novelty, masks."""

import hashlib
import re

import nearline.llm as llm
from nearline.llm import secrets

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return [(k, s, e) for s, _, k, e in sorted(out)]


TRICKY = ["token=passwd:abcdefghijklmnop", "secret = secret=abcdefghijkl", "API-KEY=abcdefghijklmnop apikey: 'abcdefghijkl'", "AKIAAKIAABCDEFGHIJ AKIA1234 AKIA" + "Z" * 5000,
          "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "é😀 PASSWORD : \"correct-horse-battery\" é", "f" * 15 + " " + "f" * 16 + "g" + "0" * 40, "token" * 3000, "token=" * 2000]


def test_base(spark, docs, no_docs):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string"))
    got = sorted((str(r.doc_id), [tuple(s) for s in r.base]) for r in secrets.scan_secrets(df).collect())
    assert got == sorted((str(r.doc_id), brute(r.text)) for r in df.collect())
    assert secrets.scan_secrets(no_docs).count() == 0


PROSE = "please store the authorization value default_client_configuration_name2 in the settings module and read it back " * 4


def test_novelty(spark):
    texts = [PROSE + "bearer Xk9Qz3Lp7VtR2mWc8NbYd5Hs\n", PROSE + "bearer default_client_configuration_name2\n",
             PROSE + "private authorization_value_default_settings\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.novel] for r in secrets.scan_secrets(df).collect()}
    assert got == {0: ["Xk9Qz3Lp7VtR2mWc8NbYd5Hs"], 1: [], 2: []}


A, B, C = "Xk9Qz3Lp7VtR2mWc8NbYd5Hs", "q7Zt4KfW9xLc2VhP6sJm8RbG", "Vz8Kq2Lw5Xr9Tn"


def test_copies_are_no_context(spark):
    """A secret twice within 256 characters, one copy cut by the edge of the context, or a copy in a base span."""
    texts = [f"Authorization: {A}\nplease log in with bearer {A} now", f"bearer {A}\n{'and so on, ' * 22}auth {A} end",
             f"api_key = {A}\nAuthorization: Bearer {A}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.novel] for r in secrets.scan_secrets(df).collect()}
    assert got == {0: [A, A], 1: [A, A], 2: [A]}
    assert not any(A in r.text for r in secrets.redact_secrets(df).collect())
    far = "x" * 250 + " " + A + " " + "y" * 240 + A
    at = far.index(A)
    assert not any(A[:n] in secrets.context_of(far, at, at + len(A)) for n in range(6, len(A)))


def test_every_string_after_a_cue(spark):
    """All strings after a cue, line ends included, from 12 characters on; a string too far from the one before is none."""
    texts = [f"credentials: {A} {B}", f"pwd {C}", f"auth={C}", f"bearer {A}\n{B}", f"bearer {A} {'far ' * 21}{B}", "auth=" * 3000 + C]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.novel] for r in secrets.scan_secrets(df).collect()}
    assert [got[k] for k in range(5)] == [[A, B], [C], [C], [A, B], [A]]
    assert len(secrets.candidates(texts[5], [])) == 1


def test_redact(docs):
    before, after = {}, {}
    for r in docs.collect():
        before.setdefault(str(r.doc_id), []).append(r)
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        after.setdefault(str(r.doc_id), []).append(r)
    assert "04dbebab" not in after["14"][0].text and "AKIA" not in after["14"][0].text and secrets.MASK in after["14"][0].text
    assert after["1"][0].text == before["1"][0].text and after["4"][0].text is None
    assert after["14"][0].n_chars == len(after["14"][0].text)


def test_query_digest(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in llm.QUERIES["op6_secret_scan"](spark, sf).collect():
        want = brute(text[r.doc_id])
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
        assert set(said.split(",")) <= set(r.spans.split(",")) or not said


def test_strings_without_digits_and_far_from_the_cue(spark):
    """The measure decides on strings without digits too; a cue reaches over 80 characters and line ends."""
    random = "hQzKfWpLmXvRtYbNcJdGsA"
    far = "private key for the staging host, which nobody should ever copy into a file: "
    texts = {1: f"api_key_note: the credential {random} is live", 2: f"auth\n{random[::-1]}", 3: f"{far}Zk81mQ0pLx29VbTq77",
             4: "the author of this representative misunderstanding and characteristically straightforward internationalization",
             5: "private mail9.example.com and access www.example-host.org", 6: "credential" + " word" * 40 + f" {random.lower()}",
             7: "bearer SG.ab12cdQ4.ef56ghZ8xW"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.novel] for r in secrets.scan_secrets(df).collect()}
    assert got[1] == [random] and got[2] == [random[::-1]] and got[3] == ["Zk81mQ0pLx29VbTq77"]
    assert got[4] == [] and got[5] == [] and got[6] == [] and got[7] == ["SG.ab12cdQ4.ef56ghZ8xW"]
