"""Personal data: base spans against Python's matcher, the method's parts."""

import hashlib
import re

import nearline.llm as llm
from nearline.llm import pii

P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def brute(text):
    out = []
    for kind, p in P.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d),
                    "phone": lambda: 8 <= len(d) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = ["a@b.c%d@e.f x@y..z a@b-.co", "1.2.3 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4 1.2.3.99999999999999999999",
          "4111-1111-1111-1111 4111 1111 1111 1112 1 2 3 4", "+1 (415) 555-0134 +12 +1234567890123456 +49 30 123456", "é😀 +1 415 555 0134 😀 a@b.de",
          "9" * 4000, "a" * 3000, "a@" + "b." * 3000, "+" + "1 " * 2000, "1." * 3000, "x@y.z " * 700, "(415) 555-0134 call", "order 4111111111111112 version 1.2.3.4"]


def spans(column):
    return [tuple(s) for s in column]


def test_base(spark, docs, no_docs):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(TRICKY)], "doc_id long, text string"))
    got = sorted((str(r.doc_id), spans(r.base)) for r in pii.find_pii(df).collect())
    assert got == sorted((str(r.doc_id), brute(r.text)) for r in df.collect())
    assert pii.find_pii(no_docs).count() == 0


def test_added_spans_overlap_no_base(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in pii.find_pii(docs).collect():
        for _, a, z in spans(r.added):
            assert not any(x < z and a < y for _, x, y in spans(r.base))


def test_query_digest(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in llm.QUERIES["op3_personal_data"](spark, sf).collect():
        want = brute(text[r.doc_id])
        said = ",".join(f"{k}:{a}:{z}" for k, a, z in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(r.spans.split(",")) or not said
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in pii.KINDS)


def test_em_finds_reliable_labelers():
    """Two labelers that tell the truth, one that guesses: the posterior
    follows the first two, and the guesser's chances come out alike for both classes."""
    import random
    rng, counts, truth = random.Random(1), {}, {}
    for _ in range(4000):
        y = rng.random() < 0.4
        say = lambda right: (1 if y else -1) * (1 if rng.random() < right else -1)  # noqa: E731, B023
        key = (0, (say(0.95), say(0.9), say(0.5), 0), 2, 1)
        counts[key] = counts.get(key, 0) + 1
        truth.setdefault(key, []).append(y)
    post, chances = pii.estimate(counts)
    assert chances[0][1][2] > 0.85 and abs(chances[2][1][2] - chances[2][0][2]) < 0.1
    w = pii.fit_classifier(counts, post)
    right = sum((sum(w[i] for i in pii.slots(k)) >= 0) == y for k, ys in truth.items() for y in ys)
    assert right >= 0.9 * 4000


def test_many_matches_are_placed(spark):
    text = " ".join(f"u{k}@h{k}.org" for k in range(900))
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert spans(r.base) == brute(text)


#: Beside the given table: local numbers to be added, by language, and look-alikes to be left alone.
CALLS = {"en": ["call me at {} today", "my phone: {}", "mobile {} after six"], "de": ["Telefon {} abends", "Handy: {} privat", "Anruf unter {} bitte"],
         "fr": ["téléphone {} le soir", "appelez le {} demain", "portable : {}"], "es": ["teléfono {} por la tarde", "llame al {} hoy", "móvil: {}"]}
OTHERS = {"phone": ["invoice no {}", "Rechnung {} bezahlt", "facture {} du mois", "pedido {} enviado", "serial {} build"],
          "ip": ["version {} released", "release {} notes", "section {} of it"], "card": ["order {} shipped", "Auftrag {} offen", "commande {} reçue", "the {} of it"]}


def test_planted_spans(spark, sf):
    """Recall of planted local numbers by language, false alarms by kind."""
    import random
    rng = random.Random(11)
    number = lambda: f"{rng.randint(2, 9)}{rng.randint(10, 99)}-555-{rng.randint(1000, 9999)}"

    def bad_card():
        while luhn(d := "4" + "".join(rng.choice("0123456789") for _ in range(15))):
            pass
        return d

    wrong = {"phone": number, "ip": lambda: f"{rng.randint(256, 999)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}", "card": bad_card}
    rows, planted = [], {}
    for lang, forms in CALLS.items():
        for k in range(12):
            v = number() if k % 2 else f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
            text = forms[k % 3].format(v)
            planted[len(rows)] = (lang, [("phone", text.index(v), text.index(v) + len(v))])
            rows.append((10**9 + len(rows), text))
    for kind, forms in OTHERS.items():
        for k in range(12):
            planted[len(rows)] = (kind, [])
            rows.append((10**9 + len(rows), forms[k % len(forms)].format(wrong[kind]())))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    added = {r.doc_id: spans(r.added) for r in pii.find_pii(docs).collect()}
    right = {}
    for k, (group, want) in planted.items():
        right.setdefault(group, []).append(added[10**9 + k] == want)
    shares = {g: sum(x) / len(x) for g, x in right.items()}
    assert min(shares.values()) >= 0.9, str(shares)
    # Texts without planted rows: digit strings that fail their test are no spans.
    assert all(kind == "phone" for i, s in added.items() if i is not None and i < 10**9 for kind, _, _ in s)


def test_reliabilities_go_by_kind():
    """A labeler that guesses for one kind keeps its say for another."""
    import random
    rng, counts, truth = random.Random(2), {}, {}
    for n in range(8000):
        kind, y = n % 2, rng.random() < 0.5
        say = lambda right: (1 if y else -1) * (1 if rng.random() < right else -1)  # noqa: E731, B023
        key = (kind, (say(0.9), say(0.9), say(0.5 if kind else 0.95), say(0.85)), 2, 1, n % 7)
        counts[key] = counts.get(key, 0) + 1
        truth.setdefault(key, []).append(y)
    post, _ = pii.estimate(counts)
    alone = lambda kind: post[kind, (1, -1, 1, 0)] if (kind, (1, -1, 1, 0)) in post else post[kind, (1, -1, 1, -1)]
    assert alone(0) > alone(1)
    w = pii.fit_classifier(counts, post)
    right = sum((sum(w[i] for i in pii.slots(k)) >= 0) == y for k, ys in truth.items() for y in ys)
    assert right >= 0.9 * 8000
    assert pii.estimate({})[0] == {} and len(pii.fit_classifier({}, {})) == len(w)
