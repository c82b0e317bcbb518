"""Personal data by weak supervision.  DataFrame functions only.

Fixed patterns give candidate spans: e-mail addresses, IPv4 addresses, card
numbers, international phone numbers (each valid match is a base span) and
local phone numbers.  Four labelers vote on each candidate (+1, 0, -1):
the strict form, a gazetteer (top-level domains, calling codes, card
prefixes, reserved networks), cue words around it (English, German, French,
Spanish), and its borders.  Expectation-maximisation over the counts of vote
patterns estimates the reliability of each labeler for each kind, drawn to a
stated prior where a kind is rare, and a posterior for each pattern; a
logistic span classifier is then trained on those posteriors with the votes,
the kind, the length, the share of digits and the hashed word before as
features.  Base spans always stay;
candidates that are no base span are added where the classifier says so and
they overlap no base span.

One pass over the texts writes a narrow table of candidates, a row for each
row of the input, with the characters around them; nothing is shuffled.
Candidates are counted by feature pattern, at most ``MAX_PATTERNS`` rows by
construction, and only these counts reach the driver.  Places come from the
lengths of the pieces between matches (code points), summed in runs of 256.

Patterns are written so that no text makes the matcher back-track without
bound or recurse: repeated groups are possessive, and a run of one class is
entered at its start or where the last match ended.

Defined cases: a null or empty text has no spans; rows with null or repeated
ids are handled one by one; only ``doc_id`` and ``text`` are read, so further
columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; "local" is this module's own.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
}
#: A character that a text must hold to be searched for the kind at all.
HINT = {"email": "@", "ip": ".", "phone": "+"}

# Gazetteers.
TOP_LEVEL_DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "dev", "app", "me", "eu", "uk", "de", "fr", "es",
                     "it", "nl", "be", "ch", "at", "se", "no", "dk", "fi", "pl", "pt", "ie", "us", "ca", "mx", "br", "ar", "cl", "au", "nz", "jp",
                     "cn", "kr", "in", "ru", "tr", "za")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52",
                 "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94",
                 "95", "98", "351", "352", "353", "354", "358", "420", "421")
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED_NETWORK = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
# Beginnings of cue words in English, German, French and Spanish.
MAIL_WORDS = r"e-?mail|mail|contact|reach|write|send|kontakt|schreib|senden|courriel|écri|envoy|joindre|correo|contacto|escrib|envi"
NET_WORDS = r"ip|addr|host|server|client|from|login|adresse|rechner|serveur|depuis|connexion|direcci|servidor|desde"
CARD_WORDS = r"card|visa|credit|debit|payment|amex|karte|kredit|zahlung|carte|crédit|paiement|tarjeta|crédito|pago"
CALL_WORDS = r"phone|call|tel|mobile|fax|cell|whatsapp|telefon|anruf|ruf|handy|mobil|télé|appel|portable|teléfono|llam|móvil|celular"
OTHER_WORDS = (r"version|release|section|chapter|isbn|order|invoice|serial|build|total|sku|part no|rechnung|bestell|artikel|kapitel|serien|auftrag|"
               r"facture|commande|chapitre|série|référence|factura|pedido|capítulo|serie|versión|referencia")
# End of fixed values.
_begins = r"(?<!\p{L})(?:%s)"
CUES = {k: _begins % w for k, w in (("email", MAIL_WORDS), ("ip", NET_WORDS), ("card", CARD_WORDS), ("phone", CALL_WORDS), ("local", CALL_WORDS))}
COUNTER_CUES = _begins % OTHER_WORDS

VOTERS = 4
LENGTHS, DIGITS, WORDS = 6, 4, 64
MAX_PATTERNS = len(PATTERNS) * 3 ** VOTERS * LENGTHS * DIGITS * WORDS
#: The last word before a candidate (letters, in 24 characters).
LAST_WORD = r"(\p{L}+)\P{L}*$"
#: Chances of a vote of -1, 0, +1 before any data, for no span and for a span,
#: by labeler: a failed form speaks against a span by 200 to 1, a cue by 10 to 1, another cue (an invoice) by 23 to 1.
PRIOR = (((0.40, 0.27, 0.33), (0.002, 0.338, 0.66)), ((0.30, 0.30, 0.40), (0.10, 0.30, 0.60)),
         ((0.35, 0.60, 0.05), (0.015, 0.485, 0.50)), ((0.40, 0.25, 0.35), (0.05, 0.25, 0.70)))
SHARES = (0.35, 0.65)
MASS = 20.0      # candidates of a kind that the prior counts for
RUN = 256


def find_candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and per kind the matches of each text: value, characters
    since the last match, and the text right before and after."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    got = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    got = {k: F.when(F.contains("text", F.lit(HINT[k])), c) if k in HINT else c for k, c in got.items()}
    d = d.select("doc_id", "text", *[c.alias(f"m_{k}") for k, c in got.items()])
    edge = lambda p: F.struct(F.char_length(p).alias("n"), F.lower(F.substring(p, -24, 24)).alias("before"), F.lower(F.substring(p, 1, 12)).alias("after"))
    d = d.select("doc_id", *[f"m_{k}" for k in PATTERNS],
                 *[F.when(F.size(f"m_{k}") > 0, F.transform(F.split("text", p, -1), edge)).alias(f"g_{k}") for k, p in PATTERNS.items()])

    def found(k):
        at = lambda i: F.get(F.col(f"g_{k}"), i)
        return F.when(F.size(f"m_{k}") > 0, F.transform(f"m_{k}", lambda v, i: F.struct(
            v.alias("value"), at(i)["n"].alias("gap"), at(i)["before"].alias("before"), at(i + 1)["after"].alias("after")))).alias(k)

    return d.select("doc_id", *[found(k) for k in PATTERNS])


def starts(found: str) -> Column:
    """First place of each match: running sums over gaps and lengths."""
    step = lambda x: x["gap"] + F.char_length(x["value"])
    empty = F.expr("cast(array() as array<int>)")

    def run(chunk, first):
        return F.aggregate(chunk, F.struct(first.alias("at"), empty.alias("out")), lambda acc, x: F.struct(
            (acc["at"] + step(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out")))["out"]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda j: F.slice(found, j * RUN + 1, RUN))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + step(x)))
    firsts = F.aggregate(sums, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, s: F.struct(
        (acc["at"] + s).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    return F.when(F.size(found) > 0, F.flatten(F.zip_with(chunks, firsts, run)))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc, i):
        x = F.substring(back, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def valid(kind: str, v: Column) -> Column:
    """Does a match of the contract's pattern pass its test?"""
    n = F.char_length(only_digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.when(
            F.char_length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3, F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(only_digits(v))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(kind == "email")


def vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(kind: str, x: Column, ok: Column) -> list[Column]:
    """The four labelers' votes on one candidate."""
    v = x["value"]
    never = F.lit(False)
    if kind == "email":
        form = vote(v.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}$"), v.rlike(r"@-|\.\.|^[.%+-]"))
        listed = vote(F.lower(F.substring_index(v, ".", -1)).isin(*TOP_LEVEL_DOMAINS), never)
    elif kind == "ip":
        form, listed = vote(ok, ~ok), vote(~v.rlike(r"^(10|192\.168)\."), v.rlike(RESERVED_NETWORK))
    elif kind == "card":
        form, listed = vote(ok, ~ok), vote(v.rlike(CARD_PREFIX), ~v.rlike(CARD_PREFIX))
    elif kind == "phone":
        d = only_digits(v)
        form = vote(ok, ~ok)
        listed = vote(F.substring(d, 1, 1).isin("1", "7") | F.substring(d, 1, 2).isin(*CALLING_CODES) | F.substring(d, 1, 3).isin(*CALLING_CODES), never)
    else:
        area = F.substring(only_digits(v), 1, 1)
        form, listed = vote(v.rlike(r"^\([0-9]{3}\) |^[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}$"), never), vote(~area.isin("0", "1"), area.isin("0", "1"))
    context = vote(x["before"].rlike(CUES[kind]) | x["after"].rlike(CUES[kind]), x["before"].rlike(COUNTER_CUES))
    border = vote(~x["before"].rlike(r"[a-z0-9]$") & ~x["after"].rlike("^[a-z0-9]"), x["before"].rlike(r"[a-z0-9._/-]$") | x["after"].rlike("^[a-z0-9_/]"))
    return [form, listed, context, border]


def candidate(kind: str) -> Callable[[Column, Column], Column]:
    """From a match and its place to the candidate with votes and features."""
    def make(x, start):
        v = x["value"]
        ok = valid(kind, v)
        n, d = F.char_length(v), F.char_length(only_digits(v))
        # Digit strings of other lengths are no candidates for a card.
        use = d.between(13, 19) if kind == "card" else F.lit(True)
        cast = [c.cast("tinyint").alias(f"v{j}") for j, c in enumerate(votes(kind, x, ok))]
        return F.struct(F.lit(list(PATTERNS).index(kind)).alias("kind"), start.alias("start"), (start + n).alias("stop"), ok.alias("base"),
                        (use | ok).alias("use"), *cast, F.least(F.floor(n / 6), F.lit(LENGTHS - 1)).cast("int").alias("len"),
                        F.least(F.floor(d * DIGITS / n), F.lit(DIGITS - 1)).cast("int").alias("dig"),
                        F.pmod(F.xxhash64(F.lit(kind), F.regexp_extract(x["before"], LAST_WORD, 1)), F.lit(WORDS)).cast("int").alias("word"))

    return make


def label(found: DataFrame) -> DataFrame:
    """``doc_id, spans``: the place of every base span, and of every candidate
    that overlaps none, its kind, votes and features."""
    spans = [F.when(F.size(kind) > 0, F.filter(F.zip_with(kind, f"s_{kind}", candidate(kind)), lambda s: s["use"])) for kind in PATTERNS]
    placed = found.select("doc_id", *PATTERNS, *[starts(k).alias(f"s_{k}") for k in PATTERNS])
    # One array per kind, so that texts without matches cost nothing.
    d = placed.select("doc_id", F.flatten(F.array_compact(F.array(*spans))).alias("spans"))
    # What overlaps a base span is settled, and would teach the labelers base spans under another kind.
    d = d.select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    free = lambda s: s["base"] | ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    return d.select("doc_id", F.when(F.size("base") < F.size("spans"), F.filter("spans", free)).otherwise(F.col("spans")).alias("spans"))


Pattern = tuple      # kind, votes, length class, digit class and, if it is used, the place of the word before


def _varied(votes_of: dict[tuple, int]) -> int:
    """How many labelers give other than one same vote to 5 % of a kind's candidates."""
    n = sum(votes_of.values())
    return sum(max(sum(c for vs, c in votes_of.items() if vs[j] == v) for v in (-1, 0, 1)) <= 0.95 * n for j in range(VOTERS))


def estimate(counts: dict[Pattern, int], rounds: int = 40) -> tuple[dict[tuple, float], list]:
    """Expectation-maximisation over vote patterns: the posterior of each
    (kind, votes), and each labeler's chances of -1, 0, +1 by class over all
    kinds.  Within, every kind has chances of its own, drawn to ``PRIOR``, and
    a share of spans, held in ``SHARES``.  Two classes can be told apart by
    agreement only from three labelers on, so a kind where fewer vary keeps
    the prior's chances."""
    pooled: dict[tuple, int] = {}
    for (kind, vs, *_), n in counts.items():
        pooled[kind, vs] = pooled.get((kind, vs), 0) + n
    kinds = sorted({kind for kind, _ in pooled})
    chances = {k: [[list(row) for row in labeler] for labeler in PRIOR] for k in kinds}
    share = dict.fromkeys(kinds, 0.0)                        # log odds of the classes
    learned = [k for k in kinds if _varied({vs: n for (kind, vs), n in pooled.items() if kind == k}) >= 3]
    post: dict[tuple, float] = {}
    for step in range(rounds + 1):
        for kind, vs in pooled:
            odds = sum(math.log(c[1][v + 1] / c[0][v + 1]) for c, v in zip(chances[kind], vs)) + share[kind]
            post[kind, vs] = 1 / (1 + math.exp(-min(max(odds, -500), 500)))
        if step == rounds:
            break
        votes_of = {k: [[[MASS * c for c in row] for row in labeler] for labeler in PRIOR] for k in kinds}
        for (kind, vs), n in pooled.items():
            for y, w in ((0, 1 - post[kind, vs]), (1, post[kind, vs])):
                for j, v in enumerate(vs):
                    votes_of[kind][j][y][v + 1] += n * w
        for k in learned:
            chances[k] = [[[c / sum(row) for c in row] for row in labeler] for labeler in votes_of[k]]
            no, yes = (sum(votes_of[k][0][y]) for y in (0, 1))
            q = min(max(yes / (no + yes), SHARES[0]), SHARES[1])
            share[k] = math.log(q / (1 - q))
    total = [[[sum(votes_of[k][j][y][v] for k in kinds) for v in range(3)] for y in (0, 1)] for j in range(VOTERS)] if kinds else [list(map(list, x)) for x in PRIOR]
    return post, [[[c / sum(row) for c in row] for row in labeler] for labeler in total]


#: Places in the weight vector: kinds, then votes by kind and labeler, lengths and digits by kind, words.
AT_VOTES = len(PATTERNS)
AT_LENGTHS = AT_VOTES + len(PATTERNS) * VOTERS * 3
AT_DIGITS = AT_LENGTHS + len(PATTERNS) * LENGTHS
AT_WORDS = AT_DIGITS + len(PATTERNS) * DIGITS


def slots(p: Pattern) -> list[int]:
    """Places of a pattern's features in the weight vector."""
    kind, vs, length, digits, *word = p
    return [kind, *[AT_VOTES + 3 * (VOTERS * kind + j) + v + 1 for j, v in enumerate(vs)], AT_LENGTHS + LENGTHS * kind + length,
            AT_DIGITS + DIGITS * kind + digits, *[AT_WORDS + w for w in word]]


def fit_classifier(counts: dict[Pattern, int], post: dict[tuple, float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3,
                   enough: int = 200) -> list[float]:
    """Logistic regression on the posteriors.  Weights begin at the prior's
    log odds and are drawn to them.  Kinds weigh alike, however many candidates
    they have, from ``enough`` on; a rarer kind stays nearer to the prior."""
    start = np.zeros(AT_WORDS + WORDS)
    odds = [math.log(yes / no) for labeler in PRIOR for no, yes in zip(*labeler)]
    start[AT_VOTES:AT_LENGTHS] = odds * len(PATTERNS)
    if not counts:
        return start.tolist()
    some = sorted(counts)
    at = np.array([slots(p) for p in some])
    size: dict[int, int] = {}
    for p in some:
        size[p[0]] = size.get(p[0], 0) + counts[p]
    n = np.array([counts[p] / max(size[p[0]], enough) for p in some]) / len(size)
    want = np.array([post[p[0], p[1]] for p in some])
    w = start.copy()
    for _ in range(rounds):
        err = n * (1 / (1 + np.exp(-np.clip(w[at].sum(axis=1), -500, 500))) - want)
        w -= rate * (decay * (w - start) + np.bincount(at.ravel(), np.repeat(err, at.shape[1]), len(w)))
    return w.tolist()


def learn(labeled: DataFrame) -> list[float]:
    """Weights of the span classifier; at most ``MAX_PATTERNS`` counts reach the driver."""
    keys = ["kind", *[f"v{j}" for j in range(VOTERS)], "len", "dig", "word"]
    rows = labeled.select(F.explode("spans").alias("s")).groupBy(*[F.col(f"s.{k}").alias(k) for k in keys]).count().collect()
    counts = {(r["kind"], tuple(r[f"v{j}"] for j in range(VOTERS)), r["len"], r["dig"], r["word"]): r["count"] for r in rows}
    post, _ = estimate(counts)
    return fit_classifier(counts, post)


def says_yes(weights: list[float]) -> Callable[[Column], Column]:
    """The classifier as an expression on a candidate."""
    pick = lambda lo, n, at: F.element_at(F.array(*[F.lit(w) for w in weights[lo:lo + n]]), at + 1)

    def yes(s: Column) -> Column:
        odds = pick(0, len(PATTERNS), s["kind"])
        for j in range(VOTERS):
            odds = odds + pick(AT_VOTES, 3 * VOTERS * len(PATTERNS), 3 * (VOTERS * s["kind"] + j) + s[f"v{j}"].cast("int") + 1)
        odds = odds + pick(AT_LENGTHS, len(PATTERNS) * LENGTHS, LENGTHS * s["kind"] + s["len"])
        odds = odds + pick(AT_DIGITS, len(PATTERNS) * DIGITS, DIGITS * s["kind"] + s["dig"])
        odds = odds + pick(AT_WORDS, WORDS, s["word"])
        return odds >= 0

    return yes


def find_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, added)`` for every row: base spans and spans that the
    classifier adds, each ``struct<kind, start, stop>`` by kind, then start."""
    labeled = cut_lineage(label(cut_lineage(find_candidates(docs), "pii_matches")), "pii_candidates")
    yes = says_yes(learn(labeled))
    plain = lambda s: F.struct(F.least(s["kind"], F.lit(3)).alias("k"), s["start"].alias("start"), s["stop"].alias("stop"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), plain))
    rest = F.filter("spans", lambda s: ~s["base"] & yes(s))
    d = labeled.select("doc_id", F.when(F.size("spans") > 0, base).alias("base"), F.when(F.size("spans") > 0, rest).alias("rest"))
    d = d.select("doc_id", "base", F.array_sort(F.array_distinct(F.transform("rest", plain))).alias("added"))
    named = lambda c: F.transform(F.coalesce(c, F.expr("cast(array() as array<struct<k:int,start:int,stop:int>>)")), lambda s: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return d.select("doc_id", named(F.col("base")).alias("base"), named(F.col("added")).alias("added"))
