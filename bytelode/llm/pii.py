"""Operator 10: personal data by weak supervision, in DataFrame functions alone.

Regular expressions propose spans. Four labelers vote on each (1, -1, or 0 for
abstention): the strict form of its kind, a gazetteer (domains, address blocks, issuer
and country prefixes, names of secrets), the words before it, and the shape of its
characters. The votes of all documents are counted by kind, pattern of votes and shape of
the span and its surroundings, which gives a bounded table. On it the driver runs
expectation maximisation for the labelers' reliabilities and fits a logistic span classifier
to the posteriors; it sees the shape, which no labeler votes on in this form, besides the
votes. The classifier, a sum of weights, is then a column expression.

Base spans (email, ip, card, phone as defined by their patterns and checks) always stay;
spans of further kinds stay where the classifier says so.

Defined results: null text is empty text (no spans; the digest of the empty string).
Repeated rows are scanned each. Other columns are ignored. Offsets count code points.
Patterns are written so that no text makes them backtrack: what may repeat is possessive,
and a run of characters is entered at its start alone.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import durable, let

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "iban", "local_phone")
LABELERS = ("form", "gazetteer", "context", "shape")
CONTEXT = 24
#: How many values each part of a span's shape has.
SHAPE = (5, 4, 4)
KEEP_AT = 0.5

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_@.+%-])(?=[0-9_-]*+[A-Za-z])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+(?!@|\.[A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+()-])(?<!\+[0-9]{1,3}[ -])(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be worth a search.
GATES = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    figures = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c: F.ascii(c) - 48)
    weighed = F.transform(figures, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(weighed, F.lit(0), lambda s, x: s + x) % 10 == 0


#: Checks that a match must pass to be a span.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "ip": lambda v: F.rlike(v, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    "card": lambda v: let(F.length(_digits(v)), lambda n: n.between(13, 19)) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}

#: Per kind and labeler: what speaks for a span, and what against; on its value or on the text before it.
VOTES = {
    "email": [(r"\.[A-Za-z]{2,}$", "", "value"), (r"(?i)\.(?:com|org|net|edu|gov|io|eu|de|fr|es|uk|info)$", r"\.(?:png|jpg|gif)$", "value"), (r"(?i)mail|contact|write|reach|kontakt|correo", "", "before"), (r"^.{6,64}$", r"^.{65,}", "value")],
    "ip": [(r"^(?:[1-9][0-9]{0,2}\.){3}[0-9]{1,3}$", "", "value"), ("", r"^(?:0|127|255)\.", "value"), (r"(?i)\bip\b|host|server|addr", r"(?i)(?:version|release|\bv)\W*$", "before"), (r"[0-9]{2,}", r"^[0-9](?:\.[0-9]){3}$", "value")],
    "card": [(r"^[3-6]", r"^0", "value"), (r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)", "", "value"), (r"(?i)card|visa|pay|karte|tarjeta|carte", r"(?i)isbn|order|serial", "before"), (r"^(?:[0-9]{15,16}|[0-9]{4}(?:[ -][0-9]{4}){3})$", r"^([0-9])\1*$", "value")],
    "phone": [(r"^\+[1-9]", r"^\+0", "value"), (r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", "", "value"), (r"(?i)tel|phone|call|fax|mobil|ruf", "", "before"), (r"[ ().-]", "", "value")],
    "secret": [(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z]).{24,})$", r"^[a-z]+(?:[-_][a-z0-9]+)+$", "value"), (r"(?i)token|secret|api.?key|passw|\bkey|auth|credential", "", "before"), (r"[=:]\s*[\"']?$", r"[/\\#]$", "before"), (r"(?:[A-Za-z]+[0-9]+){3}", r"(.)\1{7}", "value")],
    "ssn": [("", r"^(?:000|666|9)|-00-|-0000$", "value"), ("", r"^(?:123-45-6789|078-05-1120)$", "value"), (r"(?i)ssn|social", r"(?i)isbn|part|order|no\.? ?$", "before"), ("", r"^([0-9])\1", "value")],
    "iban": [(r"^[A-Z]{2}[0-9]{2}[ A-Z0-9]{11,}$", "", "value"), (r"^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE|LU|PL)", "", "value"), (r"(?i)iban|account|konto|cuenta|compte", "", "before"), (r"[0-9]{8}|(?:[0-9]{4} ){2}", r"[A-Z]{6}", "value")],
    "local_phone": [(r"^\(?[2-9]", r"^\(?[01]", "value"), (r"555[.-]", "", "value"), (r"(?i)tel|phone|call|fax|mobil|ruf", r"(?i)isbn|order|part", "before"), (r"^\(", "", "value")],
}


def _scan(values: Column, join: Callable[[Column, Column], Column], block: int = 512) -> Column:
    """Inclusive running joins (sums, greatest) of numbers from 0 up, block by block so that no long array is copied for every element."""
    zero, none = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def last(xs: Column) -> Column:
        return F.coalesce(F.try_element_at(xs, F.lit(-1)), none)

    def run(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, x: F.concat(a, F.array(join(last(a), x))))

    def parts(v: Column) -> Column:
        count = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int"))
        return F.transform(F.sequence(F.lit(0), count), lambda b: run(F.slice(v, b * block + 1, F.lit(block))))

    def joined(p: Column) -> Column:
        before = let(run(F.transform(p, last)), lambda t: F.concat(F.array(none), t))
        return F.flatten(F.zip_with(p, F.slice(before, F.lit(1), F.size(p)), lambda x, o: F.transform(x, lambda v: join(v, o))))

    return let(values, lambda v: let(parts(v), joined))


def _shape(value: Column, before: Column) -> Column:
    """What the span classifier sees besides the votes: steps of the length, of the share of digits, and the kind of character before."""
    n = F.length(value)
    share = F.length(_digits(value)) / n
    length = F.when(n < 8, 0).when(n < 13, 1).when(n < 20, 2).when(n < 32, 3).otherwise(4)
    digits = F.when(share == 0, 0).when(share < 0.34, 1).when(share < 0.8, 2).otherwise(3)
    edge = F.when(before == "", 0).when(F.rlike(before, F.lit(r"[\p{L}\p{N}]$")), 1).when(F.rlike(before, F.lit(r"\s$")), 2).otherwise(3)
    return F.array(length, digits, edge)


def _spans(text: Column, kind: str) -> Column:
    """All spans of a kind: (start, end, votes, shape), from the pieces between matches and the matches themselves.

    Nothing is looked up in the whole text for a single span, so the work grows with the text alone.
    """
    pattern = F.lit(PATTERNS[kind])
    end_of = lambda x: F.right(x, F.lit(CONTEXT))

    def placed(matches: Column, gaps: Column) -> Column:
        ends = _scan(F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.length(m)).cast("bigint")), lambda a, x: a + x)
        ended = F.zip_with(matches, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        earlier = F.slice(F.concat(F.array(F.lit("")), matches), F.lit(1), F.size(matches))
        before = F.zip_with(earlier, gaps, lambda m, g: end_of(F.concat(end_of(m), end_of(g))))
        return F.zip_with(ended, before, lambda s, b: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), b.alias("before")))

    def judged(s: Column) -> Column:
        each = []
        for good, bad, where in VOTES[kind]:
            on, vote = s[where], F.lit(0)
            if good:
                vote = F.when(F.rlike(on, F.lit(good)), 1).otherwise(vote)
            if bad:
                vote = F.when(F.rlike(on, F.lit(bad)), -1).otherwise(vote)
            each.append(vote)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*each).alias("votes"), _shape(s["value"], s["before"]).alias("shape"))

    check = CHECKS.get(kind)
    none = F.array().cast("array<struct<start:bigint,end:bigint,votes:array<int>,shape:array<int>>>")

    def found(matches: Column) -> Column:
        spans = let(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda gaps: placed(matches, gaps))
        return F.transform(F.filter(spans, lambda s: check(s["value"])) if check else spans, judged)

    some = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(found(m)))
    gate = F.contains(text, F.lit(GATES[kind])) if kind in GATES else F.lit(True)
    if kind not in ("email",):
        gate = gate & F.rlike(text, F.lit("[0-9]"))
    return F.when(gate, some).otherwise(none)


def candidates(docs: DataFrame, *kept: str) -> DataFrame:
    """doc_id, the named columns, and one array of spans (start, end, votes) for each kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *kept)
    return rows.select("doc_id", *kept, *["text"] * ("text" not in kept), *[_spans(F.col("text"), k).alias(k) for k in KINDS])


def patterns(found: DataFrame) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """(kind, votes, shape, number of spans): at most len(KINDS) * 3^4 * 80 rows, whatever the input."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["votes"].alias("votes"), s["shape"].alias("shape")))

    named = F.flatten(F.array(*map(of, KINDS)))
    counted = found.select(F.explode(named).alias("s")).groupBy("s.kind", "s.votes", "s.shape").count()
    return sorted((r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in counted.collect())


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def reliabilities(counted: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> list[float]:
    """Expectation maximisation: the posterior that the spans of each pattern are personal data.

    Each labeler has a distribution of votes on true and on false spans; each kind has a
    rate of true ones. It starts from the sign of the summed votes.
    """
    posterior = [_sigmoid(1.5 * sum(v)) for _, v, _ in counted]
    for _ in range(rounds):
        rate: dict[str, float] = {}
        for kind in KINDS:
            own = [(p, n) for p, (k, _, n) in zip(posterior, counted) if k == kind]
            rate[kind] = (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)
        chance: dict[tuple[int, int, bool], float] = {}
        for j, vote in itertools.product(range(len(LABELERS)), (-1, 0, 1)):
            for true in (True, False):
                weight = [(p if true else 1 - p) * n for p, (_, _, n) in zip(posterior, counted)]
                # A labeler is taken to be right more often than not, lightly.
                prior = 2.0 if (vote > 0) == true and vote else 1.0
                chance[j, vote, true] = (sum(w for w, (_, v, _) in zip(weight, counted) if v[j] == vote) + prior) / (sum(weight) + 4.0)
        for i, (kind, votes, _) in enumerate(counted):
            z = math.log(rate[kind] / (1 - rate[kind]))
            z += sum(math.log(chance[j, v, True] / chance[j, v, False]) for j, v in enumerate(votes))
            posterior[i] = _sigmoid(z)
    return posterior


def _columns(kind: str, votes: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    """A span as the classifier sees it: its kind, its votes, and its shape within its kind."""
    out = [float(k == kind) for k in KINDS] + [float(v) for v in votes]
    for k in KINDS:
        for value, steps in zip(shape, SHAPE):
            out += [float(k == kind and value == step) for step in range(steps)]
    return out


def span_classifier(counted: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 30, ridge: float = 0.02) -> np.ndarray:
    """Logistic weights (see `_columns`) fitted to the posteriors that the labelers' reliabilities give.

    Each kind weighs the same, within it each pattern by the root of its spans. Votes are drawn to a weight of 1, all else to 0.
    """
    votes: Counter = Counter()
    for kind, vote, _, n in counted:
        votes[kind, vote] += n
    told = [(*key, n) for key, n in sorted(votes.items())]
    posterior = {key[:2]: p for key, p in zip(told, reliabilities(told))}
    prior = np.array([0.0] * len(KINDS) + [1.0] * len(LABELERS) + [0.0] * (len(KINDS) * sum(SHAPE)))
    weight = prior.copy()
    if not counted:
        return weight
    x = np.array([_columns(k, v, s) for k, v, s, _ in counted])
    target = np.array([posterior[k, v] for k, v, _, _ in counted])
    share = np.sqrt([n for *_, n in counted])
    kinds = np.array([KINDS.index(k) for k, *_ in counted])
    share /= np.bincount(kinds, share, len(KINDS))[kinds]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (share * (p - target)) + ridge * (weight - prior)
        weight -= np.linalg.solve((x * (share * (p * (1 - p) + 1e-3))[:, None]).T @ x + ridge * np.eye(len(weight)), slope)
    return weight


def believed(kind: str, weight: np.ndarray) -> Column:
    """The spans of a kind that stay."""
    if kind in BASE:
        return F.col(kind)
    k, at = KINDS.index(kind), len(KINDS) + len(LABELERS)
    own = weight[at + k * sum(SHAPE) : at + (k + 1) * sum(SHAPE)].tolist()
    steps = [own[sum(SHAPE[:i]) : sum(SHAPE[: i + 1])] for i in range(len(SHAPE))]

    def score(s: Column) -> Column:
        out = F.lit(float(weight[k]))
        for j in range(len(LABELERS)):
            out = out + F.lit(float(weight[len(KINDS) + j])) * s["votes"][j]
        for i, values in enumerate(steps):
            out = out + F.element_at(F.array(*map(F.lit, values)), s["shape"][i] + 1)
        return out

    return F.filter(kind, lambda s: score(s) >= math.log(KEEP_AT / (1 - KEEP_AT)))


def _listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    found = durable(candidates(docs).drop("text"))
    model = span_classifier(patterns(found))
    base = F.array_join(F.concat(*[_listed(F.col(k), k) for k in BASE]), ",")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.concat(*[_listed(believed(k, model), k) for k in KINDS]), ",").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span of text replaced by its kind in brackets; all columns stay, n_chars follows the text."""
    model = span_classifier(patterns(durable(candidates(docs).drop("text"))))
    own = {c: f"kept_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in own.items()])

    def named(kind: str) -> Column:
        return F.transform(believed(kind, model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("name")))

    # Offsets count code points; in UTF-32 they are places of bytes, so no span costs a walk through the text.
    mark = F.unhex(F.lit("0000FEFF"))  # read as the byte order, so that a mark in the text stays
    cut = lambda wide, at, n: F.decode(F.concat(mark, F.substring(wide, (4 * at + 1).cast("int"), (4 * n).cast("int"))), "UTF-32")

    def replaced(every: Column, wide: Column) -> Column:
        # Spans that begin within an earlier one add nothing of their own: their rest is cut with it.
        def pieces(reach: Column) -> Column:
            before = F.slice(F.concat(F.array(F.lit(0).cast("bigint")), reach), F.lit(1), F.size(every))
            parts = F.zip_with(every, before, lambda s, r: F.when(s["start"] >= r, F.concat(cut(wide, r, s["start"] - r), s["name"])).otherwise(""))
            last = F.element_at(reach, -1)
            return F.concat(F.array_join(parts, ""), cut(wide, last, F.octet_length(wide) / 4 - last))

        return let(_scan(F.transform(every, lambda s: s["end"]), F.greatest), pieces)

    every = F.array_sort(F.concat(*map(named, KINDS)))
    rows = candidates(rows, *own.values())
    rows = rows.withColumn("clean", let(every, lambda e: F.when(F.size(e) == 0, F.col("text")).otherwise(let(F.encode("text", "UTF-32"), lambda w: replaced(e, w)))))
    out = []
    for c, n in own.items():
        kind = docs.schema[c].dataType
        out.append((F.when(F.col(n).isNotNull(), F.col("clean")) if c == "text" else F.when(F.col(own["text"]).isNull(), F.col(n)).otherwise(F.length("clean")).cast(kind) if c == "n_chars" else F.col(n)).alias(c))
    return rows.select(*out)
