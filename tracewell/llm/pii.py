"""Personal data by weak supervision, in DataFrame operations only.

Candidates come from patterns, per kind. Three labelers vote +1, -1 or 0 (abstain) on each candidate: the regex
labeler (strict form), the gazetteer labeler (known prefixes, domains, countries, first names) and the context labeler
(telling words before the candidate, word characters at its edges). Expectation-maximisation over the counts of vote
patterns (kinds x 27 rows at most, whatever the corpus) estimates the prior of each kind and each labeler's
reliability per kind. A logistic span classifier is then trained on the soft labels and applied in SQL. Besides kind
and votes it sees the span itself (its length, its separators, how many different characters it has) and what stands
around it (whether a word of its own kind is near, what follows it), each as a small number, so that at most
kinds x 27 x 216 counts reach the driver.

Base spans (email, ip, card, phone) are kept whatever the classifier says; the classifier adds spans of these and
further kinds (local phone numbers, US social security numbers, IBANs, names, secrets such as keys and passwords).

Null and empty texts have no spans. Offsets count code points. Everything is per row, so repeated rows and null ids do
no harm; extra columns are left out by ``find_spans`` and kept by ``redact``. Without candidates no model is needed.
The work on a text grows with its length and its number of matches, not with the square of the latter.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

BASE_KINDS = ["email", "ip", "card", "phone"]
#: stands around matches; in texts it is first replaced by another private character of the same length
_MARK = ""
_SPARE = ""
#: code points before a candidate in which context words count
CONTEXT = 40

# Candidate patterns. Look-behinds and possessive loops keep long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": r"(?<=(?:[Mm]y name is|[Nn]ame:|Mr\.|Mrs\.|Ms\.|Dr\.) )[A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?",
    "secret": r"""(?i)(?<![0-9A-Za-z_])(?:(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd)["']?\s{0,3}[:=]\s{0,3}["']?[^\s"',;]{8,200}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)""",
}
# What a text must hold to be searched for a kind at all.
TELLS = {"email": "@", "phone": "+", "name": "name|Mr\\.|Mrs\\.|Ms\\.|Dr\\.", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "local": "[0-9]{3}[ .-][0-9]{4}", "ssn": "-[0-9]{2}-", "iban": "[A-Z]{2}[0-9]{2}", "secret": "(?i)[a-z][\"']?\\s{0,3}[:=]|AKIA|gh[pousr]_|PRIVATE KEY"}
# Strict forms of the further kinds, gazetteers and context words.
STRICT = {
    "local": r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}",
    "name": r"^[A-Z][a-z]+ [A-Z][a-z]+$",
    "secret": r"(?i)([:=]\s*[\"']?(?=[^\s]*[0-9])[0-9a-z+/_.=-]{16,}$|^AKIA|^gh|^-----)",
}
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|mil|int|io|info|biz|dev|app|de|fr|es|uk|eu|us|it|nl|ch|at|be|dk|fi|no|se|pl|pt|cz|ie|lu|gr|hu|ro|ru|ua|tr|jp|cn|in|kr|br|mx|ar|cl|co|ca|au|nz|za)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(4|5[0-8]|2[2-7]|3[0-9]|6[0-9])",
    "phone": r"^\+ ?\(?(1|2[07]|2[1-9][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-3]|5[1-8]|50[0-9]|59[0-9]|6[0-6]|6[7-9][0-9]|7|8[1246]|8[58][0-9]|9[0-58]|9[679][0-9])",
    "local": r"^\(?(2|3|4|5|6|7|8|9)",
    "ssn": r"^[0-8]",
    "iban": r"^(AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|LY|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|ST|SV|TL|TN|TR|UA|VA|VG|XK)",
    "name": r"^(Adam|Alan|Albert|Alex|Alexander|Alice|Amanda|Amy|Ana|Andrea|Andrew|Angela|Ann|Anna|Anne|Anthony|Antonio|Barbara|Ben|Benjamin|Brian|Carl|Carlos|Carol|Catherine|Charles|Charlotte|Chris|Christian|Christine|Claire|Daniel|David|Deborah|Diego|Donald|Edward|Elena|Elizabeth|Emily|Emma|Eric|Erik|Eva|Felix|Fernando|Francis|Francisco|Frank|Gary|George|Grace|Hannah|Hans|Heinz|Helen|Henry|Ines|Isabel|Jack|Jacob|James|Jan|Jane|Jason|Javier|Jean|Jeff|Jennifer|Jessica|Joan|Johanna|John|Jonathan|Jorge|Jose|Joseph|Juan|Julia|Julie|Karen|Karl|Kate|Katherine|Kevin|Klaus|Laura|Lena|Leon|Linda|Lisa|Louis|Lucas|Lucia|Luis|Manuel|Marco|Margaret|Maria|Marie|Mario|Mark|Markus|Marta|Martin|Mary|Matthew|Max|Michael|Michel|Miguel|Monica|Nancy|Nicolas|Nicole|Nina|Oliver|Olivia|Oscar|Patricia|Patrick|Paul|Paula|Pedro|Peter|Philip|Pierre|Rachel|Rebecca|Richard|Robert|Roger|Rosa|Ryan|Samuel|Sandra|Sara|Sarah|Scott|Sebastian|Simon|Sofia|Sophie|Stefan|Stephen|Steven|Susan|Teresa|Thomas|Tim|Tom|Ursula|Victor|Victoria|Walter|William|Wolfgang)\b",
    "secret": r"(?i)(^(AKIA|gh[pousr]_|-----BEGIN)|[\"']?(sk|pk|xox[bp]|eyJ)[-_][0-9A-Za-z]|[:=]\s*[\"']?([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$)",
}
# Words near a candidate that name its own kind.
OWN_WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write to|reach)\b", "ip": r"(?i)\b(ip|host|server|address|login|from)\b", "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|whatsapp)\b", "local": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax)\b", "ssn": r"(?i)\b(ssn|social security)\b",
    "iban": r"(?i)\b(iban|account|bank|transfer)\b", "name": r"(?i)\bname\b", "secret": r"(?i)\b(export|config|env|auth|header|bearer)\b",
}
CONTEXT_FOR = r"(?i)\b(e-?mail|mail|contact|reach|write to|phone|tel|call|mobile|fax|ip|address|host|server|login|card|visa|mastercard|credit|payment|ssn|social security|iban|account|name)\b[^\n]{0,20}$"
CONTEXT_AGAINST = r"(?i)(\b(version|isbn|issn|sku|order|invoice|page|pages|chapter|figure|table|build|release|rfc|id|no)\b[ .:#]{0,3}|[A-Za-z0-9_./#=-])$"

#: features of a span besides its kind and votes, each from 0 to one less than its number
FEATURES = {"length": 4, "marks": 3, "spread": 3, "own": 2, "after": 3}
_SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean,regex:int,gazetteer:int,context:int,length:int,marks:int,spread:int,own:int,after:int>"
#: numbers that are added up at once in running sums
RUN = 64


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _before(values: Column, combine) -> Column:
    """For each of an array of longs what ``combine`` makes of those before it (0 for the first), in runs of ``RUN``."""

    def fold(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), combine)

    def with_runs(x: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int"))
        runs = F.transform(steps, lambda k: fold(F.slice(x, k * RUN + 1, RUN)))
        return _let(runs, lambda r: _let(F.transform(steps, lambda k: fold(F.slice(r, F.lit(1), k))), lambda upto: within(x, upto)))

    def within(x: Column, upto: Column) -> Column:
        return F.transform(x, lambda _, i: combine(F.element_at(upto, F.floor(i / RUN).cast("int") + 1), fold(F.slice(x, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN))))

    return F.when(F.size(values) > 0, _let(values, with_runs)).otherwise(F.array().cast("array<bigint>"))


def _matches(text: Column, kind: str) -> Column:
    """(start, end, value, before, after) of the leftmost non-overlapping matches: the parts between marks."""
    marked = F.split(F.regexp_replace(text, PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK, -1)

    def of(parts: Column) -> Column:
        starts = _before(F.transform(parts, lambda p: F.length(p).cast("long")), lambda a, b: a + b)
        return F.when(F.size(parts) > 2, _let(starts, lambda at: F.transform(F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2)), lambda i: match(parts, at, i)))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"))

    def match(parts: Column, at: Column, i: Column) -> Column:
        return F.struct(F.element_at(at, i).alias("start"), F.element_at(at, i + 1).alias("end"), F.element_at(parts, i).alias("value"), F.right(F.element_at(parts, i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.element_at(parts, i + 1), F.lit(CONTEXT)).alias("after"))

    return _let(marked, of)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _valid(kind: str, value: Column) -> Column:
    """The base check of a kind, or the strict form of a further one."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return value.rlike(STRICT[kind])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _label(kind: str):
    """The named kind, base flag and the three votes of a match; ``local`` numbers are phones that the base misses."""

    def of(m: Column) -> Column:
        valid = _valid(kind, m.value)
        known = m.value.rlike(GAZETTEER[kind])
        return F.struct(
            F.lit("phone" if kind == "local" else kind).alias("kind"), m.start.alias("start"), m.end.alias("end"),
            (valid if kind in BASE_KINDS else F.lit(False)).alias("base"), _vote(valid, ~valid).alias("regex"),
            _vote(known, ~known if kind in ("card", "iban", "ip", "secret") else F.lit(False)).alias("gazetteer"),
            _vote(m.before.rlike(CONTEXT_FOR), m.before.rlike(CONTEXT_AGAINST)).alias("context"),
            F.when(F.length(m.value) < 12, 0).when(F.length(m.value) < 20, 1).when(F.length(m.value) < 40, 2).otherwise(3).alias("length"),
            F.least(F.lit(2), F.size(F.array_distinct(F.regexp_extract_all(m.value, F.lit("[^0-9A-Za-z]"), F.lit(0))))).alias("marks"),
            F.least(F.lit(2), F.floor(F.size(F.array_distinct(F.split(m.value, ""))) / 5)).cast("int").alias("spread"),
            (m.before.rlike(OWN_WORDS[kind]) | m.after.rlike(OWN_WORDS[kind])).cast("int").alias("own"),
            F.when(m.after.rlike(r"^[0-9A-Za-z]"), 0).when(m.after.rlike(r"^[./#=_@-][0-9A-Za-z]"), 1).otherwise(2).alias("after"),
        ).cast(_SPAN)

    return of


def candidates(text: Column) -> Column:
    """All candidates of a text with their votes. Digit runs of fewer than 12 digits are no card candidates."""
    text = F.coalesce(F.translate(text, _MARK, _SPARE), F.lit(""))
    found = []
    for kind in PATTERNS:
        tell = text.contains(TELLS[kind]) if kind in ("email", "phone") else text.rlike(TELLS[kind])
        matches = _matches(text, kind)
        if kind == "card":
            matches = F.filter(matches, lambda m: F.length(_digits(m.value)) >= 12)
        found.append(F.when(tell, F.transform(matches, _label(kind))).otherwise(F.array().cast(f"array<{_SPAN}>")))
    return F.concat(*found)


KINDS = [*BASE_KINDS, "ssn", "iban", "name", "secret"]
LABELERS = ["regex", "gazetteer", "context"]


def fit(counts: list[tuple], rounds: int = 50) -> tuple[dict, list[float]]:
    """counts: (kind, regex, gazetteer, context, n), with the features of ``FEATURES`` before n where there are any.
    Reliabilities by EM, then the weights of the span classifier.

    Reliability: P(vote | true), P(vote | false) of each labeler, over all kinds. Weights: those of ``inputs``.
    """
    if not counts:
        return {}, [0.0] * len(inputs(KINDS[0], (0, 0, 0), ()))
    votes = (-1, 0, 1)
    patterns: dict = defaultdict(int)
    for c in counts:
        patterns[c[:4]] += c[-1]
    soft = {c: 0.5 + 0.15 * sum(c[1:]) for c in patterns}
    table: dict = {}
    for _ in range(rounds):
        prior = {}
        for kind in {c[0] for c in patterns}:
            yes = sum(n * soft[c] for c, n in patterns.items() if c[0] == kind)
            prior[kind] = (yes + 1) / (sum(n for c, n in patterns.items() if c[0] == kind) + 2)
        for j, labeler in enumerate(LABELERS):
            for truth in (True, False):
                mass = {v: 1.0 + sum(n * (soft[c] if truth else 1 - soft[c]) for c, n in patterns.items() if c[1 + j] == v) for v in votes}
                table[labeler, truth] = {v: m / sum(mass.values()) for v, m in mass.items()}
        for c in patterns:
            odds = math.log(prior[c[0]] / (1 - prior[c[0]])) + sum(math.log(table[x, True][c[1 + j]] / table[x, False][c[1 + j]]) for j, x in enumerate(LABELERS))
            soft[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    x = np.array([inputs(c[0], c[1:4], c[4:-1]) for c in counts])
    y, n = np.array([soft[c[:4]] for c in counts]), np.array([c[-1] for c in counts], float)
    weights = np.zeros(x.shape[1])
    for _ in range(3000):
        p = 1 / (1 + np.exp(-x @ weights))
        weights += 1.0 * (x.T @ (n / n.sum() * (y - p)) - 0.001 * weights)
    return table, weights.tolist()


def inputs(kind: str, votes: tuple, features: tuple) -> list[float]:
    """The classifier's inputs: one for each kind, one for each value of each feature, the votes."""
    return [*(float(k == kind) for k in KINDS), *(float(features[j] == v) if features else 0.0 for j, m in enumerate(FEATURES.values()) for v in range(m)), *map(float, votes)]


def train(labelled: DataFrame) -> list[float]:
    """labelled: a column ``found`` of candidates. Only counts of votes and features reach the driver."""
    columns = ["kind", *LABELERS, *FEATURES]
    spans = labelled.select(F.explode("found").alias("s")).groupBy(*[f"s.{c}" for c in columns]).agg(F.count("*").alias("n"))
    return fit(sorted(tuple(r) for r in spans.collect()))[1]


def _accepted(weights: list[float]):
    """Whether a candidate is a span: a base one, or one that the classifier takes."""
    each = dict(zip(KINDS, weights))

    def of(s: Column) -> Column:
        terms = [F.when(s.kind == k, w).otherwise(0.0) for k, w in each.items()] + [s[x] * w for x, w in zip(LABELERS, weights[-len(LABELERS) :])]
        first = len(KINDS)
        for name, m in FEATURES.items():
            terms.append(F.element_at(F.array(*map(F.lit, weights[first : first + m])), s[name] + 1))
            first += m
        return s.base | (reduce(lambda a, b: a + b, terms) > 0)

    return of


def _of_kind(kind: str):
    return lambda s: s.kind == kind


def _ordered(spans: Column) -> Column:
    """kind:start:end of each distinct span, by start, then kind as listed."""
    rank = lambda s: F.array_position(F.lit(KINDS), s.kind)
    keyed = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s.start.alias("start"), rank(s).alias("rank"), s.end.alias("end"), s.kind.alias("kind")))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    found = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(F.col("text")).alias("found")), "pii")
    weights = train(found)
    base = F.filter("found", lambda s: s.base)
    every = F.filter("found", _accepted(weights))
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    spans = found.select("doc_id", *counts, F.sha2(_ordered(base), 256).alias("base_sha256"), _ordered(every).alias("spans"))
    return spans.withColumn("n_spans", F.regexp_count("spans", F.lit("[0-9](,|$)")).cast("long"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; n_chars, where it is a column, follows the text.

    Of overlapping spans the first is named and all are replaced. Columns travel in a struct, so none can clash.
    """
    labelled = materialize(docs.select(candidates(F.col("text")).alias("found")).where(F.size("found") > 0), "pii")
    weights = train(labelled)
    release(labelled)
    spans = F.array_sort(F.transform(F.filter(candidates(F.col("text")), _accepted(weights)), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    text = F.col("row.text")
    cut = lambda a, n: F.substring(text, (a + 1).cast("int"), F.greatest(F.lit(0), n).cast("int"))

    def put(found: Column) -> Column:
        covered = _before(F.transform(found, lambda s: s.end), lambda a, b: F.greatest(a, b))
        parts = _let(covered, lambda upto: F.transform(found, lambda s, i: F.when(s.start >= F.element_at(upto, i + 1), F.concat(cut(F.element_at(upto, i + 1), s.start - F.element_at(upto, i + 1)), F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(F.lit(""))))
        last = F.array_max(F.transform(found, lambda s: s.end))
        return F.concat(F.array_join(parts, ""), cut(last, F.length(text)))

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), spans.alias("found"))
    clean = F.when(F.size("found") > 0, _let(F.col("found"), put)).otherwise(text)
    out = held.select(F.col("row").withField("text", clean).alias("row")).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
