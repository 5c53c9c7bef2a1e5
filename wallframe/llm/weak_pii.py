"""Personal data by weak supervision, in DataFrame functions only.

One pass over a text gives candidate spans: matches of the base kinds, whether or not they pass
their check, and looser ones (mail addresses spelled out, digit runs and groupings, given names with
a surname).  Five labelers vote on each: checks and shapes, gazetteers, words before it, words that
speak against it, and its surroundings.  Only the counts of vote patterns (at most 3^5 per kind
of evidence) leave the cluster; expectation-maximisation over them estimates each labeler's
reliability and the share of personal spans.  The posteriors then weigh the candidates, counted by
their features, for a logistic classifier, and a span is added where that gives it half or more.

Base spans that pass their check always stay.  Failing base matches are candidates for being added
in parts: a card number inside a longer run of digits, a telephone number that ran into the next
number.  Added spans may lie inside a base span.

Positions are found without a loop: a text is split at its matches, and the lengths of pieces and
matches are summed in blocks of 256, so texts with many matches stay near linear.  Patterns start
only where a run starts, or where the last match ended, so long runs are read once.

Defined results: null and empty texts have no spans.  Repeated rows have equal results.  Without candidates
nothing is fitted and nothing added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import discard, materialize

# The base kinds in the order of the contract, then those the method adds.
KINDS = ("email", "ip", "card", "phone", "spelled", "number", "person")
EMAIL, IP, CARD, PHONE, SPELLED, NUMBER, PERSON = range(7)
BASE = 4

# Starts of a run, or right after the last match.
_LOCAL = "[A-Za-z0-9._%+-]"
_NAME = "[A-Za-z0-9-]"
EMAIL_RE = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_NAME}++(?:\.{_NAME}++)++"
IP_RE = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD_RE = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE_RE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED_RE = (
    rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?{_NAME}{{1,63}}+"
    rf"(?:(?:\x20?[(\[]\x20?(?:dot|DOT)\x20?[)\]]\x20?|\.){_NAME}{{1,63}}+)++"
)
RUN_RE = r"(?<![0-9])[0-9]{13,19}+(?![0-9])"
LOCAL_RE = r"(?<![0-9(])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
INNER_PHONE_RE = r"^(\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4})(?:[^0-9].*)?$"

# Gazetteers.  Fixed values: general and country domains, telephone country codes, card issuers, given names.
DOMAINS = "com org net edu gov mil int info biz name io dev app de fr es it nl be at ch uk ie pt pl se no dk fi cz eu us ca mx br ar cl co au nz jp cn in kr za ru tr gr"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|64|65|62)"
RESERVED = r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^169\.254\."
GIVEN_NAMES = (
    "Anna Andrea Antonio Bernd Brigitte Carlos Carmen Catherine Charles Christine Claudia Daniel David Elena Elisabeth Emma Francisco Frank "
    "François Hans Helga Isabelle James Javier Jean Jennifer Jessica Johanna John Jorge José Juan Julia Jürgen Karin Klaus Laura Linda Lucía "
    "Luis Manuel Maria María Marie Mary Michael Michel Monika Nathalie Nicolas Patricia Paul Pedro Peter Philippe Pierre Robert Sabine Sarah "
    "Sophie Stefan Susan Thomas Ursula William Wolfgang"
)
PERSON_RE = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:{'|'.join(GIVEN_NAMES.split())})\x20\p{{Lu}}\p{{Ll}}{{1,30}}+(?![\p{{L}}\p{{N}}])"

# Words before a span that speak for it, and words that speak against it.
CUES = (
    r"(?i)(?:e-?mail|mail|contact|reach|write|phone|tel|telefon|téléphone|teléfono|mobile|cell|call|fax|whatsapp|card|carte|karte|tarjeta|visa|mastercard|"
    r"amex|iban|account|konto|compte|cuenta|ip|address|adresse|dirección|host|mr|mrs|ms|dr|herr|frau|mme|monsieur|madame|señora?|name|nombre|nom|von|by|"
    r"ssn|passport)[\s.:=#()]{1,4}(?:is|ist|est|es|at|number|no|nr|addr)?[\s.:=#()]{0,3}$"
)
AGAINST = (
    r"(?i)(?:token|secret|password|passwd|api_?key|key|hash|sha-?(?:1|256)|md5|uuid|version|v|isbn|issn|doi|order|invoice|sku|serial|page|figure|table|section|"
    r"build|commit|release|row|id)[\"'\s.:=#]{1,4}$"
)
BEFORE, AFTER = 40, 20

EVIDENCE = "struct<kind:int,start:bigint,stop:bigint,ok:boolean,shape:int,gazetteer:int,cue:int,against:int,around:int,grouped:boolean>"
FEATURES = (*[f"kind{k}" for k in range(len(KINDS))], "passes", "fails", "listed", "unlisted", "cued", "countered", "free", "glued", "grouped")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array, by blocks."""

    def inner(part: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x))
        return F.aggregate(part, F.array().cast("array<bigint>"), step)

    def summed(values: Column) -> Column:
        count = F.ceil(F.size(values) / block).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: inner(F.slice(values, k * block + 1, F.lit(block))))
        return let(parts, lambda p: joined(p))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.element_at(part, -1))
        return let(inner(totals), lambda ends: F.flatten(F.transform(parts, lambda part, k: F.transform(part, lambda v: v + F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0).cast("bigint"))))))

    return let(lengths, lambda values: F.when(F.size(values) > 0, summed(values)).otherwise(F.array().cast("array<bigint>")))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value, before, after>> of the pattern's leftmost matches that do not overlap, in code points."""
    found = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def placed(f: Column) -> Column:
        steps = F.transform(f["values"], lambda v, k: (F.length(F.get(f["pieces"], k)) + F.length(v)).cast("bigint"))
        return let(prefix_sums(steps), lambda stops: F.transform(f["values"], lambda v, k: F.struct(
            (F.get(stops, k) - F.length(v)).alias("start"),
            F.get(stops, k).alias("stop"),
            v.alias("value"),
            F.right(F.get(f["pieces"], k), F.lit(BEFORE)).alias("before"),
            F.left(F.get(f["pieces"], k + 1), F.lit(AFTER)).alias("after"),
        )))

    return let(found, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    backwards = F.regexp_extract_all(F.reverse(_digits(value)), F.lit("[0-9]"), F.lit(0))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    worth = F.transform(backwards, lambda c, k: F.when(k % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def _byte(part: Column) -> Column:
    """Decimal of any length that is at most 255."""
    return let(F.ltrim(part, F.lit("0")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _vote(yes: Column, no: Column | None = None) -> Column:
    votes = F.when(yes, 1) if no is None else F.when(yes, 1).when(no, -1)
    return votes.otherwise(0)


def _listed(value: Column, names: str) -> Column:
    return value.isin(names.split())


def _country(value: Column) -> Column:
    return let(_digits(value), lambda d: _listed(F.left(d, F.lit(1)), COUNTRY_CODES) | _listed(F.left(d, F.lit(2)), COUNTRY_CODES) | F.left(d, F.lit(3)).rlike("^(?:21|22|23|24|25|26|29|35|37|38|42|50|59|67|68|80|85|88|96|97|99)"))


def _evidence(found: Column, kind: int, ok: Column, shape: Column, gazetteer: Column) -> Column:
    """Votes of the labelers on one located match."""
    return F.struct(
        F.lit(kind).alias("kind"),
        found["start"].alias("start"),
        found["stop"].alias("stop"),
        ok.alias("ok"),
        shape.alias("shape"),
        gazetteer.alias("gazetteer"),
        _vote(found["before"].rlike(CUES)).alias("cue"),
        (-_vote(found["before"].rlike(AGAINST))).alias("against"),
        _vote(
            found["before"].rlike(r"(?:^|[\s(\[<,;:])$") & found["after"].rlike(r"^(?:$|[\s)\]>,;:.!?])"),
            found["before"].rlike(r"[\p{L}\p{N}_=/\"'-]$") | found["after"].rlike(r"^[\p{L}\p{N}_=/\"'-]"),
        ).alias("around"),
        found["value"].rlike(r"[0-9][)\x20.-]+[0-9]").alias("grouped"),
    )


def _nothing() -> Column:
    return F.array().cast(f"array<{EVIDENCE}>")


def _where(useful: Column, text: Column, pattern: str, evidence: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> Column:
    """Evidence of all matches, looked for only where ``useful``."""
    found = located(text, pattern)
    if keep is not None:
        found = F.filter(found, keep)
    return F.when(useful, F.transform(found, evidence).cast(f"array<{EVIDENCE}>")).otherwise(_nothing())


def candidates(text: Column) -> Column:
    """All candidates of a text (not null): base matches first."""
    yes = F.lit(True)
    digits = text.rlike("[0-9]")

    def email(f: Column) -> Column:
        return _evidence(f, EMAIL, yes, F.lit(1), _vote(_listed(F.lower(F.substring_index(f["value"], ".", -1)), DOMAINS)))

    def ip(f: Column) -> Column:
        fits = F.forall(F.split(f["value"], r"\."), _byte)
        return _evidence(f, IP, fits, _vote(fits, ~fits), _vote(~f["value"].rlike(RESERVED) & fits, f["value"].rlike(RESERVED)))

    def card(f: Column) -> Column:
        passes, issued = luhn(f["value"]), _digits(f["value"]).rlike(ISSUERS)
        return _evidence(f, CARD, passes, _vote(passes, ~passes), _vote(issued, ~issued))

    def phone(f: Column) -> Column:
        fits = F.length(_digits(f["value"])).between(8, 15)
        return _evidence(f, PHONE, fits, _vote(fits, ~fits), _vote(_country(f["value"])))

    def spelled(f: Column) -> Column:
        ending = F.lower(F.regexp_extract(f["value"], "([A-Za-z0-9-]+)$", 1))
        return _evidence(f, SPELLED, F.lit(False), F.lit(1), _vote(_listed(ending, DOMAINS), ~_listed(ending, DOMAINS)))

    def run(f: Column) -> Column:
        passes, issued = luhn(f["value"]), f["value"].rlike(ISSUERS)
        return _evidence(f, NUMBER, F.lit(False), _vote(passes, ~passes), _vote(issued, ~issued))

    def inner_phone(f: Column) -> Column:
        value = F.regexp_extract(f["value"], INNER_PHONE_RE, 1)
        part = F.struct(
            f["start"].alias("start"), (f["start"] + F.length(value)).alias("stop"), value.alias("value"), f["before"].alias("before"),
            F.when(F.length(value) < F.length(f["value"]), F.lit(" ")).otherwise(f["after"]).alias("after"),
        )
        return let(part, lambda p: _evidence(p, NUMBER, F.lit(False), _vote(F.length(_digits(p["value"])).between(8, 15)), _vote(_country(p["value"]))))

    def local(f: Column) -> Column:
        return _evidence(f, NUMBER, F.lit(False), _vote(F.length(_digits(f["value"])) == 10), F.lit(0))

    def person(f: Column) -> Column:
        return _evidence(f, PERSON, F.lit(False), F.lit(0), F.lit(1))

    # A run that is a whole chain of 16 to 19 digits is the base's to judge if it passes.
    alone = lambda f: ~f["before"].rlike(r"[0-9][\x20-]?$") & ~f["after"].rlike(r"^[\x20-]?[0-9]")
    extra = lambda f: ~(alone(f) & (F.length(f["value"]) >= 16) & luhn(f["value"]))
    long = lambda f: ~F.length(_digits(f["value"])).between(8, 15) & f["value"].rlike(INNER_PHONE_RE)
    outside = lambda f: ~f["before"].rlike(r"\+[0-9][\x20().0-9-]*$")
    return F.concat(
        _where(text.contains("@"), text, EMAIL_RE, email),
        _where(digits & text.contains("."), text, IP_RE, ip),
        _where(text.rlike("[0-9](?:[\\x20-]?[0-9]){15}"), text, CARD_RE, card),
        _where(digits & text.contains("+"), text, PHONE_RE, phone),
        _where(text.rlike(r"(?:at|AT)\x20?[)\]]"), text, SPELLED_RE, spelled),
        _where(text.rlike("[0-9]{13}"), text, RUN_RE, run, extra),
        _where(digits & text.contains("+"), text, PHONE_RE, inner_phone, long),
        _where(digits & text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), text, LOCAL_RE, local, outside),
        _where(text.rlike(f"(?:{'|'.join(GIVEN_NAMES.split())})\\x20"), text, PERSON_RE, person),
    )


def base_spans(found: Column) -> Column:
    return F.filter(found, lambda c: (c["kind"] < BASE) & c["ok"])


def _count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == kind)).cast("bigint")


def listed(spans: Column) -> Column:
    """kind:start:end of ``spans`` by kind, then start, then end; each once."""
    keys = F.array_sort(F.array_distinct(F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(keys, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["stop"].cast("string"))), ",")


@dataclass(frozen=True)
class Reliability:
    """Share of personal spans, and per labeler the probabilities of (no, abstain, yes) for either class."""

    prior: float
    given: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior) - math.log1p(-self.prior)
        for vote, (clean, personal) in zip(votes, self.given, strict=True):
            odds += math.log(personal[vote + 1]) - math.log(clean[vote + 1])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


# What is expected of the labelers, as (no, abstain, yes) for spans that are not and that are personal:
# a failed check rules a span out, while one in four random numbers starts like an issued one.
EXPECTED = (
    ((0.60, 0.35, 0.05), (0.01, 0.30, 0.69)),
    ((0.40, 0.30, 0.30), (0.05, 0.25, 0.70)),
    ((0.10, 0.80, 0.10), (0.02, 0.58, 0.40)),
    ((0.40, 0.55, 0.05), (0.02, 0.93, 0.05)),
    ((0.40, 0.30, 0.30), (0.05, 0.25, 0.70)),
)


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 200, tolerance: float = 1e-9) -> Reliability:
    """Expectation-maximisation on counts of vote patterns.

    It starts from ``EXPECTED``.  A tenth as many pseudo-votes of that kind as there are candidates
    keep classes from being exchanged.
    """
    total = sum(counts.values())
    model = Reliability(0.5, EXPECTED)
    weight = max(1.0, 0.1 * total)
    for _ in range(rounds):
        sums = [[[p * weight for p in row] for row in pair] for pair in EXPECTED]
        personal = 0.5 * weight
        for votes, n in counts.items():
            p = model.posterior(votes)
            personal += n * p
            for k, vote in enumerate(votes):
                sums[k][0][vote + 1] += n * (1 - p)
                sums[k][1][vote + 1] += n * p
        given = tuple(tuple(tuple(x / sum(row) for x in row) for row in pair) for pair in sums)
        prior = min(max(personal / (total + weight), 1e-6), 1 - 1e-6)
        moved = abs(prior - model.prior) + sum(abs(a - b) for u, v in zip(given, model.given, strict=True) for r, s in zip(u, v, strict=True) for a, b in zip(r, s, strict=True))
        model = Reliability(prior, given)
        if moved < tolerance:
            break
    return model


VOTES = ("shape", "gazetteer", "cue", "against", "around")


def features(c: Callable[[str], Column]) -> list[Column]:
    """0/1 features of a candidate; ``c(name)`` is a field of its evidence."""
    flag = lambda condition: condition.cast("double")
    return [
        *[flag(c("kind") == k) for k in range(len(KINDS))],
        flag(c("shape") > 0),
        flag(c("shape") < 0),
        flag(c("gazetteer") > 0),
        flag(c("gazetteer") < 0),
        flag(c("cue") > 0),
        flag(c("against") < 0),
        flag(c("around") > 0),
        flag(c("around") < 0),
        flag(c("grouped")),
    ]


@dataclass(frozen=True)
class SpanModel:
    """A linear classifier of candidates, and what it was fitted from."""

    intercept: float
    weights: tuple[float, ...]
    reliability: Reliability | None

    def score(self, c: Callable[[str], Column]) -> Column:
        """Log-odds of being personal."""
        total = F.lit(self.intercept)
        for weight, value in zip(self.weights, features(c), strict=True):
            total = total + F.lit(weight) * value
        return total


def fit(found: DataFrame) -> SpanModel:
    """Fit on all candidates of ``found`` (c: array of evidence), counted by votes and features."""
    each = found.select(F.inline("c"))
    counted, some = materialize(each.groupBy("kind", "grouped", *VOTES).agg(F.count(F.lit(1)).alias("n")))
    if not some:
        return SpanModel(-1.0, (0.0,) * len(FEATURES), None)
    patterns = counted.groupBy(*VOTES).agg(F.sum("n").alias("n")).collect()
    model = reliabilities({tuple(r[v] for v in VOTES): r["n"] for r in patterns})
    by_votes = [F.struct(*[F.lit(int(r[v])).alias(v) for v in VOTES], F.lit(model.posterior(tuple(r[v] for v in VOTES))).alias("p")) for r in patterns]
    posteriors = counted.sparkSession.range(1).select(F.inline(F.array(*by_votes)))
    weighed = counted.join(posteriors, list(VOTES))
    # Counts stand for rows; weights near one keep the regularisation's meaning at any size.
    total = sum(r["n"] for r in patterns)
    scaled = F.col("n") * (10_000.0 / total)
    rows = weighed.select(*[f.alias(n) for f, n in zip(features(F.col), FEATURES, strict=True)], scaled.alias("n"), "p")
    both = rows.select("*", F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")).unionByName(
        rows.select("*", F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight"))
    )
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(both.filter("weight > 0")).select("features", "label", "weight")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, standardization=False, maxIter=200, family="binomial").fit(vectors)
    discard(counted)
    return SpanModel(float(fitted.intercept), tuple(map(float, fitted.coefficients)), model)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the candidates ``c`` of every row."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return read.select("doc_id", candidates(F.col("t")).alias("c"))


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per row of ``docs``."""
    found, _ = materialize(scan(docs, doc_id, text))
    model = fit(found)
    added = F.filter("c", lambda c: ~((c["kind"] < BASE) & c["ok"]) & (c["kind"] >= BASE) & (model.score(lambda name: c[name]) >= 0))
    split = found.select("doc_id", base_spans(F.col("c")).alias("base"), added.alias("added"))
    many = [_count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return split.select(
        "doc_id",
        *many,
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )
