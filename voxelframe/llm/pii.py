"""Personal data by weak supervision (operator 1), in DataFrame functions only.

Regular expressions find base spans, which always stand, and candidates: what
the base patterns matched but their checks refused, names set equal to values,
long mixed tokens, numbers in groups, capitalised names. Labelers (shape,
gazetteer, context before and after, check) vote on every candidate, for it,
against it or not at all, and each is wrong at times; expectation-maximisation
estimates how reliable each labeler is without any labels, and a final logistic
span classifier is trained on the resulting probabilities. It decides which
candidates beyond the base become spans.

All text work is native columns. What reaches the driver are counts of vote and
feature patterns, whose number is bounded by the labelers, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import saved

#: Base patterns. Possessive where the plain form could not match otherwise, and tied to the start of a run of its
#: characters where the plain form starts there anyway: same matches, linear time and no recursion on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Candidates beyond the base: a name set equal to a value (a credential?), a long token of letters and digits that stands
#: alone, digits (in groups), and capitalised words in a row.
SECRET = r"(?<![A-Za-z0-9_])\"?[A-Za-z][A-Za-z0-9_-]*+\"?\x20?[=:]\x20?\"?[A-Za-z0-9+/_.-]{4,}+\"?"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?<![=:])(?<![=:]\x20)(?<![=:]\")(?<![=:]\x20\")(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+"
NUMBER = r"(?<![0-9A-Za-z.+])\(?[0-9]++\)?(?:[\x20./-][0-9]++)*+"
NAME = r"(?<![\p{L}\p{N}_])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20)?+\p{Lu}\p{Ll}++(?:[\x20-]\p{Lu}\p{Ll}++)++"
EXTRA = ("secret", "token", "number", "name")
KINDS = (*BASE, *EXTRA)
LEAST_DIGITS = 6  # of a number that is a candidate

#: Gazetteers.
PROVIDERS = r"(?i)(?:gmail|yahoo|hotmail|outlook|icloud|proton|gmx|web|mail[0-9]*|aol|live)\.|\.(?:com|org|net|edu|gov|io|de|fr|es|uk|it|nl|ch|at|eu|us|ca|au|in|jp|br)$"
RESERVED = r"^(?:0|10|127|255)\.|^192\.168\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^169\.254\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
STRONG_KEYS = r"(?i)^\"?[a-z0-9_-]*(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|pin|ssn|iban)[a-z0-9_-]*\"?\x20?[=:]"
PLAIN_KEYS = r"(?i)^\"?(?:colou?r|width|height|size|style|class|type|version|note|https?|ftp|lang|language|page|chapter|figure|table|date|time|title|author|source|url|href|src|id|name|value|example|see|fig|doi|isbn)\"?\x20?[=:]"
KEY_MARKS = r"^(?:sk-|pk-|ghp_|gho_|AKIA|ASIA|xox[a-z]-|eyJ|glpat-)"
YEARS = r"^\(?(?:1[5-9]|20)[0-9]{2}(?![0-9])|[^0-9](?:1[5-9]|20)[0-9]{2}$"
GIVEN = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Peter George Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Anna Maria Laura Julia Hans Karl Klaus Anna Petra Pierre Jean Marie Claire Carlos Juan Luis Jose Carmen Ana"
FAMILY = "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Taylor Moore Jackson Martin Lee Perez Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner Parker Collins Schmidt Schneider Fischer Weber Meyer Wagner Becker Dupont Durand Dubois Moreau Sanchez Fernandez"
NOT_PEOPLE = "The This That These License Licence Version Copyright University Institute College School Street Road Avenue Park River Lake Mount Bank Software Foundation Company Corporation Inc Ltd Group House Church Museum Hotel New North South East West United States Kingdom Republic London Paris Berlin Madrid Rome Vienna Zurich Boston Chicago Texas California Europe America Africa Asia January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday General Public Terms Service Section Chapter Table Figure"

CONTEXT = r"(?i)(?:call|phone|tel|fax|mobile|contact|mail|email|e-mail|account|card|visa|iban|server|host|login|user|key|credential|ssn|passport|name|named|dear|regards|sincerely|signed)[^A-Za-z0-9]{0,3}(?:[A-Za-z]{1,8}[^A-Za-z0-9]{1,3}){0,2}$"
NEUTRAL = r"(?i)(?:version|page|chapter|section|figure|table|isbn|issn|year|vol|no|dated?|since|until|under the|the)\.?\x20?$"
UNITS = r"(?i)^\x20?(?:%|[a-z]|kg|km|cm|mm|usd|eur|gbp|\u20ac|\$|pages?|years?|times|million|billion|percent|license|university|street)"
AROUND = 32  # code points before and after a candidate that the context labelers read, up to the candidates next to it

VOTES = ("shape", "gazetteer", "context", "after", "check")
FEATURES = ("size", "numeric", "mixed")
PATTERN = ("kind", *VOTES, *FEATURES)
EM_ROUNDS = 100
ACCEPT = 0.5
PLACE = "struct<start:int,rank:int,end:int,kind:string>"


def _any_word(words: str) -> str:
    return r"(?:^|[\x20-])(?:" + "|".join(dict.fromkeys(words.split())) + r")(?:$|[\x20-])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative function over an array of INTs that are not negative, the own element included.

    Arrays can only grow by being copied, so a plain loop takes quadratic time.
    Here blocks of about the cube root of the length are done one by one, and
    each takes over the result of those before it.
    """
    number = lambda x: x.cast("int")

    def loop(items: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            v = number(combine(acc["last"], x))
            return F.struct(v.alias("last"), F.concat(acc["out"], F.array(v)).alias("out"))

        return F.aggregate(items, F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        width = F.greatest(number(F.ceil(F.cbrt(F.size(v)))), F.lit(1))
        done = F.transform(F.sequence(F.lit(0), F.size(v), width), lambda first: loop(F.slice(v, first + 1, width)))  # the last may be empty
        return let(done, joined)

    def joined(done: Column) -> Column:
        ends = loop(F.transform(done, lambda b: F.coalesce(F.get(b, F.size(b) - 1), F.lit(0))))
        return let(ends, lambda e: F.flatten(F.transform(done, lambda b, k: F.transform(b, lambda x: number(combine(F.coalesce(F.get(e, k - 1), F.lit(0)), x))))))

    return let(values, blocks)


def _placed(raw: Column) -> Column:
    """Of ``(rank, found, gaps)`` (matches of one pattern, and the text around them) the matches with their places. Nearly linear."""
    found, gaps = raw["found"], raw["gaps"]
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.length(g) + F.length(m))

    def with_ends(ends: Column) -> Column:
        def one(m: Column, k: Column) -> Column:
            end, before, after = F.get(ends, k), F.substring(F.get(gaps, k), -AROUND, AROUND), F.substring(F.get(gaps, k + 1), 1, AROUND)
            return F.struct((end - F.length(m)).alias("start"), raw["rank"].alias("rank"), end.alias("end"), m.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(found, one)

    return let(running(steps, lambda x, y: x + y), with_ends)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of the text pass the Luhn check."""
    d = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.substring(d, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)),
    )
    return total % 10 == 0


def _good_ip(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return ~F.exists(bare, lambda p: (F.length(p) > 3) | (F.substring(p, 1, 3).cast("int") > 255))


def _vote(*rules: tuple[Column, int], otherwise: int = 0) -> Column:
    """The first rule that holds decides."""
    out = None
    for when, vote in rules:
        out = F.when(when, vote) if out is None else out.when(when, vote)
    return (F.lit(otherwise) if out is None else out.otherwise(otherwise)).cast("int")


def _secret_value(v: Column) -> Column:
    return F.regexp_replace(v, r"^[^=:]*[=:]\x20?", "")


def _variety(v: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.lower(v), "")))


def _rules(v: Column, digits: Column) -> dict[str, tuple[Column, Column, Column, Column]]:
    """By kind: whether a match is a base span, and what shape, gazetteer and check say to it."""
    no = F.lit(False)
    bare, odd_number = _secret_value(v), v.rlike(r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$|[0-9]\.[0-9]+\.")
    known_number = v.rlike(r"^\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    given, family = v.rlike(_any_word(GIVEN)), v.rlike(_any_word(FAMILY))
    return {
        "email": (F.lit(True), _vote((v.rlike(r"\.[A-Za-z]{2,24}$"), 1), otherwise=-1), _vote((v.rlike(PROVIDERS), 1)), _vote((v.rlike("^[^@]*[A-Za-z]"), 1), otherwise=-1)),
        "ip": (_good_ip(v), _vote((v.rlike(r"(?:^|\.)0[0-9]"), -1), otherwise=1), _vote((v.rlike(RESERVED), -1)), _vote((_good_ip(v), 1), otherwise=-1)),
        "card": (luhn(v), _vote((digits.isin(15, 16), 1), otherwise=-1), _vote((_digits(v).rlike(ISSUERS), 1)), _vote((luhn(v), 1), otherwise=-1)),
        "phone": (digits.between(10, 15), _vote((v.rlike(r"[\x20().-]"), 1)), _vote((v.rlike(COUNTRIES), 1), otherwise=-1), _vote((digits.between(10, 15), 1), otherwise=-1)),
        "secret": (
            no,
            _vote((bare.rlike("[0-9]") & bare.rlike("[A-Za-z]") & (F.length(bare) >= 12), 1), (~bare.rlike("[0-9]"), -1)),
            _vote((v.rlike(STRONG_KEYS), 1), (v.rlike(PLAIN_KEYS), -1)),
            _vote(((_variety(bare) >= 7) & bare.rlike("[0-9][A-Za-z]|[A-Za-z][0-9]") & bare.rlike("[0-9].*[0-9].*[0-9]"), 1), otherwise=-1),
        ),
        "token": (no, _vote((F.length(v) >= 24, 1), (v.rlike(r"^[A-Za-z]+[-_/][A-Za-z0-9/_-]*[0-9]{1,4}$"), -1)), _vote((v.rlike(KEY_MARKS), 1), otherwise=-1), _vote(((_variety(v) >= 9) & v.rlike("(?:[0-9]+[A-Za-z]+){3}"), 1), otherwise=-1)),
        "number": (no, _vote((known_number, 1), (odd_number, -1)), _vote((v.rlike(YEARS), -1)), _vote((digits.between(9, 15) & ~odd_number, 1), otherwise=-1)),
        "name": (
            no,
            _vote((F.size(F.split(v, r"[\x20-]")) > 4, -1), (v.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b"), 1)),
            _vote((v.rlike(_any_word(NOT_PEOPLE)), -1), (given | family, 1), otherwise=-1),
            _vote((given & family, 1), otherwise=-1),
        ),
    }


def _described(x: Column) -> Column:
    """A match as a candidate: its place, kind, votes and features."""
    v, secret = x["value"], x["rank"] == KINDS.index("secret")

    def by_kind(of: Callable[[str], Column]) -> Column:
        out = None
        for rank, kind in enumerate(KINDS):
            out = F.when(x["rank"] == rank, of(kind)) if out is None else out.when(x["rank"] == rank, of(kind))
        return out

    def with_value(d: Column) -> Column:
        bare, digits = d["bare"], d["digits"]
        rules = _rules(v, digits)
        shape, gazetteer, check = (by_kind(lambda k, j=j: rules[k][j]) for j in (1, 2, 3))
        context = _vote((x["before"].rlike(NEUTRAL), -1), (x["before"].rlike(CONTEXT), 1))
        votes = dict(zip(VOTES, (shape, gazetteer, context, _vote((x["after"].rlike(UNITS), -1)), check), strict=True))
        return F.struct(
            x["start"].alias("start"),
            x["rank"].alias("rank"),
            x["end"].alias("end"),
            F.get(F.lit(list(KINDS)), x["rank"]).alias("kind"),
            by_kind(lambda k: rules[k][0]).alias("base"),
            *(c.alias(n) for n, c in votes.items()),
            F.when(F.length(bare) < 12, 0).when(F.length(bare) < 24, 1).otherwise(2).alias("size"),
            F.when(digits * 3 < F.length(bare), 0).when(digits * 3 < 2 * F.length(bare), 1).otherwise(2).alias("numeric"),
            (bare.rlike("[0-9]") & bare.rlike("[A-Za-z]")).cast("int").alias("mixed"),
        )

    bare = F.when(secret, _secret_value(v)).otherwise(v)
    return let(bare, lambda b: let(F.struct(b.alias("bare"), F.length(_digits(b)).alias("digits")), with_value))


def _found(t: Column) -> dict[str, Column]:
    """Matches by kind. A kind is only looked for in texts that hold a character it needs."""
    digit = t.rlike("[0-9]")
    needs = {"email": (F.contains(t, F.lit("@")), EMAIL), "ip": (t.rlike(r"[0-9]\.[0-9]"), IP), "card": (digit, CARD), "phone": (F.contains(t, F.lit("+")), PHONE)}
    needs |= {"secret": (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), SECRET), "token": (digit, TOKEN), "number": (digit, NUMBER), "name": (F.lit(True), NAME)}
    return {k: F.when(when, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))) for k, (when, pattern) in needs.items()}


PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, SECRET, TOKEN, NUMBER, NAME), strict=True))


def _wanted(x: Column) -> Column:
    """Whether a match is a candidate at all: digits that are too few or too many for any kind are not."""
    n = F.length(_digits(x["value"]))
    return F.when(x["rank"] == KINDS.index("card"), n.between(14, 19)).when(x["rank"] == KINDS.index("number"), n >= LEAST_DIGITS).otherwise(True)


def _clear(items: Column, blocks: Callable[[Column], Column], free: Callable[[Column], Column]) -> Column:
    """Of spans in order, those for which ``free`` holds and that neither reach into a span for which ``blocks`` holds nor are reached by one before them."""
    far = 2**31 - 1

    def apart(x: Column) -> Column:
        ends = running(F.transform(x, lambda c: F.when(blocks(c), c["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(x), lambda c: F.when(blocks(c), far - c["start"]).otherwise(0)), F.greatest))
        return let(
            F.struct(ends.alias("ends"), starts.alias("starts")),
            lambda r: F.filter(x, lambda c, k: free(c) & ((k == 0) | (F.get(r["ends"], k - 1) <= c["start"])) & (far - F.coalesce(F.get(r["starts"], k + 1), F.lit(0)) >= c["end"])),
        )

    return F.when(F.size(items) == 0, items).otherwise(let(items, apart))


def _place(c: Column) -> Column:
    return F.struct(*(c[n].alias(n) for n in ("start", "rank", "end", "kind")))


def judged(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """The input with ``t`` (the text, null as empty), ``base`` (base spans in order) and ``candidates``: all matches that are base spans or overlap none, with their votes."""
    t = F.col("t")
    rows = docs.withColumn("t", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumns({f"f_{k}": v for k, v in _found(t).items()})
    raw = F.array(*(F.struct(F.lit(KINDS.index(k)).alias("rank"), F.col(f"f_{k}").alias("found"), F.when(F.size(f"f_{k}") > 0, F.split(t, p, -1)).alias("gaps")) for k, p in PATTERNS.items()))
    some = F.filter(raw, lambda r: F.coalesce(F.size(r["found"]), F.lit(0)) > 0)
    matches = F.filter(F.flatten(F.transform(some, _placed)), _wanted)
    rows = rows.withColumn("candidates", F.array_sort(F.transform(matches, _described))).drop(*(f"f_{k}" for k in KINDS))
    is_base = lambda c: c["base"]
    cleared = F.concat(F.filter("candidates", is_base), _clear(F.col("candidates"), is_base, lambda c: ~c["base"]))
    rows = rows.withColumns({"base": F.transform(F.filter("candidates", is_base), _place), "candidates": F.when(F.exists("candidates", lambda c: ~c["base"]), cleared).otherwise(F.col("candidates"))})
    return rows if keep_text else rows.drop("t", "text")


# label model and classifier (on the driver, over counted patterns) -----------------------------------------------------


@dataclass(frozen=True)
class SpanModel:
    """Logistic weights by feature, such as ``("kind", "secret")`` or ``("shape", 1)``, and what the labelers are worth."""

    bias: float
    weights: dict[tuple[str, object], float]
    reliability: dict[str, dict[int, tuple[float, float]]]  # labeler -> vote -> (chance if personal, chance if not)


def label_model(patterns: list[tuple], counts: list[int], rounds: int = EM_ROUNDS) -> tuple[np.ndarray, dict]:
    """Probability that a pattern is personal data, by expectation-maximisation over conditionally independent votes."""
    votes = np.array([[p[1 + j] for j in range(len(VOTES))] for p in patterns])
    n = np.array(counts, dtype=float)
    post = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.05, 0.95)
    table: dict = {}
    for _ in range(rounds):
        prior = ((n * post).sum() + 1) / (n.sum() + 2)
        yes, no = np.full(len(n), math.log(prior)), np.full(len(n), math.log(1 - prior))
        for j, name in enumerate(VOTES):
            table[name] = {}
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                # smoothing leans to labelers that are right more often than not, which keeps the two classes from swapping
                a = ((n * post)[at].sum() + 1 + (v == 1)) / ((n * post).sum() + 4)
                b = ((n * (1 - post))[at].sum() + 1 + (v == -1)) / ((n * (1 - post)).sum() + 4)
                table[name][v] = (float(a), float(b))
                yes[at] += math.log(a)
                no[at] += math.log(b)
        new = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table


def train(patterns: list[tuple], counts: list[int], ridge: float = 1.0) -> SpanModel:
    """The span classifier: ridge logistic regression of the label model's probabilities on votes and features, by Newton steps."""
    if not patterns:
        return SpanModel(0.0, {}, {})
    post, table = label_model(patterns, counts)
    names = sorted({(f, p[i]) for p in patterns for i, f in enumerate(PATTERN) if p[i] != 0}, key=str)
    x = np.array([[1.0] + [float(p[PATTERN.index(f)] == v) for f, v in names] for p in patterns])
    n, w = np.array(counts, dtype=float), np.zeros(len(names) + 1)
    n = n / n.sum() * min(n.sum(), 1000.0)  # keeps the ridge's share the same at every size
    reg = ridge * np.eye(len(w))
    reg[0, 0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + reg, x.T @ (n * (p - post)) + reg @ w)
        w = w - step * min(1.0, 3.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return SpanModel(float(w[0]), {k: float(v) for k, v in zip(names, w[1:], strict=True)}, table)


def probability(model: SpanModel, candidate: Column) -> Column:
    """The classifier as a Column."""
    z = F.lit(model.bias)
    for (f, v), w in model.weights.items():
        z = z + F.when(candidate[f] == F.lit(v), w).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def patterns(rows: DataFrame) -> tuple[list[tuple], list[int]]:
    """Vote patterns of all candidates and how often each occurs (aggregated before the shuffle)."""
    counted = rows.select(F.explode("candidates").alias("c")).groupBy(*(F.col(f"c.{f}").alias(f) for f in PATTERN)).agg(F.count("*").alias("n"))
    got = sorted(tuple(r) for r in counted.collect())  # at most kinds x 3^votes x 18 patterns
    return [r[:-1] for r in got], [r[-1] for r in got]


def detect(docs: DataFrame, model: SpanModel | None = None, keep_text: bool = True) -> DataFrame:
    """The input's columns with ``t``, ``base`` and ``all_spans``: arrays of ``(start, rank, end, kind)`` in order.

    ``base`` holds exactly the base spans; ``all_spans`` adds accepted candidates
    that overlap none of them, nor an accepted one before them. Each row is
    judged by itself; a null text is empty. Without a ``model`` one is trained on
    all the rows; what is found is then saved, so the patterns run once. Without
    ``keep_text`` the text is left out.
    """
    rows = judged(docs, keep_text)
    if model is None:
        rows = saved(rows.drop("t"), "candidates")
        rows = rows.withColumn("t", F.coalesce(F.col("text"), F.lit(""))) if keep_text else rows
        model = train(*patterns(rows))
    accepted = F.array_sort(F.transform(F.filter("candidates", lambda c: c["kind"].isin(*EXTRA) & (probability(model, c) >= ACCEPT)), _place))
    apart = let(accepted, lambda a: F.when(F.size(a) < 2, a).otherwise(let(running(F.transform(a, lambda c: c["end"]), F.greatest), lambda e: F.filter(a, lambda c, k: (k == 0) | (F.get(e, k - 1) <= c["start"])))))
    more = F.when(F.exists("candidates", lambda c: c["kind"].isin(*EXTRA)), apart).otherwise(F.array().cast(f"array<{PLACE}>"))
    return rows.withColumn("all_spans", F.array_sort(F.concat("base", more))).drop("candidates")


def spans_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *(count(k) for k in BASE), F.sha2(spans_text("base").cast("binary"), 256).alias("base_sha256"), spans_text("all_spans").alias("spans"))


def _stretch(t: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """``body(cut)`` where ``cut(start, end)`` is a part of the text: looked up in chunks, since a substring is sought from the beginning of its text."""
    whole = lambda x: F.ceil(x).cast("int")
    width = F.greatest(whole(F.sqrt(F.length(t))), F.lit(256))

    def chunks(size: Column) -> Column:
        few = F.greatest(whole(F.sqrt(F.length(t) / size)), F.lit(1))  # chunks in a part, and about as many parts
        parts = F.transform(F.sequence(F.lit(0), whole(F.length(t) / (few * size))), lambda p: t.substr(p * few * size + 1, few * size))
        return F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), few - 1), lambda k: p.substr(k * size + 1, size))))

    def with_chunks(c: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / c["size"]).cast("int")
            held = F.array_join(F.slice(c["chunks"], first + 1, F.floor(end / c["size"]).cast("int") - first + 1), "")
            return held.substr(start - first * c["size"] + 1, end - start)

        return body(cut)

    return let(width, lambda size: let(F.struct(size.alias("size"), chunks(size).alias("chunks")), with_chunks))


def masked(found: DataFrame, name: str = "masked") -> DataFrame:
    """The text with every span replaced by its kind in angle brackets; a span that begins inside an earlier one is merged into it."""
    t = F.col("t")

    def body(cut: Callable[[Column, Column], Column]) -> Column:
        def replaced(r: Column) -> Column:
            spans, ends = r["spans"], r["ends"]
            before = lambda k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
            parts = F.transform(spans, lambda x, k: F.when(x["start"] >= before(k), F.concat(cut(before(k), x["start"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise(""))
            return F.concat(F.array_join(parts, ""), cut(F.element_at(ends, -1), F.length(t)))

        return let(F.struct(F.col("all_spans").alias("spans"), running(F.transform("all_spans", lambda x: x["end"]), F.greatest).alias("ends")), replaced)

    return found.withColumn(name, F.when(F.size("all_spans") == 0, t).otherwise(_stretch(t, body)))
