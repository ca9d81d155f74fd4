"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Generators with high recall propose spans, which may overlap: one pattern for each base kind, whose valid spans are exact and always stay,
and one for each looser kind (phone numbers without a plus, national ids, bank accounts, spelt-out mail addresses), tried at every start of a
run and, for accounts, with every shorter form. Boosted trees score a loose candidate by its format and its context; a threshold for each
kind, calibrated on examples not learnt from, selects, and of overlapping candidates the likeliest, then the longest, is added to the base
spans.

The trees are trained on the driver from a few hundred made-up candidates (no table has labels for them), whose features come from the same
expressions; scoring is a sum of CASE expressions, so the main path has neither Python nor RDD code. Patterns are possessive, and begin
only where a run begins, so that long runs cost linear time.

Offsets are code points, end exclusive. Defined cases: a null or empty text has no spans; each row has one result; texts are whole however
long; other columns are ignored by ``find`` and carried by ``redact``.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emergent.llm import learn

# The base kinds in their order, with patterns that find the spans of the plain forms without trying a run's inside.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base kind's pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
#: Kinds that the method adds, each with the form a loose candidate of it has.
LOOSE = {
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    "account": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?",
    "spelt_email": r"[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}",
}
BEGIN = r"(?<![A-Za-z0-9._+-])"
#: Characters of context, the least threshold of a kind, and the share of right candidates that a kind's threshold must reach.
CONTEXT, THRESHOLD, PRECISION = 24, 0.9, 0.95
_words = {
    "talk": "phone|tel|call|mobile|cell|fax|contact|reach",
    "identity": "ssn|social|security|insurance|passport|identity|tax",
    "money": "iban|account|bank|transfer|pay",
    "post": "mail|write|address|contact|reach",
    "number": "order|version|ticket|part|invoice|item|serial|page|isbn|ref|build|model",
}
FEATURES = ("length", "digits", "letters", "separators", "repeats", "edge", "torn", "national_id", "local_phone", "account", "spelt_email", *_words)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found)."""
    kind = "array<struct<start:long,end:long,found:string>>"

    def placed(x: Column) -> Column:
        found, between = x["found"], x["between"]
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

        def one(state: Column, i: Column) -> Column:
            word = F.element_at(found, i)
            begin = state["at"] + F.length(F.element_at(between, i))
            end = begin + F.length(word)
            return F.struct(end.cast("long").alias("at"), F.concat(state["out"], F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), word.alias("found"))).cast(kind)).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.size(found)), start, one)["out"]

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = lambda f: F.struct(f.alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(found, lambda f: F.when(F.size(f) > 0, let(both(f), placed)).otherwise(F.array().cast(kind)))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    size = F.length(digits)

    def one(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (size - i) % 2 == 1
        return total + F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), one) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda w: F.lit(True),
    "ip": lambda w: F.forall(F.split(w, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda w: let(_digits(w), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))),
    "phone": lambda w: F.length(_digits(w)).between(8, 15),
}


def _spans(text: Column, kind: str) -> Column:
    """The valid spans of a base kind."""
    empty = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    good = F.filter(matches(text, BASE[kind]), lambda m: VALID[kind](m["found"]))
    spans = F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    tried = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    return F.when(tried, spans).otherwise(empty)


def features(text: Column, candidate: Column) -> list[Column]:
    """Format and context of a candidate, in the order of FEATURES."""
    word = candidate["found"]
    before = F.lower(F.substring(text, F.greatest(candidate["start"] + 1 - CONTEXT, F.lit(1)).cast("int"), F.least(candidate["start"], F.lit(CONTEXT)).cast("int")))
    after = F.substring(text, (candidate["end"] + 1).cast("int"), F.lit(2))
    count = lambda pattern: F.length(F.regexp_replace(word, pattern, ""))
    digits = _digits(word)
    flag = lambda c: c.cast("double")
    return [
        F.length(word).cast("double"), count("[^0-9]").cast("double"), count("[^A-Za-z]").cast("double"), count("[A-Za-z0-9]").cast("double"),
        flag(digits.rlike(r"^([0-9])\1*$")), flag(after.rlike("^[A-Za-z0-9_]")), flag(after.rlike("^[.-][0-9]")),
        *(flag(word.rlike(f"^(?:{p})$")) for p in LOOSE.values()), *(flag(before.rlike(p)) for p in _words.values()),
    ]


def _examples(seed: int = 11, each: int = 60) -> list[tuple[str, str, str, int]]:
    """Made-up (before, candidate, after, label) rows: forms of personal data in fitting contexts, and numbers and codes in others."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    capitals = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    pick = lambda key: r.choice(_words[key].split("|"))
    filler = lambda: r.choice(["the ", "and so on ", "they have it ", "it was ", "a long row of "])
    rows = []
    for _ in range(each):
        sep = r.choice(" .-")
        phone = f"({digits(3)}) {digits(3)}-{digits(4)}" if r.random() < 0.4 else f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"
        identity = f"{digits(3)}-{digits(2)}-{digits(4)}"
        account = f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"
        code = f"{capitals(2)}{digits(2)}{capitals(4)}{capitals(4)}{capitals(4)}"
        mail = f"name{digits(2)} [at] place{digits(1)} [dot] com"
        rows += [(f"{pick('talk')}: ", phone, " ", 1), (f"{pick('identity')} no ", identity, ".", 1), (f"{pick('money')} ", account, " ", 1), (f"{pick('post')} ", mail, " ", 1), (filler(), mail, " ", 1)]
        rows += [(f"{pick('number')} ", phone, r.choice([" ", "x"]), 0), (filler(), phone, " ", 0), (f"{pick('number')} ", identity, " ", 0), (filler(), identity, r.choice("x "), 0)]
        rows += [(f"{pick('number')} ", code, " ", 0), (filler(), code, r.choice([" ", "A"]), 0), (f"{pick('talk')} ", "000-000-0000", " ", 0), (f"{pick('identity')} ", "000-00-0000", " ", 0)]
    for _ in range(each):  # an account that runs into the number after it
        account = f"DE{digits(2)}{digits(12)}" if r.random() < 0.5 else f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)}"
        rows += [(f"{pick('money')} ", account, f" {digits(3)}", 1), (f"{pick('money')} ", f"{account} {digits(3)}", f"-{digits(3)}", 0)]
    return rows


def _kind(word: str) -> str:
    """The loose kind that a word has the form of, or none."""
    return next((k for k, p in LOOSE.items() if re.fullmatch(p, word)), "")


def _thresholds(chance: np.ndarray, y: np.ndarray, kinds: list[str], least: float = THRESHOLD) -> dict[str, float]:
    """For each kind the lowest threshold from ``least`` on at which PRECISION of its examples are right; 1 where none does."""
    out = {}
    for kind in LOOSE:
        own = np.array([k == kind for k in kinds])
        cuts = [least, *np.unique(chance[own & (chance > least)])]
        right = lambda cut: y[own & (chance >= cut)]
        out[kind] = float(next((c for c in cuts if len(right(c)) and right(c).mean() >= PRECISION), max(least, 1.0)))
    return out


class Trees:
    """Gradient boosting of depth-two trees on the logistic loss, and Platt scaling of their sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, kinds: list[str], rounds: int = 24, rate: float = 0.4) -> None:
        later = np.arange(len(y)) % 4 == 3
        fit_x, fit_y = x[~later], y[~later]
        self.base = float(np.log((fit_y.mean() + 1e-6) / (1 - fit_y.mean() + 1e-6)))
        self.trees: list[tuple] = []
        total = np.full(len(fit_y), self.base)
        for _ in range(rounds):
            p = learn.sigmoid(total)
            tree = self._grow(fit_x, fit_y - p, p * (1 - p), 2, rate)
            self.trees.append(tree)
            total += np.array([self._value(tree, row) for row in fit_x])
        raw = self.base + np.array([sum(self._value(t, row) for t in self.trees) for row in x[later]])
        self.a, self.b = learn.fit_calibration(raw, y[later])
        self.held = learn.sigmoid(self.a * raw + self.b), y[later], [k for k, other in zip(kinds, later, strict=True) if other]

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float) -> tuple:
        leaf = ("leaf", float(rate * g.sum() / (h.sum() + 1.0)))
        best, gain = None, 1e-6
        if depth and len(x) > 1:
            whole = g.sum() ** 2 / (h.sum() + 1.0)
            for j in range(x.shape[1]):
                for cut in np.unique(x[:, j])[:-1][:64]:
                    low = x[:, j] <= cut
                    new = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[~low].sum() ** 2 / (h[~low].sum() + 1.0) - whole
                    if new > gain:
                        best, gain = (j, float(cut), low), new
        if best is None:
            return leaf
        j, cut, low = best
        return ("split", j, cut, self._grow(x[low], g[low], h[low], depth - 1, rate), self._grow(x[~low], g[~low], h[~low], depth - 1, rate))

    def _value(self, tree: tuple, row: np.ndarray) -> float:
        while tree[0] == "split":
            tree = tree[3] if row[tree[1]] <= tree[2] else tree[4]
        return tree[1]

    def probability(self, values: Column) -> Column:
        """The calibrated probability, as an expression over an array of features."""

        def of(tree: tuple) -> Column:
            if tree[0] == "leaf":
                return F.lit(tree[1])
            return F.when(values[tree[1]] <= tree[2], of(tree[3])).otherwise(of(tree[4]))

        raw = reduce(add, [of(t) for t in self.trees], F.lit(self.base))
        return 1 / (1 + F.exp(-(F.lit(self.a) * raw + F.lit(self.b))))


_trained: dict[int, Trees] = {}


def trees(spark: SparkSession, seed: int = 11) -> Trees:
    """The model; its examples and so its training are the same in every session."""
    if seed not in _trained:
        rows = _examples(seed)
        quoted = ", ".join("({}, {}, {}, {})".format(*("'" + s + "'" for s in row[:3]), row[3]) for row in rows)
        made = spark.sql(f"SELECT col1 AS before, col2 AS found, col3 AS after, col4 AS y FROM VALUES {quoted}")
        text = F.concat("before", "found", "after")
        candidate = F.struct(F.length("before").cast("long").alias("start"), (F.length("before") + F.length("found")).cast("long").alias("end"), F.col("found"))
        found = made.select("y", "found", F.array(*features(text, candidate)).alias("x")).collect()
        _trained[seed] = Trees(np.array([r["x"] for r in found]), np.array([r["y"] for r in found], float), [_kind(r["found"]) for r in found])
    return _trained[seed]


def _proposed(text: Column, kind: str) -> Column:
    """The candidates of a loose kind, one at each start and for accounts every shorter one: array of (start, end, found)."""
    array = "array<struct<start:long,end:long,found:string>>"
    pattern = f"{BEGIN}(?=({LOOSE[kind]}))"
    marked = F.concat(F.lit("\n"), text)  # so that no part is left out before a candidate at the text's start
    span = lambda start, word: F.struct(start.alias("start"), (start + F.length(word)).cast("long").alias("end"), word.alias("found"))

    def placed(x: Column) -> Column:
        start = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast(array).alias("out"))

        def one(state: Column, i: Column) -> Column:
            begin = (state["at"] + F.length(F.element_at(x["between"], i))).cast("long")
            return F.struct(begin.alias("at"), F.concat(state["out"], F.array(span(begin, F.element_at(x["found"], i))).cast(array)).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.size(x["found"])), start, one)["out"]

    def shorter(m: Column) -> Column:
        parts = F.split(m["found"], r"\x20", -1)
        words = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), " "))
        return F.transform(F.filter(words, lambda w: w.rlike(f"^(?:{LOOSE[kind]})$")), lambda w: span(m["start"], w))

    both = lambda f: F.struct(f.alias("found"), F.split(marked, pattern, -1).alias("between"))
    found = let(F.regexp_extract_all(marked, F.lit(pattern), F.lit(1)), lambda f: F.when(F.size(f) > 0, let(both(f), placed)).otherwise(F.array().cast(array)))
    return F.flatten(F.transform(found, shorter)).cast(array) if kind == "account" else found


def _chosen(spans: Column) -> Column:
    """Of spans with chances those that overlap no likelier one (then longer, then earlier) that is chosen, by start."""
    by_start = lambda a, b: (a["start"] - b["start"]).cast("int")
    longer = lambda a, b: ((b["end"] - b["start"]) - (a["end"] - a["start"])).cast("int")
    order = lambda a, b: F.when(a["chance"] > b["chance"], -1).when(a["chance"] < b["chance"], 1).when(longer(a, b) != 0, longer(a, b)).otherwise(by_start(a, b))

    def one(taken: Column, s: Column) -> Column:
        return F.when(F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), taken).otherwise(F.concat(taken, F.array(s)))

    greedy = lambda xs: F.aggregate(F.array_sort(xs, order), F.slice(xs, 1, 0), one)
    return let(spans, lambda xs: F.when(F.size(xs) > 1, F.array_sort(greedy(xs), by_start)).otherwise(xs))


def _added(text: Column, model: Trees, threshold: float) -> Column:
    """Spans of loose candidates whose chance reaches their kind's threshold, none of them overlapping, by start."""
    least = _thresholds(*model.held, threshold)

    def judged(kind: str) -> Column:
        chance = lambda m: let(F.array(*features(text, m)), model.probability)
        scored = F.transform(_proposed(text, kind), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), chance(m).alias("chance")))
        return F.filter(scored, lambda s: s["chance"] >= least[kind])

    good = _chosen(F.concat(*(judged(k) for k in LOOSE)))
    return F.transform(good, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _by_kind(spans: Column) -> Column:
    is_kind = lambda kind: lambda span: span["kind"] == kind
    return F.concat(*(F.filter(spans, is_kind(k)) for k in LOOSE))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the spans of each base kind in a column of its name, and ``added``: arrays of (kind, start, end)."""
    model = trees(docs.sparkSession)
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    some = plain.select("doc_id", "text", F.col("text").rlike("[0-9@+\\[(]").alias("some"))
    empty = F.array().cast("array<struct<kind:string,start:long,end:long>>")
    text = F.col("text")
    base = [F.when(F.col("some"), _spans(text, k)).otherwise(empty).alias(k) for k in BASE]
    more = F.when(F.col("some"), let(_added(text, model, threshold), _by_kind)).otherwise(empty).alias("added")
    return some.select("doc_id", *base, more)


def digest(found: DataFrame) -> DataFrame:
    """The counts of the base kinds, the SHA-256 of the base spans, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.concat(*BASE)), 256).alias("base_sha256"), joined(F.concat(*BASE, "added")).alias("spans"))


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in brackets; spans that overlap become one, of the first one's kind."""
    model = trees(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.array_sort(F.concat(*(_spans(text, k) for k in BASE), _added(text, model, threshold)), lambda a, b: (a["start"] - b["start"]).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def one(state: Column, s: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        taken = F.struct(s["end"].alias("at"), F.concat(state["out"], between, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        longer = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], taken).otherwise(longer)

    done = lambda end: F.concat(end["out"], F.substring(text, (end["at"] + 1).cast("int"), F.length(text)))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), let(F.aggregate(spans, start, one), done)))
