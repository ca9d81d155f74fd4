"""Toxicity by a weighted finite-state pattern grammar.

Texts become sequences of token classes: insults (with a weight learnt from labelled rows), threats, targets, negations, reported speech
and other words. A clause goes through weighted transducers, each of which reads what the one before writes: a pass from the clause's end
marks the insults that a target follows; the next marks insults and threats that follow a target, and another targets that follow a threat;
then negations soften what they reach, reported speech softens what it quotes, and the last machine weighs what a clause has matched. A threat matches only with a target;
an insult without one is a pattern of its own, of weight ``BARE``. The transducers are composed into one machine, whose weight of a clause
is the sum of what it writes. Logistic regression turns a text's strongest clause and its total into a calibrated probability.

A departure from matching clauses rather than isolated words: with ``BARE`` above 0 an insult with no target in its clause counts, because
labels may follow single words wherever they stand; ``fit(..., bare=0.0)`` gives the strict grammar (the README has figures of both). Threats
and all other words alone have no score.

Insults are learnt from at most ``rows`` labelled documents, chosen by a hash of doc_id, none of them held out: whole words and word
beginnings of 4 and 5 letters, kept where toxic documents hold them far more often than others (equal texts count once).

Defined cases: a null or empty text has no clause and the probability of such texts; with no labels of both classes every score is 0;
texts are whole however long; repeated rows are scored alike; rows without doc_id are never learnt from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emergent.llm import learn
from emergent.llm.blocks import Block, blocks_of, hash_of
from emergent.llm.langid import _letter
from emergent.session import ship

#: Labelled documents learnt from at most, and the least log-odds, documents and share of toxic documents of a term.
ROWS, LEAST_ODDS, LEAST_DOCS, LEAST_SHARE = 12_000, 2.5, 4, 0.01
#: The part of its weight that an insult without a target has.
BARE = 0.8
#: AIMED is an insult near a target, MENACE a threat near one.
SYMBOLS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED, MENACE = range(8)
PREFIXES = (4, 5)

# Function words of the grammar.
WORDS = {
    THREAT: "kill hurt destroy beat shoot stab burn murder strangle attack töten schlagen tuer frapper matar golpear",
    TARGET: "you your yourself u he she they them him her people du dich dir euch sie ihr tu te toi vous ils elle eux tú ti usted ustedes ellos ella",
    NEGATION: "not never nor without isn aren wasn nicht nie niemals kein keine jamais aucun nunca jamás ningún",
    REPORT: "said says say told wrote called quoted claimed reported allegedly sagte schrieb behauptete dit disait écrit dijo dice escribió",
}
_breaks = np.zeros(256, bool)
_breaks[list(b".!?;:,\n()")] = True


@dataclass(frozen=True)
class Transducer:
    """moves[(state, symbol)] is (next state, symbol written, factor, bonus); a missing move keeps state and symbol, factor 1 and bonus 0."""

    moves: dict[tuple[int, int], tuple[int, int, float, float]]

    def step(self, state: int, symbol: int) -> tuple[int, int, float, float]:
        return self.moves.get((state, symbol), (state, symbol, 1.0, 0.0))


def _fading(trigger: int, reach: int, effect: dict[int, tuple[int, float, float]]) -> Transducer:
    """After the trigger, the effect (symbol to symbol written, factor and bonus) holds for ``reach`` tokens."""
    moves = {(0, trigger): (reach, trigger, 1.0, 0.0)}
    for left in range(1, reach + 1):
        for symbol in SYMBOLS:
            moves[left, symbol] = (reach if symbol == trigger else left - 1, *effect.get(symbol, (symbol, 1.0, 0.0)))
    return Transducer(moves)


def _softened(trigger: int, reach: int, insult: float, threat: float) -> Transducer:
    return _fading(trigger, reach, {INSULT: (INSULT, insult, 0.0), AIMED: (AIMED, insult, 0.0), MENACE: (MENACE, threat, 0.0)})


REACH = 6
TOWARDS = _fading(TARGET, REACH, {INSULT: (AIMED, 1.0, 0.0), THREAT: (MENACE, 1.0, 0.0)})
THREATENING = _fading(THREAT, 4, {TARGET: (MENACE, 1.0, 0.0)})
NEGATED = _softened(NEGATION, 3, 0.6, 0.3)
REPORTED = _softened(REPORT, 8, 0.7, 0.4)


def _weighing(bare: float) -> Transducer:
    """The last machine: what a matched pattern weighs."""
    return Transducer({(0, INSULT): (0, INSULT, bare, 0.0), (0, AIMED): (0, AIMED, 1.25, 0.0), (0, MENACE): (0, MENACE, 1.0, 4.0)})


def _aimed(symbols: list[int]) -> list[int]:
    """The symbols with AIMED for each insult that a target follows within REACH tokens, read from the end."""
    out, left = list(symbols), 0
    for i in range(len(out) - 1, -1, -1):
        if out[i] == INSULT and left:
            out[i] = AIMED
        left = REACH if symbols[i] == TARGET else max(left - 1, 0)
    return out


class Composition:
    """Transducers composed, each reading what the one before writes; built as states are met. Bonuses add to a token's weight before factors."""

    def __init__(self, parts: tuple[Transducer, ...]) -> None:
        self.parts = parts
        self.start = (0,) * len(parts)
        self.moves: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], float, float]] = {}

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], float, float]:
        key = (state, symbol)
        if key not in self.moves:
            after, factor, bonus = [], 1.0, 0.0
            for part, own in zip(self.parts, state, strict=True):
                there, symbol, f, b = part.step(own, symbol)
                after.append(there)
                factor, bonus = factor * f, bonus + b
            self.moves[key] = (tuple(after), factor, bonus)
        return self.moves[key]

    def weight(self, symbols: list[int], weights: list[float]) -> float:
        state, total = self.start, 0.0
        for symbol, weight in zip(_aimed(symbols), weights, strict=True):
            state, factor, bonus = self.step(state, symbol)
            total += factor * (weight + bonus)
        return total


@lru_cache(maxsize=8)
def grammar(bare: float = BARE) -> Composition:
    return Composition((TOWARDS, THREATENING, NEGATED, REPORTED, _weighing(bare)))


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and end of each run of letters, and the hashes of its word and of its beginnings (0 where the word is shorter)."""
    starts, ends = block.runs(_letter[block.data])
    hashes = [block.hashes(starts, ends, lower=True)]
    chars = np.flatnonzero(block.starts_of_chars())
    rank = np.searchsorted(chars, starts)
    at = np.append(chars, len(block.data))
    for k in PREFIXES:
        stop = at[np.minimum(rank + k, len(at) - 1)]
        h = block.hashes(starts, np.minimum(stop, ends), lower=True) + np.uint64(k)
        hashes.append(np.where(stop < ends, h, np.uint64(0)))
    return starts, ends, hashes


@dataclass(frozen=True)
class Model:
    terms: np.ndarray  # sorted hashes
    odds: np.ndarray
    weights: np.ndarray
    bias: float
    bare: float = BARE

    def features(self, block: Block) -> np.ndarray:
        """Of each text: 1 if a clause matched, the strongest clause, the logarithm of the total."""
        out = np.zeros((block.n, 3))
        starts, ends, hashes = tokens(block)
        if not len(starts) or not len(self.terms):
            return out
        weight = np.zeros(len(starts))
        for h in hashes:
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            weight = np.where(self.terms[at] == h, np.maximum(weight, self.odds[at]), weight)
        symbol = np.where(weight > 0, INSULT, OTHER)
        for kind, known in _function_words().items():
            symbol[(symbol == OTHER) & np.isin(hashes[0], known)] = kind
        hit = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
        if not len(hit):
            return out
        doc = block.doc_of(starts)
        stops = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(_breaks[block.data], out=stops[1:])
        new = np.append(True, (stops[starts[1:]] > stops[ends[:-1]]) | (doc[1:] != doc[:-1]))
        clause = np.cumsum(new) - 1
        first = np.append(np.flatnonzero(new), len(starts))
        composed = grammar(self.bare)
        for c in np.unique(clause[hit]):
            a, b = first[c], first[c + 1]
            w = composed.weight(symbol[a:b].tolist(), weight[a:b].tolist())
            if w > 0:
                d = doc[a]
                out[d, 0] = 1
                out[d, 1] = max(out[d, 1], w)
                out[d, 2] += w
        out[:, 2] = np.log1p(out[:, 2])
        return out

    def probability(self, block: Block) -> np.ndarray:
        return learn.sigmoid(self.features(block) @ self.weights + self.bias)


_known: dict[int, np.ndarray] = {}


def _function_words() -> dict[int, np.ndarray]:
    if not _known:
        _known.update({kind: np.array([hash_of(w.encode(), lower=True) for w in words.split()], np.uint64) for kind, words in WORDS.items()})
    return _known


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bare: float = BARE) -> Model:
    """Learn the insults from four fifths of the sample and the probabilities from the other fifth."""
    ship(docs.sparkSession)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(3), -40.0)
    usable = labels.select("doc_id", "toxic").where("toxic in (0, 1)").where(~learn.held_out()).dropDuplicates(["doc_id"])
    ids = learn.sampled_ids(usable, rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").withColumn("later", F.pmod(F.xxhash64(F.col("doc_id").cast("long") + 7), F.lit(5)) == 0)
    earlier = sample.where("not later").dropDuplicates(["text"])

    def listed(known: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks_of(batch.column("text")):
                    starts, _, hashes = tokens(block)
                    doc = block.doc_of(starts)
                    term, owner = np.concatenate(hashes), np.tile(doc, len(hashes))
                    keep = term != 0
                    if known is not None:
                        keep &= np.isin(term, known)
                    pairs = np.unique(np.rec.fromarrays([owner[keep], term[keep]], names="d,t"))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs["t"].copy().view(np.int64))], ["term"])

        return run

    sizes = {r["toxic"]: r["count"] for r in earlier.groupBy("toxic").count().collect()}
    up, down = sizes.get(1, 0), sizes.get(0, 0)
    if not up or not down:
        return nothing
    least = max(LEAST_DOCS, int(LEAST_SHARE * up))
    counted = lambda part, known: part.mapInArrow(listed(known), "term long").groupBy("term").count()
    held = counted(earlier.where("toxic = 1"), None).where(F.col("count") >= min(least, up)).toPandas()  # at most 1 / LEAST_SHARE times a document's terms
    known = np.sort(held["term"].to_numpy(np.int64).view(np.uint64))
    others = counted(earlier.where("toxic = 0"), known).toPandas()
    against = dict(zip(others["term"].tolist(), others["count"].tolist(), strict=True))
    count = held["count"].to_numpy(float)
    other = np.array([against.get(t, 0) for t in held["term"].tolist()], float)
    odds = np.log((count + 0.1) / (up + 0.2)) - np.log((other + 0.5) / (down + 1))
    good = np.flatnonzero(odds >= LEAST_ODDS)
    terms = held["term"].to_numpy(np.int64).view(np.uint64)[good]
    order = np.argsort(terms)
    model = Model(terms[order], odds[good][order], np.zeros(3), 0.0, bare)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                f = model.features(block)
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(block.first, block.n).cast(pa.int64()), *(pa.array(f[:, k].copy()) for k in range(3))], ["y", "f0", "f1", "f2"])

    check = sample.where("later").mapInArrow(featured, "y long, f0 double, f1 double, f2 double").toPandas()
    if check["y"].nunique() < 2:
        check = sample.mapInArrow(featured, "y long, f0 double, f1 double, f2 double").toPandas()
    x, y = check[["f0", "f1", "f2"]].to_numpy(), check["y"].to_numpy(float)
    scale = np.maximum(x.std(axis=0), 1e-6)
    w, b = learn.fit_logistic(x / scale, y, np.ones(len(y)), penalty=1e-3, steps=1500)
    return Model(model.terms, model.odds, w / scale, b, bare)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    ship(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                p = model.probability(block)
                part = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", learn.held_out().alias("held_out")).mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
