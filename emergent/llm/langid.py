"""Language identification as mixture inference.

Every language has a distribution over hashed letter 3-grams, learnt from a bounded sample (about ``rows`` documents of each language, one
at least, by a hash of doc_id); every lang value that a learnable document has is learnt, however many there are. A document is a mixture: each run of letters was written in one of its
languages. Expectation-maximisation over the runs' likelihoods estimates the proportions; the set of languages is the one, among the sets
of the k largest proportions, of highest penalised likelihood (BIC). The prediction is the largest proportion of that set.

Defined cases: a text that is null or has no letter is ``und`` with score 0; an empty sample makes every text ``und``; ties go to the
smaller language name; a null doc_id is never learnt from and not held out; repeated rows are predicted alike; texts are whole however
long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emergent.llm import learn
from emergent.llm.blocks import BLOCK_BYTES, Block, blocks_of
from emergent.session import ship

#: Buckets of 3-grams, steps of expectation-maximisation, languages whose counts a task holds at once, and those that a whole block suits.
DIMS, STEPS, HELD, BLOCK_LANGUAGES = 1 << 16, 8, 64, 16
UNKNOWN = "und"

_letter = np.zeros(256, bool)
for _a, _b in (("A", "Z"), ("a", "z")):
    _letter[ord(_a) : ord(_b) + 1] = True
_letter[0x80:] = True
_fold = np.full(256, 0x20, np.uint8)
_fold[_letter] = np.arange(256, dtype=np.uint8)[_letter]
_fold[ord("A") : ord("Z") + 1] += 32


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the 3-gram around each letter byte, where each run of letters begins among them, and the run's text."""
    letter = _letter[block.data]
    starts, ends = block.runs(letter)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = _fold[block.data].astype(np.uint32)
    before, after = np.empty_like(code), np.empty_like(code)
    before[0], before[1:] = 0x20, code[:-1]
    after[-1], after[:-1] = 0x20, code[1:]
    before[starts] = 0x20
    after[ends - 1] = 0x20
    value = (before << np.uint32(16) | code << np.uint32(8) | after)[letter] * np.uint32(0x9E3779B1)
    lengths = ends - starts
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    return (value >> np.uint32(16)).astype(np.int64), at, block.doc_of(starts)


@dataclass(frozen=True)
class Model:
    names: list[str]
    log_p: np.ndarray  # of each language and bucket

    def mixtures(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """For each text the proportions of its languages (0 outside the selected set) and the number of runs."""
        bucket, at, doc = grams(block)
        n, k = block.n, len(self.names)
        runs = np.bincount(doc, minlength=n)
        if not len(at) or not k:
            return np.zeros((n, k), np.float32), runs
        full = np.flatnonzero(runs)
        count = runs[full].astype(np.float32)
        first = np.zeros(len(full), np.int64)
        np.cumsum(runs[full][:-1], out=first[1:])
        like = np.stack([np.add.reduceat(row[bucket], at) for row in self.log_p])
        like = np.exp(like - like.max(axis=0))
        each = np.repeat(np.arange(len(full)), runs[full])
        share = np.full((k, len(full)), 1 / k, np.float32)
        for _ in range(STEPS):
            part = like * share[:, each]
            part *= 1 / (part.sum(axis=0) + np.float32(1e-30))
            share = np.add.reduceat(part, first, axis=1) / count
        order = np.argsort(-share, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(k)[:, None], axis=0)
        # The sets are nested, so each adds one language to the likelihood of the one before.
        best, chosen = np.full(len(full), -np.inf), np.ones(len(full), np.int64)
        penalty, own = np.log(np.maximum(count, 2)), np.arange(len(full))
        total, mass = np.zeros(len(at), np.float32), np.zeros(len(full), np.float32)
        for size in range(1, k + 1):
            lang = order[size - 1]
            new = share[lang, own]
            mass += new
            total += like[lang[each], np.arange(len(at))] * new[each]
            fit = np.add.reduceat(np.log(total / np.maximum(mass, np.float32(1e-30))[each] + np.float32(1e-30)), first)
            score = 2 * fit - (size - 1) * penalty
            better = score > best + 1e-6
            best, chosen = np.where(better, score, best), np.where(better, size, chosen)
            if (1e-5 * count - size * penalty <= best).all():  # no run is likelier than 1, so no larger set is better
                break
        chosen = np.where(rank < chosen, share, 0)
        chosen /= np.maximum(chosen.sum(axis=0), np.float32(1e-30))
        out = np.zeros((n, k), np.float32)
        out[full] = chosen.T
        return out, runs


def fit(docs: DataFrame, rows: int = 800) -> Model:
    """Learn from about ``rows`` documents of each language, none of them held out."""
    ship(docs.sparkSession)
    lettered = F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")
    usable = docs.select("doc_id", "text", "lang").where(~learn.held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & lettered)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    drawn = usable.withColumn("chance", chance)
    sizes = drawn.groupBy("lang").agg(F.greatest(F.lit(rows) / F.count(F.lit(1)), F.min("chance")).alias("rate"))
    sample = drawn.join(F.broadcast(sizes), "lang").where("chance <= rate").select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def drained() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                cells = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], ["lang", "cell", "n"])
            totals.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for block in blocks_of(batch.column("text")):
                bucket, at, doc = grams(block)
                owner = np.repeat(doc, np.diff(np.append(at, len(bucket))))
                edges = np.searchsorted(owner, np.arange(block.n + 1))
                for i in range(block.n):
                    lang = langs[block.first + i]
                    if lang not in totals:
                        if len(totals) >= HELD:
                            yield from drained()
                        totals[lang] = np.zeros(DIMS, np.int64)
                    totals[lang] += np.bincount(bucket[edges[i] : edges[i + 1]], minlength=DIMS)
        yield from drained()

    found = sample.mapInArrow(counted, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    log_p = np.empty((len(names), DIMS), np.float32)
    parts = found.groupby("lang")
    for j, name in enumerate(names):
        part, counts = parts.get_group(name), np.full(DIMS, 0.5)
        counts[part["cell"].to_numpy()] += part["n"].to_numpy()
        log_p[j] = np.log(counts / counts.sum())
    return Model(names, log_p)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture (language to proportion) of each row of docs."""
    ship(docs.sparkSession)

    limit = BLOCK_BYTES * BLOCK_LANGUAGES // max(BLOCK_LANGUAGES, len(model.names))  # memory goes with runs and languages

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text"), limit):
                share, runs = model.mixtures(block)
                names, scores, mixed = [], [], []
                for i in range(block.n):
                    best = int(share[i].argmax()) if len(model.names) else 0
                    known = runs[i] > 0 and len(model.names) > 0 and share[i][best] > 0
                    if known and not _ascii_letter(block, i):
                        known = any(c.isalpha() for c in block.text(i))
                    names.append(model.names[best] if known else UNKNOWN)
                    scores.append(float(min(1, share[i][best])) if known else 0.0)
                    mixed.append([(model.names[j], float(share[i][j])) for j in np.flatnonzero(share[i])] if known else [])
                part = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))],
                    ["doc_id", "held_out", "lang_pred", "score", "mixture"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, mixture map<string,double>"
    return docs.select("doc_id", "text", learn.held_out().alias("held_out")).mapInArrow(predicted, schema)


def _ascii_letter(block: Block, i: int) -> bool:
    part = block.data[block.starts[i] : min(block.ends[i], block.starts[i] + 4096)]
    return bool((_letter[part] & (part < 0x80)).any())
