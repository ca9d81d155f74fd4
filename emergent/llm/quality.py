"""Quality rules: exact text statistics, and a hashed n-gram logistic regression trained on labelled quality rows.

Features are hashed word 1- and 2-grams and byte 3- and 5-grams of the whole text. The model is fitted on a bounded sample (``rows``
labelled rows, chosen by a hash of doc_id), calibrated by Platt scaling on rows that the fit hasn't seen, and scores Arrow batches
against fixed thresholds.

Defined cases: a null or empty text has no words, all counts 0, and fails the base rule (fewer than 50 words); repeated rows are scored
alike; with no labelled rows, or labels of one class only, the verdict is the base rule alone; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emergent.llm import learn
from emergent.llm.blocks import Block, blocks_of, chained, counts_between, mix, random_key
from emergent.session import ship

WORD_DIMS, BYTE_DIMS = 1024, 2048
MIN_WORDS, MAX_REPEATED = 50, 0.5
#: A document stays if its calibrated probability of quality 1 is at least this.
KEEP_AT = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Each process hashes with its own key where equal hashes mean equal words or lines, so texts can't be made to collide.
_key = random_key()
STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(h: np.ndarray) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(h) < 4:
        return 0
    windows = chained([h[:-2], h[1:-1], h[2:]])
    order = np.argsort(windows)
    sorted_windows = windows[order]
    same = sorted_windows[1:] == sorted_windows[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= twice
    return int(covered.sum())


def block_stats(block: Block) -> dict[str, np.ndarray]:
    """The exact statistics of each text of a block."""
    starts, ends = block.words
    bounds = block.word_bounds
    out = {
        "n_words": np.diff(bounds),
        "word_chars": counts_between(block.starts_of_chars() & ~block.white, block.starts, block.ends),
        "n_symbols": counts_between(SYMBOLS[block.data], block.starts, block.ends),
    }
    h = block.word_hashes(key=_key)
    out["n_repeat_words"] = np.array([_repeated_words(h[bounds[i] : bounds[i + 1]]) for i in range(block.n)], np.int64)
    line_starts, line_ends = block.runs(block.data != 10)  # an empty line has no word
    full = counts_between(~block.white, line_starts, line_ends) > 0
    line_starts, line_ends = line_starts[full], line_ends[full]
    keys = chained([block.hashes(line_starts, line_ends, key=_key), block.doc_of(line_starts).astype(np.uint64)])
    first = np.unique(keys, return_index=True)[1]
    again = np.ones(len(keys), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(block.doc_of(line_starts[again]), minlength=block.n).astype(np.int64)
    return out


def block_features(block: Block) -> np.ndarray:
    """Hashed n-gram frequencies of each text, as the square roots of shares, so a text's length doesn't matter."""
    out = np.zeros((block.n, WORD_DIMS + BYTE_DIMS), np.float32)
    h, bounds = block.word_hashes(), block.word_bounds
    starts, ends = block.words
    doc = block.doc_of(starts)
    pairs = chained([h[:-1], h[1:]]) if len(h) > 1 else h[:0]
    same = h[1:] == h[:-1]
    pairs[same] = np.uint64(0xA5A5A5A5A5A5A5A5)  # a word and itself again: one n-gram, whatever the word is
    inside = doc[1:] == doc[:-1]
    byte = block.data.astype(np.uint64)
    for values, owner, at, dims in (
        (h, doc, 0, WORD_DIMS // 2),
        (pairs[inside], doc[1:][inside], WORD_DIMS // 2, WORD_DIMS // 2),
        (*_byte_grams(byte, block, 3), WORD_DIMS, BYTE_DIMS // 2),
        (*_byte_grams(byte, block, 5), WORD_DIMS + BYTE_DIMS // 2, BYTE_DIMS // 2),
    ):
        if len(values):
            cell = owner * dims + (values >> np.uint64(11)).astype(np.int64) % dims
            counts = np.bincount(cell, minlength=block.n * dims).reshape(block.n, dims).astype(np.float32)
            out[:, at : at + dims] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def _byte_grams(byte: np.ndarray, block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(byte) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(len(byte) - n + 1, np.uint64)
    for k in range(n):
        value = (value << np.uint64(8)) | byte[k : k + len(value)]
    lengths = block.ends - block.starts
    owner = np.repeat(np.arange(block.n), lengths)
    inside = owner[: len(value)] == owner[n - 1 :]
    return (value[inside] * np.uint64(0x9E3779B97F4A7C15)), owner[: len(value)][inside]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        return learn.sigmoid(self.a * (features @ self.weights + self.bias) + self.b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000) -> Model | None:
    """Train on at most ``rows`` labelled rows; four fifths fit the weights, one fifth the calibration. None if a class is missing."""
    ship(docs.sparkSession)
    ids = learn.sampled_ids(labels.select("doc_id", "quality").where("quality in (0, 1)").dropDuplicates(["doc_id"]), rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                x = block_features(block).astype(np.float16)
                part = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    found = sample.mapInArrow(featured, "doc_id long, quality long, x binary").toPandas().sort_values(["doc_id", "quality", "x"]).head(rows)
    y = found["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack([np.frombuffer(r, np.float16) for r in found["x"]]).astype(np.float64)
    later = mix(found["doc_id"].to_numpy(np.int64).astype(np.uint64)) % np.uint64(5) == 0
    if later.all() or y[~later].min() == y[~later].max():
        later[:] = False
    balance = np.where(y > 0, 0.5 / max(y[~later].mean(), 1e-6), 0.5 / max(1 - y[~later].mean(), 1e-6))
    w, b = learn.fit_logistic(x[~later], y[~later], balance[~later], penalty=1e-4, steps=400)
    check = later if later.any() else ~later
    return Model(w.astype(np.float32), b, *learn.fit_calibration(x[check] @ w + b, y[check]))


def _judged(block: Block, model: Model | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The statistics, probability and base verdict of each text."""
    stats = block_stats(block)
    p = model.probability(block_features(block)) if model else np.ones(block.n)
    return stats, p, (stats["n_words"] < MIN_WORDS) | (stats["n_repeat_words"] > MAX_REPEATED * stats["n_words"])


def assess(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the exact statistics, probability, base_failed and kept, a row for each row of docs."""
    ship(docs.sparkSession)
    names = [*STAT_NAMES, "probability"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                stats, p, failed = _judged(block, model)
                columns = [batch.column("doc_id").slice(block.first, block.n), *(pa.array(stats[k], pa.int64()) for k in STAT_NAMES), pa.array(p.astype(float)), pa.array(failed), pa.array(~failed & (p >= keep_at))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in STAT_NAMES) + ", probability double, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(scored, schema)


def keep(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that pass, whole and with all their columns; nothing is shuffled or joined."""
    ship(docs.sparkSession)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for block in blocks_of(batch.column("text")):
                _, p, failed = _judged(block, model)
                good[block.first : block.first + block.n] = ~failed & (p >= keep_at)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(passed, docs.schema)
