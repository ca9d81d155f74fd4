"""Pattern packing of documents into training sequences.

A document is its token ids and one separator id; only a document longer than a sequence is cut, into whole sequences after a shorter
first piece. Lengths become a histogram of ``UNITS`` bins; patterns of at most ``FEW`` documents that fill a sequence are enumerated, and
their repeat counts are fitted to the histogram by non-negative least squares, once, on the driver (the histogram's size is fixed).

Pieces are dealt at random into groups of about ``GROUP`` pieces, so a group's lengths are a sample of all lengths; every group fills its
share of the rounded pattern counts, the last place of each sequence with the largest piece that fits, and packs the residuals into the
fullest sequence that holds them. Groups grow in number with the input, never in size; the cost of not mixing groups is less than one
sequence in a thousand.

Defined cases: a null or empty text is one separator; repeated rows and rows without doc_id are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emergent.llm import bpe
from emergent.llm.blocks import blocks_of
from emergent.session import checkpointed, ship

LIMIT, SEPARATOR = 2048, 0
UNITS, FEW, GROUP = 128, 3, 8192
#: The part of the fitted repeat counts that is packed by patterns; the rest stays residual, so small pieces are left to fill gaps.
BY_PATTERN = 0.6


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.word_table(shared.value)
        end = np.array([separator], "<u4")
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                ids, at = table.encode_block(block)
                ids = ids.astype("<u4")
                owner, piece, start, length, crc = [], [], [], [], []
                for i in range(block.n):
                    own = np.concatenate([ids[at[i] : at[i + 1]], end])
                    first = len(own) % limit or limit
                    edges = [0, *range(first, len(own) + 1, limit)]
                    for k in range(len(edges) - 1):
                        owner.append(i)
                        piece.append(k)
                        start.append(edges[k])
                        length.append(edges[k + 1] - edges[k])
                        crc.append(zlib.crc32(own[edges[k] : edges[k + 1]]))
                doc = batch.column("doc_id").slice(block.first, block.n).take(pa.array(owner, pa.int64()))
                numbers = [pa.array(x, pa.int64()) for x in (piece, start, length, crc)]
                yield pa.RecordBatch.from_arrays([doc, *numbers], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long")


def patterns(units: int = UNITS, few: int = FEW) -> np.ndarray:
    """Every way to fill all units by one to few lengths, a row each, 0 where there are fewer."""
    rows = [(units, *[0] * (few - 1))]
    for n in range(2, few + 1):
        for head in combinations_with_replacement(range(1, units // 2 + 1), n - 1):
            last = units - sum(head)
            if last >= head[-1]:
                rows.append((last, *reversed(head), *[0] * (few - n)))
    return np.array(rows, np.int64)


def least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Non-negative least squares by active sets (Lawson and Hanson)."""
    gram, right = a.T @ a, a.T @ b
    x, active = np.zeros(len(right)), np.zeros(len(right), bool)
    for _ in range(rounds):
        slope = right - gram @ x
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            trial = np.linalg.solve(gram[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), right[at])
            if (trial > 0).all():
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            own = x[at]
            step = np.min(own[low] / np.maximum(own[low] - trial[low], 1e-300))
            x[at] = own + step * (trial - own)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
    return x


def fit_patterns(histogram: np.ndarray, units: int = UNITS, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often each repeats to use up a histogram of lengths in units (index 0: one unit)."""
    shapes = patterns(units, few)
    matrix = np.zeros((units, len(shapes)))
    for place in range(few):
        used = shapes[:, place] > 0
        np.add.at(matrix, (shapes[used, place] - 1, np.flatnonzero(used)), 1)
    counts = least_squares(matrix, histogram.astype(float))
    some = counts > 0
    return shapes[some], counts[some]


class _Shelf:
    """Items by size, with the nearest occupied size found in a bit mask."""

    def __init__(self) -> None:
        self.items: dict[int, list[int]] = {}
        self.mask = 0

    def put(self, size: int, item: int) -> None:
        self.items.setdefault(size, []).append(item)
        self.mask |= 1 << size

    def take(self, size: int) -> int:
        own = self.items[size]
        item = own.pop()
        if not own:
            self.mask ^= 1 << size
        return item

    def at_most(self, size: int) -> int:
        return (self.mask & ((1 << (size + 1)) - 1)).bit_length() - 1

    def at_least(self, size: int) -> int:
        above = self.mask >> size
        return size + (above & -above).bit_length() - 1 if above else -1


def pack(lengths: np.ndarray, shapes: np.ndarray, counts: np.ndarray, limit: int = LIMIT, units: int = UNITS) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (from 0) and the offset in it of each length."""
    shelf = _Shelf()
    for i in np.argsort(lengths, kind="stable"):
        shelf.put(int(lengths[i]), int(i))
    sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []

    def place(size: int, at: int) -> None:
        i = shelf.take(size)
        sequence[i], offset[i] = at, limit - room[at]
        room[at] -= size

    unit = -(-limit // units)
    for shape, count in zip(shapes, counts, strict=True):
        sizes = [int(s) for s in shape if s]
        for _ in range(int(count)):
            chosen, left = [], limit
            for k, s in enumerate(sizes):
                size = shelf.at_most(left if k == len(sizes) - 1 else min(left, s * unit))
                if size <= (s - 1) * unit - (len(sizes) > 1) * unit:
                    break
                chosen.append((size, shelf.take(size)))
                left -= size
            if len(chosen) < len(sizes):  # the histogram's bin has run out here: its pieces stay residual
                for size, i in chosen:
                    shelf.put(size, i)
                break
            room.append(limit)
            for size, i in chosen:
                sequence[i], offset[i] = len(room) - 1, limit - room[-1]
                room[-1] -= size
    spare = _Shelf()
    for at, left in enumerate(room):
        if left:
            spare.put(left, at)
    while shelf.mask:
        size = shelf.mask.bit_length() - 1
        left = spare.at_least(size)
        if left < 0:
            room.append(limit)
            at = len(room) - 1
        else:
            at = spare.take(left)
        place(size, at)
        if room[at]:
            spare.put(room[at], at)
    return sequence, offset


def packed(docs: DataFrame, path: str | None = None, limit: int = LIMIT, separator: int = SEPARATOR, units: int = UNITS, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = checkpointed(pieces(docs, path, limit, separator))  # numbered and counted below, so its rows must not be made anew
    unit = -(-limit // units)
    histogram = np.zeros(units)
    for row in cut.groupBy(F.ceil(F.col("length") / unit).cast("int").alias("u")).count().collect():
        histogram[row["u"] - 1] = row["count"]
    total = int(histogram.sum())
    groups = max(1, -(-total // group))
    shapes, counts = fit_patterns(histogram, units)
    share = np.floor(BY_PATTERN * counts / groups).astype(np.int64)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        sequence, offset = pack(frame["length"].to_numpy(), shapes, share, limit, units)
        number = int(frame["dealt"].iloc[0])
        out = frame.drop(columns="dealt")
        out["sequence_id"] = number * (1 << 32) + sequence
        out["offset"] = offset
        return out

    dealt = cut.withColumn("dealt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("dealt").applyInPandas(one, schema)
