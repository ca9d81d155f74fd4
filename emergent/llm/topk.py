"""Exact top-k search by term-at-a-time accumulation.

Components are terms and vectors are bags of them: a component x counts floor(256 * x). Candidates are packed in blocks whose postings are
dense arrays, one for each term; queries are sparse rows. A query scatters each of its weights times a term's postings into a dense score
array over a block; partition selection takes the block's best, and the best of all blocks are merged by rank.

Blocks, not rows, meet: every candidate block goes to one group of about ``HELD`` blocks, every query block to all groups, so what moves is the
candidates once and the queries once for each group. A group decodes its candidates once and streams the query blocks past them; it holds no
more than its candidates, whose number doesn't grow with the table. The merge gets k rows for each query and group, and keeps k for each
query and task before its shuffle (a limit on the window's groups).

Defined cases: a vector that is null or has a null or non-finite component takes no part, nor does a row without vec_id; vectors of different
lengths are compared over the components both have, and an empty one scores 0; rows that share the query's vec_id are its own; a query row
that repeats is answered once; ties go to the smaller vec_id; scores are exact within 63 bits, and a component whose 256-fold is 2**62 or
more is an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emergent.session import ship

CANDIDATES, QUERIES_PER_BLOCK, SCALE = 4096, 256, 256
#: Candidate blocks that a group holds at most, about.
HELD = 16
_NONE = np.iinfo(np.int64).min


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks (ids, values, width, dims) of at most ``rows`` usable vectors: int64 ids, and for each a row of integers of ``width`` bytes."""
    ship(vectors.sparkSession)

    def flush(ids: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        dims = max(v.shape[1] for v in values)
        matrix = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for v in values])
        small = not matrix.size or np.abs(matrix).max() < 1 << 31
        raw = matrix.astype(np.int32 if small else np.int64).tobytes()
        own = [pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([raw], pa.binary()), pa.array([4 if small else 8], pa.int32()), pa.array([dims], pa.int32())]
        return pa.RecordBatch.from_arrays(own, ["ids", "values", "width", "dims"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = 0
        for batch in batches:
            own, vector = batch.column("vec_id").cast(pa.int64()), batch.column("embedding")
            lengths = np.array([len(v) if v.is_valid else -1 for v in vector], np.int64)
            flat = vector.flatten()
            flat = np.asarray(flat.cast(pa.float64()).fill_null(np.nan) if flat.null_count else flat.cast(pa.float64()))
            at = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
            for length in np.unique(lengths[lengths >= 0]):
                row = np.flatnonzero((lengths == length) & own.is_valid().to_numpy(zero_copy_only=False))
                x = flat[at[row][:, None] + np.arange(length)]
                good = np.isfinite(x).all(axis=1)
                x = np.floor(SCALE * x[good])
                if x.size and np.abs(x).max() >= 2.0**62:
                    raise OverflowError("a vector's component is too large for exact scores")
                x = x.astype(np.int64)
                id_of = own.fill_null(0).to_numpy()[row[good]]
                done = 0
                while done < len(x):
                    take = min(len(x) - done, rows - held)
                    ids.append(id_of[done : done + take])
                    values.append(x[done : done + take])
                    done, held = done + take, held + take
                    if held == rows:
                        yield flush(ids, values)
                        ids, values, held = [], [], 0
        if held:
            yield flush(ids, values)

    return vectors.select("vec_id", "embedding").mapInArrow(made, "ids binary, values binary, width int, dims int")


def search_block(query: np.ndarray, query_id: int, ids: np.ndarray, postings: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of a block, by score and then by id: positions and scores. ids ascend; postings has a row for each term."""
    scores = np.zeros(len(ids), np.int64)
    for term in np.flatnonzero(query[: len(postings)]):
        scores += query[term] * postings[term].astype(np.int64, copy=False)
    own = slice(*np.searchsorted(ids, [query_id, query_id + 1]))
    left = len(ids) - (own.stop - own.start)
    scores[own] = _NONE
    k = min(k, left)
    if k <= 0:
        return np.zeros(0, np.int64), scores[:0]
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    equal = np.flatnonzero(scores == edge)[: k - len(above)]
    at = np.concatenate([above, equal])
    return at, scores[at]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector of queries its k best among vectors."""
    spark = vectors.sparkSession
    ship(spark)
    asked = queries.where("vec_id is not null").dropDuplicates(["vec_id", "embedding"])
    n_queries, n = asked.count(), vectors.count()
    n_blocks = max(1, -(-n // CANDIDATES))
    groups = max(-(-n_blocks // HELD), min(n_blocks, 2 * spark.sparkContext.defaultParallelism))
    left = packed(vectors, CANDIDATES).select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("g"), F.lit(False).alias("asks"), "*")
    sought = packed(asked.repartition(max(1, -(-n_queries // QUERIES_PER_BLOCK))), QUERIES_PER_BLOCK)
    right = sought.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(True).alias("asks"), "*")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's candidates come first; they become one set of postings when its first queries come."""
        group, held = None, []
        ids = postings = None
        for batch in batches:
            for i in range(batch.num_rows):
                g, asks, width, dims = (batch.column(name)[i].as_py() for name in ("g", "asks", "width", "dims"))
                if g != group:
                    group, held, ids, postings = g, [], None, None
                own = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                values = np.frombuffer(batch.column("values")[i].as_buffer(), np.int32 if width == 4 else np.int64).reshape(len(own), dims)
                if not asks:
                    held.append((own.copy(), values.copy()))
                    continue
                if ids is None and held:
                    ids, postings = _postings(held)
                    held = []
                if ids is None:
                    continue
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for q, row in zip(own.tolist(), values.astype(np.int64), strict=True):
                    at, scores = search_block(row, q, ids, postings, k)
                    found.append((np.full(len(at), q, np.int64), ids[at], scores))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    met = left.unionByName(right).repartition(groups, "g").sortWithinPartitions("g", "asks")
    best = met.mapInArrow(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _postings(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ids, and for each term the components of all vectors in that order."""
    ids = np.concatenate([x for x, _ in held])
    order = np.argsort(ids, kind="stable")
    dims = max(v.shape[1] for _, v in held)
    out = np.zeros((dims, len(ids)), np.result_type(*(v.dtype for _, v in held)))
    at = 0
    for own, values in held:
        out[: values.shape[1], at : at + len(own)] = values.T
        at += len(own)
    return ids[order], np.ascontiguousarray(out[:, order])
