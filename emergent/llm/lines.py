"""Reversible line dedup: exact reference-count tables, and sharded cuckoo filters in front of them.

A line's key is the line without white space at its ends, A-Z lower-cased, as its 128-bit BLAKE2b digest. Three tables make an index:
``refs``, a row for each document and distinct key of at least ``MIN_CHARS`` code points; ``counts``, how many references each key has and its
first document; ``filters``, a cuckoo filter for each shard of the key space with the keys of two references or more.

``insert`` adds the references that are new to the counts, ``delete`` takes references back. Keys that thereby come to two references are
inserted into their shard's filter and those that fall below are deleted from it; the filters of all other shards stay byte for byte. A
filter that has run full is made anew, larger, from the counts of its shard; all are once the keys outgrow the number of shards fourfold.
After any sequence of changes ``strip`` gives what a fresh index over the remaining documents would give.

Scale: lines meet their shard's filter in one shuffle of digests, salted by document, so a line that a third of all documents share spreads
over ``SALTS`` groups, and a task streams its groups with one filter in memory. Survivors join the counts, which decide, by a plain join that
adaptive execution can split. Counting combines within each task before its shuffle. Filters never reach the driver.

Defined cases: a null or empty text is one empty line and stays; a document that loses every line has an empty text; rows that share a
doc_id count as one document, and each is stripped alike; rows without doc_id are never stripped and strip nothing; other columns are
carried along by ``strip``, and those named ``n_lines`` or ``n_dropped`` (in any case) give way to its counts unless ``counts`` is False.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emergent.llm.blocks import LOWER, WHITE, Block, blocks_of, release_memory
from emergent.llm.cuckoo import CuckooFilter
from emergent.session import checkpointed, ship

MIN_CHARS = 10
#: Keys that one shard's filter is sized for at first, and the groups that a shard's lines are dealt to.
SHARD_KEYS, SALTS = 50_000, 8
KEYS = ["h1", "h2"]


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and its text; an empty text has one line."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.concatenate([block.starts, breaks + 1])
    doc = np.concatenate([np.arange(block.n), block.doc_of(breaks)])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.empty_like(starts)
    last = np.append(doc[1:] != doc[:-1], True)
    ends[:-1] = starts[1:] - 1
    ends[last] = block.ends[doc[last]]
    return starts, ends, doc


def _spans(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line's key begins and ends, and whether it is long enough to count."""
    solid = ~WHITE[block.data]
    at = np.zeros(len(solid) + 1, np.int64)
    np.cumsum(solid, out=at[1:])
    where = np.flatnonzero(solid)
    low, high = at[starts], at[ends]
    full = high > low
    first, after = starts.copy(), starts.copy()
    first[full] = where[low[full]]
    after[full] = where[high[full] - 1] + 1
    chars = np.zeros(len(solid) + 1, np.int64)
    np.cumsum(block.starts_of_chars(), out=chars[1:])
    return first, after, full & (chars[after] - chars[first] >= MIN_CHARS)


def _digests(block: Block, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The digest of each key, as two signed halves."""
    found = []
    for a, b in zip(first.tolist(), after.tolist(), strict=True):
        found.append(blake2b(LOWER[block.data[a:b]].data, digest_size=16).digest())
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def references(docs: DataFrame) -> DataFrame:
    """A row (h1, h2, doc_id) for each row of docs and distinct long key in it."""
    ship(docs.sparkSession)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                starts, ends, doc = _lines(block)
                first, after, long = _spans(block, starts, ends)
                keys = _digests(block, first[long], after[long])
                rows = np.unique(np.rec.fromarrays([doc[long], keys[:, 0], keys[:, 1]], names="d,a,b"))
                owner = batch.column("doc_id").slice(block.first, block.n).take(pa.array(rows["d"]))
                yield pa.RecordBatch.from_arrays([pa.array(rows["a"].copy()), pa.array(rows["b"].copy()), owner], [*KEYS, "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(listed, f"h1 long, h2 long, doc_id {kind}")


@dataclass(frozen=True)
class LineIndex:
    """refs (h1, h2, doc_id) and counts (h1, h2, n, first_doc) are exact; filters has a row (shard, filter) for each shard that has keys."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    def repeated(self) -> DataFrame:
        return self.counts.where("n >= 2").select(*KEYS, "first_doc")


def _shard(shards: int):
    return F.pmod("h1", F.lit(shards)).cast("int").alias("shard")


def _edited(filters: DataFrame, crossing: DataFrame) -> DataFrame:
    """(shard, filter, full): filters after the crossing keys (shard, h1, come) came or went; shards without any stay as they are."""

    def edit(crossed: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        shard = int((crossed if len(crossed) else own)["shard"].iloc[0])
        if not len(crossed):
            return pd.DataFrame({"shard": [shard], "filter": [own["filter"].iloc[0]], "full": [False]})
        keys, come = crossed["h1"].to_numpy(np.int64).view(np.uint64), crossed["come"].to_numpy(bool)
        one = CuckooFilter.from_bytes(own["filter"].iloc[0]) if len(own) else CuckooFilter.for_keys(len(keys))
        one.delete(keys[~come])
        one.insert(keys[come])
        return pd.DataFrame({"shard": [shard], "filter": [one.to_bytes()], "full": [one.full()]})

    return crossing.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(edit, "shard int, filter binary, full boolean")


def _built(counts: DataFrame, shards: int) -> DataFrame:
    """Filters over the repeated keys of counts, from nothing."""
    none = counts.sparkSession.createDataFrame([], "shard int, filter binary")
    return _edited(none, counts.where("n >= 2").select(_shard(shards), "h1", F.lit(True).alias("come"))).drop("full")


def _indexed(refs: DataFrame, merged: DataFrame, before: LineIndex | None) -> LineIndex:
    """The index after a change; merged is (h1, h2, was, n, first_doc) of every key, those without references left included."""
    merged = checkpointed(merged)
    counts = merged.where("n > 0").select(*KEYS, "n", "first_doc")
    total = counts.where("n >= 2").count()
    if before is None or total > 4 * SHARD_KEYS * before.shards:
        shards = max(16, -(-total // SHARD_KEYS))
        return LineIndex(refs, counts, checkpointed(_built(counts, shards)), shards)
    crossing = merged.where("(was >= 2) <> (n >= 2)").select(_shard(before.shards), "h1", (F.col("n") >= 2).alias("come"))
    edited = checkpointed(_edited(before.filters, crossing))
    full = [r["shard"] for r in edited.where("full").select("shard").collect()]  # a few numbers of shards
    filters = edited.drop("full")
    if full:
        again = _built(counts.where(_shard(before.shards).isin(full)), before.shards)
        filters = checkpointed(filters.where(~F.col("shard").isin(full)).unionByName(again))
    return LineIndex(refs, counts, filters, before.shards)


def insert(index: LineIndex | None, docs: DataFrame) -> LineIndex:
    """The index with documents added; inserting a document again changes nothing."""
    fresh = references(docs).distinct()
    if index is not None:
        fresh = fresh.join(index.refs, [*KEYS, "doc_id"], "left_anti")
    fresh = checkpointed(fresh)
    come = fresh.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    if index is None:
        return _indexed(fresh, come.select(*KEYS, F.lit(0).cast("long").alias("was"), "n", "first_doc"), None)
    both = index.counts.withColumnsRenamed({"n": "was", "first_doc": "_first"}).join(come, KEYS, "full")
    was = F.coalesce("was", F.lit(0))
    merged = both.select(*KEYS, was.alias("was"), (was + F.coalesce("n", F.lit(0))).alias("n"), F.least("_first", "first_doc").alias("first_doc"))
    return _indexed(checkpointed(index.refs.unionByName(fresh)), merged, index)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of doc_ids (column doc_id): their references are taken back."""
    ids = doc_ids.select("doc_id").distinct()
    gone = index.refs.join(ids, "doc_id", "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_gone"))
    gone = checkpointed(gone)
    left = checkpointed(index.refs.join(ids, "doc_id", "left_anti"))
    first = left.join(gone, KEYS, "left_semi").groupBy(*KEYS).agg(F.min("doc_id").alias("_first"))
    both = index.counts.join(gone, KEYS, "left").join(first, KEYS, "left")
    first_doc = F.when(F.col("_gone").isNull(), F.col("first_doc")).otherwise(F.col("_first"))
    merged = both.select(*KEYS, F.col("n").alias("was"), (F.col("n") - F.coalesce("_gone", F.lit(0))).alias("n"), first_doc.alias("first_doc"))
    return _indexed(left, merged, index)


def _candidates(index: LineIndex, docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id) of lines that their shard's filter may hold."""
    refs = references(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    lines = refs.select(_shard(index.shards), salt.alias("salt"), *KEYS, "doc_id", F.lit(None).cast("binary").alias("filter"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    none = [F.lit(None).cast("long").alias(k) for k in KEYS]
    filters = index.filters.select("shard", salts.alias("salt"), *none, F.lit(None).cast(kind).alias("doc_id"), "filter")
    groups = ["shard", "salt"]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group's filter comes before its lines; a group without a filter has no repeated line."""
        group, one = None, None
        for batch in batches:
            at = np.column_stack([batch.column(k).to_numpy() for k in groups])
            h1, made = batch.column("h1"), batch.column("filter")
            low = 0
            while low < len(at):
                if group != (here := tuple(at[low])):
                    group, one = here, None
                same = (at[low:] == at[low]).all(axis=1)
                high = low + (int(np.argmin(same)) if not same.all() else len(same))
                if made[low].is_valid:
                    one, low = CuckooFilter.from_bytes(made[low].as_buffer()), low + 1
                if one is not None and high > low:
                    hit = one.contains(h1.slice(low, high - low).to_numpy().view(np.uint64))
                    yield batch.slice(low, high - low).select([*KEYS, "doc_id"]).filter(pa.array(hit))
                low = max(high, low)
        release_memory()

    rows = lines.unionByName(filters).repartition(*groups).sortWithinPartitions(*groups, F.col("filter").isNull())
    return rows.mapInArrow(probed, f"h1 long, h2 long, doc_id {kind}")


def strip(index: LineIndex, docs: DataFrame, counts: bool = True) -> DataFrame:
    """docs with every repeated line dropped but in its first document, and with ``counts`` n_lines and n_dropped."""
    ship(docs.sparkSession)
    later = _candidates(index, docs).join(index.repeated(), KEYS).where("doc_id <> first_doc")
    drop = "_drop"
    while drop in {c.lower() for c in docs.columns}:
        drop += "_"
    dropped = later.groupBy("doc_id").agg(F.collect_set(F.struct(*KEYS)).alias(drop))  # as many as the document has lines
    names = [c for c in docs.columns if not counts or c.lower() not in ("n_lines", "n_dropped")]
    both = docs.join(dropped, "doc_id", "left").select(*(f"`{n}`" for n in names), drop)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(drop)
            texts = batch.column("text")
            valid = texts.is_valid().to_pylist()
            out: list[str | None] = []
            totals, losses = [], []
            for block in blocks_of(texts):
                starts, ends, doc = _lines(block)
                totals.append(np.bincount(doc, minlength=block.n))
                lost = np.zeros(block.n, np.int64)
                gone: dict[int, np.ndarray] = {}
                own = drops.slice(block.first, block.n)
                hit = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
                if len(hit):
                    first, after, long = _spans(block, starts, ends)
                    edges = np.searchsorted(doc, np.arange(block.n + 1))
                    for i in hit:
                        pairs = own[int(i)].values
                        keys = set(zip(pairs.field("h1").to_pylist(), pairs.field("h2").to_pylist(), strict=True))
                        some = np.flatnonzero(long[edges[i] : edges[i + 1]]) + edges[i]
                        mark = np.zeros(edges[i + 1] - edges[i], bool)
                        mark[some - edges[i]] = [(a, b) in keys for a, b in _digests(block, first[some], after[some]).tolist()]
                        lost[i] = mark.sum()
                        gone[int(i)] = np.flatnonzero(~mark) + edges[i]
                losses.append(lost)
                for i in range(block.n):
                    if i in gone:
                        out.append(b"\n".join(block.data[starts[k] : ends[k]].tobytes() for k in gone[i]).decode("utf-8", "replace"))
                    else:
                        out.append(block.text(i) if valid[block.first + i] else None)
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(k) for k, n in enumerate(names)]
            if counts:
                columns += [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (totals, losses)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *["n_lines", "n_dropped"][: 2 * counts]])

    fields = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return both.mapInArrow(cleaned, fields + ", n_lines long, n_dropped long" * counts)


def digest(stripped: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    return stripped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
