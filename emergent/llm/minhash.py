"""Near-duplicates by bottom-k sketches, verified exactly.

A document is the set of its distinct word shingles (64-bit hashes, keyed at random for each call, so texts can't be made to collide). One
hash function gives every set a sketch: its ``K`` smallest values.

1. Documents of equal sets form a class, stood for by its smallest doc_id; copies go no further.
2. Inverted lists of the retained values generate candidates. Two sets as similar as asked share at least ``overlap_needed`` of their
   sketch values (but with a chance below ``MISS``), so of each sketch only the rarest K - needed + 1 values, by their corpus-wide counts,
   need lists: similar sets meet in one of them, and values that many documents share (licences, boilerplate) hardly ever are among them.
3. Every list has a head: the member whose values are seen most often, which of a text and its edited copies is the text. Each member is
   compared with the heads of its lists only. The union sketch estimates the Jaccard index and filters pairs that can't reach it; exact
   sets verify the others. Links give components.
4. Two members of one list belong to the group of its head. Groups whose members are still in several components are compared across
   components: members outside the group's largest component against all members, with whole sets, in blocks of at most about ``BLOCK`` by
   ``BLOCK`` sets, whose intersections are one product of incidence matrices. A block gives one link for each two components. So no link
   between different components goes unseen, and the pairs inside a component are never formed.

Nothing about documents, links or components is collected on the driver; each round is checkpointed in the shared folder. Lists are only
joined (adaptive execution splits hot ones) or reduced with partial aggregation; joins on heads, neighbours and labels, any of which may hold
a third of all rows, are salted.

Defined cases: a text that is null or has no words has an empty set and is linked with nothing; fewer words than a shingle make one
shingle; rows that share a doc_id are linked with each other; a row without doc_id takes no part, has a null component and is kept; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emergent.llm.blocks import FIXED, blocks_of, chained, mix, random_key
from emergent.session import checkpointed, ship

#: Values in a sketch; the chance to miss a link at exactly the threshold; members of a block of comparisons.
K, MISS, BLOCK = 32, 1e-8, 512
#: Values of all sets of a block together, about, and of those that are multiplied at once.
BLOCK_VALUES, SLICE = 400_000, 8192
#: Groups that the rows of a key are dealt to in joins whose key may be hot.
SALTS = 8
_PAD = np.uint64(0xFFFFFFFFFFFFFFFF)


def overlap_needed(share: float, k: int = K, miss: float = MISS) -> int:
    """The most shared values of two union sketches that sets of this Jaccard index fall short of with a chance below ``miss``."""
    tail = 0.0
    for c in range(k + 1):
        tail += comb(k, c) * share**c * (1 - share) ** (k - c)
        if tail > miss:
            return c
    return k


def _shingle_sets(block, words: int, key: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    h, bounds = block.word_hashes(lower=True, key=key), block.word_bounds
    windows = chained([h[i : len(h) - words + 1 + i] for i in range(words)]) if len(h) >= words else h[:0]
    for i in range(block.n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b - a >= words:
            yield np.unique(windows[a : b - words + 1])
        elif b > a:
            yield chained([h[j : j + 1] for j in range(a, b)])
        else:
            yield h[:0]


def sketches(docs: DataFrame, words: int, key: int = FIXED, k: int = K) -> DataFrame:
    """doc_id, n (set size), two hashes of the set, and the sketch (k values, padded)."""
    ship(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                sizes, one, two, low = [], [], [], []
                for s in _shingle_sets(block, words, key):
                    sizes.append(len(s))
                    one.append(s.sum(dtype=np.uint64))
                    two.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    sketch = s[:k]
                    low.append((np.concatenate([sketch, np.full(k - len(sketch), _PAD)]) if len(sketch) < k else sketch).tobytes())
                hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.n), pa.array(sizes, pa.int64()), *hashes, pa.array(low, pa.binary())], ["doc_id", "n", "h1", "h2", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, n long, h1 long, h2 long, sketch binary")


def _union_passes(a: np.ndarray, b: np.ndarray, needed: int, num: int, den: int) -> np.ndarray:
    """Which pairs of sketches (rows) may reach the threshold, by the sketch of their union; exact where that is the whole union."""
    k = a.shape[1]
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _PAD)
    new = np.concatenate([np.ones((len(both), 1), bool), ~again], axis=1) & (both != _PAD)
    rank = np.cumsum(new, axis=1)
    total = rank[:, -1]
    common = (again & (rank[:, 1:] <= k)).sum(axis=1)
    whole = total < k
    return np.where(whole, den * common >= num * total, common >= needed)


def _sketch_rows(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, k) if len(column) else np.zeros((0, k), np.uint64)


def _lists(classes: DataFrame, needed: int, num: int, den: int, k: int = K) -> DataFrame:
    """(v, cid, n, known): the inverted lists that similar sets are sure to meet in; known is how often a set's values are seen at all."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _sketch_rows(batch.column("sketch"), k)
            own = rows != _PAD
            at = pa.array(np.repeat(np.arange(len(rows)), own.sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(at), batch.column("n").take(at), pa.array(rows[own].view(np.int64))], ["cid", "n", "v"])

    kind = classes.schema["cid"].dataType.simpleString()
    rows = classes.mapInArrow(values, f"cid {kind}, n long, v long")
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = rows.join(counts, "v").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("seen"), F.sum("df").alias("known"))  # at most k
    small = F.ceil(F.col("n") * den / num) <= k  # then all partners' sketches are whole sets too
    length = F.when(small, F.col("n") - F.ceil(F.col("n") * num / den) + 1).otherwise(F.least(F.lit(k - needed + 1), F.col("n")))
    unseen = F.least(F.lit(k), F.col("n")) - F.size("seen")  # values of this set alone are its rarest
    left = held.withColumn("left", (length - unseen).cast("int")).where("left > 0")
    return left.select("cid", "n", "known", F.explode(F.slice("seen", F.lit(1), F.col("left"))["v"]).alias("v"))


def _estimated(pairs: DataFrame, classes: DataFrame, needed: int, num: int, den: int, k: int = K) -> DataFrame:
    """The pairs (a, b) whose union sketch lets them pass."""
    sk = classes.select("cid", "sketch")
    full = pairs.join(sk.withColumnsRenamed({"cid": "b", "sketch": "sb"}), "b").join(sk.withColumnsRenamed({"cid": "a", "sketch": "sa"}), "a")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _union_passes(_sketch_rows(batch.column("sa"), k), _sketch_rows(batch.column("sb"), k), needed, num, den)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    kind = classes.schema["cid"].dataType.simpleString()
    return full.select("a", "b", "sa", "sb").mapInArrow(passed, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, num: int, den: int, key: int) -> DataFrame:
    """The pairs whose full sets have den * intersection >= num * union."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    full = _sets(docs, pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), words, key)
    joined = pairs.join(full.withColumnsRenamed({"cid": "b", "own": "sb"}), "b").join(full.withColumnsRenamed({"cid": "a", "own": "sa"}), "a")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "sa", "sb").mapInArrow(checked, f"a {kind}, b {kind}").distinct()


def _salted(rows: DataFrame, unique: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with a table that has each key once; a key's rows are dealt to SALTS groups by another column."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(cid, label) of every vertex of the links (a, b): the smallest vertex reachable. Labels move along links and jump to labels."""
    edges = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("cid")).agg(F.min("b").alias("m")).select("cid", F.least("cid", "m").alias("label")))
    while True:
        near = _salted(edges, labels.withColumnsRenamed({"cid": "b"}), "b", "a").groupBy(F.col("a").alias("cid")).agg(F.min("label").alias("m"))
        moved = labels.join(near, "cid").select("cid", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        target = labels.select(F.col("cid").alias("label"), F.col("label").alias("onward"))
        jumped = checkpointed(_salted(moved, target, "label", "cid").select("cid", "was", F.least("label", "onward").alias("label")))
        labels = jumped.select("cid", "label")
        if jumped.where("label <> was").isEmpty():
            return labels


def _sets(docs: DataFrame, wanted: DataFrame, words: int, key: int) -> DataFrame:
    """(cid, own): the whole sets of the wanted documents (column cid), as sorted 64-bit values."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks_of(batch.column("text")):
                own = [s.tobytes() for s in _shingle_sets(block, words, key)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, block.n), pa.array(own, pa.binary())], ["cid", "own"])

    return docs.select("doc_id", "text").join(wanted.withColumnRenamed("cid", "doc_id"), "doc_id", "left_semi").mapInArrow(sets, f"cid {kind}, own binary")


def _across(groups: DataFrame, labels: DataFrame, docs: DataFrame, words: int, num: int, den: int, key: int) -> DataFrame:
    """Links (a, b) between components within groups (head, cid, n): one for each two components that a block finds linked."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    labelled = groups.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    parts = labelled.groupBy("head", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    top = F.max(F.struct("c", "w", "label")).alias("top")
    whole = parts.groupBy("head").agg(F.sum("c").alias("m"), F.sum("w").alias("mw"), top, F.count(F.lit(1)).alias("labels")).where("labels > 1")
    chunks = lambda count, weight: F.greatest(F.ceil(count / BLOCK), F.ceil(weight / BLOCK_VALUES)).cast("int")
    outside, every = chunks(F.col("m") - F.col("top.c"), F.col("mw") - F.col("top.w")), chunks(F.col("m"), F.col("mw"))
    open_groups = whole.select("head", F.col("top.label").alias("main"), outside.alias("ni"), every.alias("nj"))
    member = _salted(labelled, open_groups, "head", "cid")
    chunk = lambda count: F.pmod(F.xxhash64("cid"), F.col(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = member.where("label <> main").select("head", "cid", "label", F.lit(True).alias("side"), chunk("ni").alias("i"), spread("nj").alias("j"))
    right = member.select("head", "cid", "label", F.lit(False).alias("side"), spread("ni").alias("i"), chunk("nj").alias("j"))
    rows = checkpointed(left.unionByName(right))
    full = rows.join(_sets(docs, rows.select("cid").distinct(), words, key), "cid")
    keys = ["head", "i", "j"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys, the outside members first; a run may span batches."""
        held: list[pa.RecordBatch] = []
        for batch in _then_none(batches):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held or (batch is not None and not batch.num_rows):
                continue
            table = pa.Table.from_batches(held)
            key = np.column_stack([table.column(k).to_numpy() for k in keys])
            start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            ends = np.append(start[1:], len(key))
            held = []
            if batch is not None:  # the last run may go on
                held = table.slice(int(start[-1])).to_batches()
                start, ends = start[:-1], ends[:-1]
            for low, high in zip(start.tolist(), ends.tolist(), strict=True):
                run = table.slice(low, high - low)
                side, cid, label = (run.column(c).to_numpy() for c in ("side", "cid", "label"))
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in run.column("own")]
                n = int(side.sum())
                x, y = _linked(sets[:n], sets[n:], label[:n], label[n:], num, den)
                if len(x):
                    pair = np.unique(np.column_stack([np.minimum(label[x], label[n + y]), np.maximum(label[x], label[n + y])]), axis=0, return_index=True)[1]
                    x, y = cid[x[pair]], cid[n + y[pair]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    ordered = full.select(*keys, "side", "cid", "label", "own").repartition(*keys).sortWithinPartitions(*keys, F.desc("side"))
    return ordered.mapInArrow(compared, f"a {kind}, b {kind}").distinct()


def _linked(left: list[np.ndarray], right: list[np.ndarray], own: np.ndarray, other: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets of different labels with den * intersection >= num * union: exact intersections as a product of incidences."""
    if not left or not right:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    values, owners = zip(*((np.concatenate(side), np.repeat(np.arange(len(side)), n)) for side, n in zip((left, right), sizes, strict=True)), strict=True)
    shared = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.float32)  # counts below 2**24 are exact
    places = []
    for v in values:
        at = np.minimum(np.searchsorted(shared, v), max(len(shared) - 1, 0))
        places.append(np.where(shared[at] == v, at, -1) if len(shared) else np.full(len(v), -1))
    for low in range(0, len(shared), SLICE):
        width = min(SLICE, len(shared) - low)
        incidence = []
        for place, owner, side in zip(places, owners, (left, right), strict=True):
            some = (place >= low) & (place < low + width)
            one = np.zeros((len(side), width), np.float32)
            one[owner[some], place[some] - low] = 1
            incidence.append(one)
        both += incidence[0] @ incidence[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return np.nonzero((den * both.astype(np.float64) >= num * union) & (own[:, None] != other[None, :]))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; documents with den * intersection >= num * union are linked."""
    needed, key = overlap_needed(num / den), random_key()
    docs = docs.select("doc_id", "text")
    made = checkpointed(sketches(docs, words, key))
    usable = made.where("n > 0 and doc_id is not null")
    classes = checkpointed(usable.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("cid"), F.first("sketch").alias("sketch")))
    lists = checkpointed(_lists(classes.select("cid", "n", "sketch"), needed, num, den))
    first_known = F.min(F.struct((-F.col("known")).alias("known"), "cid", "n")).alias("top")
    heads = lists.groupBy("v").agg(first_known, F.count(F.lit(1)).alias("m")).where("m > 1").select("v", F.col("top.cid").alias("head"), F.col("top.n").alias("head_n"))
    groups = checkpointed(lists.join(heads, "v").select("head", "head_n", "cid", "n").distinct())
    near_size = (F.col("n") * den >= F.col("head_n") * num) & (F.col("head_n") * den >= F.col("n") * num)
    stars = groups.where("cid <> head").where(near_size).select(F.col("head").alias("a"), F.col("cid").alias("b"))
    first = checkpointed(_verified(checkpointed(_estimated(stars, classes, needed, num, den)), docs, words, num, den, key))
    labels = components(first)
    second = checkpointed(_across(groups.select("head", "cid", "n"), labels, docs, words, num, den, key))
    if not second.isEmpty():
        labels = components(first.union(second))
    keyed = classes.join(labels, "cid", "left").select("n", "h1", "h2", F.coalesce("label", "cid").alias("component_id"))
    out = made.drop("sketch").join(keyed, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
