"""BPE encoding and decoding of whole texts through a table of distinct words.

A block of texts is split into *words* at places where the byte-level pre-tokenizer always starts a new piece, so that each word can be
encoded by itself: before a space, and before and after a newline, that is followed by a byte that surely is not white space. Each block
sends its distinct words, packed, to the shards of the word table; a shard, all of it in one task, encodes each of its distinct words once
and sends the ids back to the blocks that asked; a block joins them to its positions by number. The blocks themselves travel compressed
to where their ids arrive. Equal words are found by a hash keyed at random for each call, and bytes are compared. Decoding joins ids with
a table of pieces. Words of ASCII and Latin-1 letters are encoded by tiktoken over the same vocabulary where its merge ranks are its ids
(about eight times as fast), all others by the tokenizers library. Only texts holding a special token's string, which the library treats
apart from words, are encoded whole.

A block's name is a digest of its rows, so the two passes over the documents need not agree on partitions: equal names mean equal words.
Words that no shard answers (the documents came in another order the second time) are encoded where the block is. The number of shards
grows with the table's size, so a shard's words fit in a worker; a hot word is one entry in each block, however often it stands there.

Packing (`packing.py`) uses ``WordTable.encode_block`` instead, the same words with a bounded table in each worker and no shuffle.

Defined cases: a null or empty text has no tokens and decodes to an empty text; repeated rows are encoded alike; very long texts are
blocks of their own; other columns are ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emergent.llm.blocks import Block, blocks_of, mix, random_key, release_memory
from emergent.session import ship

#: Slots of a worker's table of words; a word that finds its slot taken is encoded again in each block that holds it.
SLOTS = 1 << 20
#: Words, their bytes and their ids that a worker keeps; words met later are encoded for their block alone. Bounds a worker's memory.
KEPT_WORDS, KEPT_BYTES, KEPT_IDS = 1 << 18, 1 << 22, 1 << 20
#: Bytes and rows of a block that asks for its words at once: the larger, the fewer words travel.
ASK_BYTES, ASK_ROWS = 1 << 23, 1 << 14
#: Bytes of the stored table for each shard of the word table; there are FEWEST shards at least.
SHARD_BYTES, FEWEST = 1 << 22, 16
#: The shard number of texts: after all shards, so that a block's ids come before its texts.
TEXTS = (1 << 31) - 1

_sure = np.zeros(256, bool)  # bytes that cannot begin a white-space character
_sure[0x21:0x7F] = True
_sure[0xC3:0xE1] = True
_sure[0xE4:0xF5] = True

#: Bytes of words that both libraries surely split alike: ASCII without controls but newline, and the letters U+00C0 to U+00FF.
_LATIN = bytes([0x0A, *range(0x20, 0x7F), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))])


def default_path() -> str:
    """The vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: visible Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class WordTable:
    """Encodes blocks of texts; keeps each distinct word's ids."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(content)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        alphabet = _byte_alphabet()
        pieces: dict[int, bytes] = {i: bytes(alphabet[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if all(c in alphabet for c in piece)}
        pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        size = max(pieces) + 1
        parts = [pieces.get(i, b"") for i in range(size)]
        self.piece_at = np.zeros(size + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.piece_at[1:])
        self.piece_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.fast = self._fast(spec, {p: i for i, p in pieces.items()})
        self.clear()

    def _fast(self, spec: dict, ids: dict[bytes, int]):
        """tiktoken's encoder of a single word, if the vocabulary's merges are ranked by the ids they make."""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        made = [vocab.get(a + b, -1) for a, b in pairs]
        if spec["normalizer"] or made != sorted(set(made)) or -1 in made or spec["pre_tokenizer"].get("add_prefix_space"):
            return None
        import tiktoken

        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {p: i for p, i in ids.items() if p and p.decode("utf-8", "replace") not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        if self.fast is None:
            slow = range(len(words))
            out: list = [None] * len(words)
        else:
            slow = [i for i, w in enumerate(words) if w.translate(None, _LATIN)]
            fast = self.fast
            skip = set(slow)
            out = [None if i in skip else fast(w.decode("utf-8", "replace")) for i, w in enumerate(words)]
        texts = [words[i].decode("utf-8", "replace") for i in slow]
        for i, e in zip(slow, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def clear(self) -> None:
        self.stale = False
        self.slot = np.full(SLOTS, -1, np.int32)
        self.words = self.n_bytes = self.n_ids = 0
        self.key = random_key()
        # Of each word: hash, where its bytes and its ids begin, and how many they are.
        self.hash, self.byte_at, self.id_at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.byte_size, self.id_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write values into a column from ``at`` on, in a larger array if need be."""
        column = getattr(self, name)
        if len(column) < at + len(values):
            larger = np.zeros(max(2 * len(column), at + len(values), 1 << 12), column.dtype)
            larger[:at] = column[:at]
            column = larger
            setattr(self, name, column)
        column[at : at + len(values)] = values

    def encode_block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a block, and where each text's ids begin (one entry more than texts)."""
        if self.stale or len(self.ids) > 4 * KEPT_IDS or len(self.bytes) > 4 * KEPT_BYTES:  # also after a huge text of rare words
            self.clear()
        starts, ends = cut_words(block)
        word_ids, lengths = self._look_up(block, starts, ends)
        bounds = np.append(np.searchsorted(starts, block.starts), len(starts))
        sums = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=sums[1:])
        ids = ragged(self.ids, self.id_at[word_ids], lengths)
        doc_at = sums[bounds]
        if any(s in block.data.tobytes() for s in self.special):
            return self._with_special(block, ids, doc_at)
        return ids, doc_at

    def joined(self, block: Block, answers: dict[int, tuple[int, bytes]], key: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode_block, by the ids that shards sent for the block's distinct words."""
        starts, ends = cut_words(block)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(block.n + 1, np.int64)
        h, first, back = distinct_words(block, starts, ends, key)
        order, bounds, to = _by_shard(h, shards)
        lengths, parts = [], []
        for shard, a, b in zip(to.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if shard in answers and answers[shard][0] == b - a:
                size, ids = _unpack(answers[shard][1], b - a, "<u4")
            else:  # the block was another when it asked
                found = self.encode_words([block.data[starts[i] : ends[i]].tobytes() for i in first[order[a:b]].tolist()])
                size, ids = np.fromiter(map(len, found), np.int64, b - a), np.fromiter((i for e in found for i in e), np.uint32)
            lengths.append(size)
            parts.append(ids)
        sizes, ids, id_at, id_size = np.concatenate(lengths), np.concatenate(parts), np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        id_size[order], id_at[order] = sizes, np.cumsum(sizes) - sizes
        each = id_size[back]
        sums = np.append(0, np.cumsum(each))
        doc_at = sums[np.append(np.searchsorted(starts, block.starts), len(starts))]
        ids = ragged(ids, id_at[back], each)
        if any(s in block.data.tobytes() for s in self.special):
            return self._with_special(block, ids, doc_at)
        return ids, doc_at

    def _look_up(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table's number of each word and how many ids it has; words that are not kept stand behind those that are, for this block."""
        h, sizes = block.hashes(starts, ends, key=self.key), ends - starts
        found = self.slot[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.int64)
        known = found >= 0
        if known.any():
            known &= (self.hash[found] == h) & (self.byte_size[found] == sizes)
            known[known] = self._same_bytes(block, starts[known], sizes[known], found[known])
        missing = np.flatnonzero(~known)
        if len(missing):
            raw = block.data.tobytes()
            number: dict[bytes, int] = {}
            firsts = []
            back = np.empty(len(missing), np.int64)
            for k, (i, a, b) in enumerate(zip(missing.tolist(), starts[missing].tolist(), ends[missing].tolist(), strict=True)):
                back[k] = n = number.setdefault(raw[a:b], len(number))
                if n == len(firsts):
                    firsts.append(i)
            found[missing] = self.words + back
            self._add(h[np.array(firsts)], list(number), len(missing) / len(starts))
        return found, self.id_size[found]

    def _same_bytes(self, block: Block, starts: np.ndarray, sizes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Whether words are byte for byte those that their hashes name."""
        equal = ragged(block.data, starts, sizes) == ragged(self.bytes, self.byte_at[found], sizes)
        if equal.all():
            return np.ones(len(starts), bool)
        return np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)  # no word is empty

    def _add(self, h: np.ndarray, words: list[bytes], share: float) -> None:
        """Encode words and write them behind those that are kept; keep them if there is room."""
        encoded = self.encode_words(words)
        byte_size, id_size = np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(len, encoded), np.int64, len(words))
        n_bytes, n_ids = int(byte_size.sum()), int(id_size.sum())
        columns = {
            "hash": (self.words, h), "byte_size": (self.words, byte_size), "id_size": (self.words, id_size),
            "byte_at": (self.words, self.n_bytes + np.cumsum(byte_size) - byte_size), "id_at": (self.words, self.n_ids + np.cumsum(id_size) - id_size),
            "bytes": (self.n_bytes, np.frombuffer(b"".join(words), np.uint8)), "ids": (self.n_ids, np.fromiter((i for e in encoded for i in e), np.uint32, n_ids)),
        }
        for name, (at, values) in columns.items():
            self._put(name, at, values)
        if self.words + len(words) <= KEPT_WORDS and self.n_bytes + n_bytes <= KEPT_BYTES and self.n_ids + n_ids <= KEPT_IDS:
            place = (h & np.uint64(SLOTS - 1)).astype(np.int64)
            free = np.flatnonzero(self.slot[place] < 0)
            self.slot[place[free]] = self.words + free
            self.words, self.n_bytes, self.n_ids = self.words + len(words), self.n_bytes + n_bytes, self.n_ids + n_ids
        else:
            self.stale = share > 0.5  # the texts are others than those that filled the table

    def _with_special(self, block: Block, ids: np.ndarray, doc_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(block.n):
            raw = block.raw(i)
            if any(s in raw for s in self.special):
                parts.append(np.array(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(ids[doc_at[i] : doc_at[i + 1]])
        at = np.zeros(block.n + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return np.concatenate(parts) if parts else ids[:0], at

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, through the table of pieces; bytes that aren't UTF-8 become U+FFFD."""
        lengths = self.piece_at[ids.astype(np.int64) + 1] - self.piece_at[ids]
        raw = ragged(self.piece_bytes, self.piece_at[ids], lengths).tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


def cut_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a block begin and end; they cover all its bytes."""
    data = block.data
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        sure = _sure[data]
        sure[block.starts[block.starts < len(data)]] = False  # what follows belongs to another text
        sure = sure[1:]
        cut[:-1] = (data[:-1] == 0x20) & sure
        newline = (data[:-1] == 0x0A) & sure
        cut[:-1] |= newline
        cut[1:] |= newline
    cut[block.starts[block.ends > block.starts]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data))[: len(starts)]


def distinct_words(block: Block, starts: np.ndarray, ends: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word of a block its hash and a position where it stands, and the number of each position's word."""
    h = block.hashes(starts, ends, key=key)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    sizes, step = ends - starts, 1 << 16
    equal = bool((sizes == sizes[first][back]).all())
    for low in range(0, len(starts) if equal else 0, step):
        part = slice(low, low + step)
        own = block.data[starts[low] : ends[part][-1]]
        equal = equal and bool((own == ragged(block.data, starts[first][back[part]], sizes[part])).all())
    if not equal:  # other words with an equal hash
        raw = block.data.tobytes()
        number: dict[bytes, int] = {}
        back = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(back, return_index=True)[1]
    return h[first], first, back


def ragged(values: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[at : at + length] of each pair, end to end."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    full = lengths > 0
    at, lengths = at[full], lengths[full]
    step = np.ones(total, np.int64)
    step[0] = at[0]
    ends = np.cumsum(lengths)[:-1]
    step[ends] = at[1:] - at[:-1] - lengths[:-1] + 1
    return values[np.cumsum(step)]


@lru_cache(maxsize=2)
def word_table(content: str) -> WordTable:
    """One table for each vocabulary and worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTable(content)


def read_vocabulary(path: str | None = None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def _pack(*parts: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 3)


def _unpack(payload: bytes, n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The n lengths that begin a payload, and what follows them."""
    raw = zstandard.decompress(payload)
    return np.frombuffer(raw, "<u4", n).astype(np.int64), np.frombuffer(raw, kind, offset=4 * n)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, pa.Array, Block]]:
    """The blocks of a task with their names, digests of their rows and of their number in the task, and their doc_ids."""
    number = 0
    for batch in batches:
        for block in blocks_of(batch.column("text"), ASK_BYTES, ASK_ROWS):
            ids = batch.column("doc_id").slice(block.first, block.n)
            name = blake2b(repr((number, ids.to_pylist())).encode(), digest_size=16)
            name.update(block.ends.tobytes())
            name.update(block.data)
            number += 1
            yield name.digest(), ids, block


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _answers(asked: DataFrame, shared, encoded: Accumulator | None) -> DataFrame:
    """The ids of asked words, in the order in which each block asked; a shard encodes a word once."""
    out = pa.schema([("block", pa.binary()), ("shard", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(shared.value)
        shard, known = None, {}
        for batch in batches:
            payloads = []
            for row_shard, n, payload in zip(batch.column("shard").to_pylist(), batch.column("n").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if row_shard != shard:
                    shard, known = row_shard, {}
                sizes, data = _unpack(payload, n, "u1")
                raw, ends = data.tobytes(), np.cumsum(sizes)
                words = [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                new = [w for w in words if w not in known]
                for w, ids in zip(new, table.encode_words(new), strict=True):
                    known[w] = array("I", ids).tobytes()
                if encoded is not None:
                    encoded.add(len(new))
                found = [known[w] for w in words]
                lengths = np.fromiter(map(len, found), np.uint32, n) // 4
                payloads.append(_pack(lengths.astype("<u4"), np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("shard"), batch.column("n"), pa.array(payloads, pa.binary())], schema=out)

    return asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(answered, "block binary, shard int, n long, payload binary")


def encode(docs: DataFrame, path: str | None = None, keep: bool = True, encoded: Accumulator | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded and decoded_sha256 of each row; without the arrays and texts unless ``keep``.

    ``path`` is the vocabulary file on the driver; its content (of a fixed size) is broadcast, so executors need no such file.
    ``encoded`` counts the words that shards encode.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(path))
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    shards, key = max(FEWEST, min(stored // SHARD_BYTES, 1 << 30)), random_key()
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    asks = pa.schema([("block", pa.binary()), ("shard", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, block in _named(batches):
            starts, ends = cut_words(block)
            if not len(starts):
                continue
            h, first, _ = distinct_words(block, starts, ends, key)
            order, bounds, to = _by_shard(h, shards)
            first = first[order]
            sizes = (ends - starts)[first]
            data, at = ragged(block.data, starts[first], sizes), np.append(0, np.cumsum(sizes))
            cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            payloads = [_pack(sizes[a:b].astype("<u4"), data[at[a] : at[b]]) for a, b in cuts]
            yield _batch(asks, [name] * len(cuts), to, [b - a for a, b in cuts], payloads)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, block in _named(batches):
            payload = _pack((block.ends - block.starts).astype("<u4"), block.data)
            docs_at = pa.ListArray.from_arrays(pa.array([0, block.n], pa.int32()), ids)
            columns = {"block": pa.array([name], pa.binary()), "shard": pa.array([TEXTS], pa.int32()), "n": pa.array([block.n], pa.int64()), "payload": pa.array([payload], pa.binary()), "doc_ids": docs_at}
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(shared.value)
        name, answers = None, {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "shard", "n", "payload")]
            for i, (row_name, shard, n, payload) in enumerate(zip(*columns, strict=True)):
                if row_name != name:
                    name, answers = row_name, {}
                if shard != TEXTS:
                    answers[shard] = (n, payload)
                    continue
                sizes, data = _unpack(payload, n, "u1")
                ends = np.cumsum(sizes)
                ids, at = table.joined(Block(0, data, ends - sizes, ends), answers, key, shards)
                yield _encoded_rows(table, batch.column("doc_ids")[i].values, ids, at, keep)
            release_memory()

    words = _answers(rows.mapInArrow(asked, "block binary, shard int, n long, payload binary"), shared, encoded)
    texts = rows.mapInArrow(carried, f"block binary, shard int, n long, payload binary, doc_ids array<{kind}>")
    both = words.withColumn("doc_ids", F.lit(None).cast(f"array<{kind}>")).unionByName(texts)
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return both.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(joined, schema)


def _encoded_rows(table: WordTable, doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray, keep: bool) -> pa.RecordBatch:
    each = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    columns = {"doc_id": doc_ids, "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_sha256": pa.array([sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], pa.string())}
    if keep:
        texts = [table.decode(x) for x in each]
        columns["decoded_sha256"] = pa.array([sha256(x).hexdigest() for x in texts], pa.string())
        columns["ids"] = pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
        columns["decoded"] = pa.array([x.decode() for x in texts], pa.string())
    else:
        columns["decoded_sha256"] = pa.array([sha256(table.decode(x)).hexdigest() for x in each], pa.string())
    return pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _by_shard(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of distinct words by shard, where each shard's words begin in it, and the shards."""
    to = (mix(h) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    found, firsts = np.unique(to[order], return_index=True)
    return order, np.append(firsts, len(h)), found


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (array of int; null: empty)."""
    ship(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(shared.value)
        for batch in batches:
            texts = [table.decode(np.asarray(x.values if x.is_valid else [], np.int64)).decode() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
