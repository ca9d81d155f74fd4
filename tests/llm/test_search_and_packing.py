import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from helpers import unlike_twins

from emergent.llm import bpe, packing, topk

TEXTS = [
    None, "", " ", "a", "Hello world, it's  two spaces\n\nand\n lines\t!", "é ß　日本 😀\r\n", "<|endoftext|>x <|endoftext|>", "tail\n", "\nnext", "don't 123 __ %%", "same same same same", "same same same same",
    "x" * 5000, "word " * 4000, "\u0085   y", "\x00\x1c z",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_bpe_is_the_library(spark, library):
    for row in bpe.encode(frame(spark, TEXTS)).collect():
        ids = library.encode(TEXTS[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False) == (TEXTS[row["doc_id"]] or "")
        assert row["ids_sha256"] == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark, TEXTS)).select("doc_id", "ids"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encode(frame(spark, [])).count() == 0


def test_each_distinct_word_is_encoded_once(spark, library):
    words = [f" w{i}" for i in range(300)]
    texts = ["".join(words[i % 7 :]) for i in range(200)]
    encoded = spark.sparkContext.accumulator(0)
    rows = bpe.encode(frame(spark, texts).repartition(8, "doc_id"), encoded=encoded).collect()
    assert all(r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in rows) and len(rows) == len(texts)
    assert encoded.value == len(words)


def test_blocks_without_answers_and_equal_hashes(monkeypatch, library):
    import pyarrow as pa

    from emergent.llm.blocks import Block, blocks_of

    table = bpe.WordTable(bpe.read_vocabulary())
    real = Block.hashes
    for hashes in (real, lambda self, starts, ends, lower=False, key=0: real(self, starts, ends, key=key) % np.uint64(3)):
        monkeypatch.setattr(Block, "hashes", hashes)
        for block in blocks_of(pa.array(TEXTS), 64):
            ids, at = table.joined(block, {}, 5, 4)
            for i in range(block.n):
                assert ids[at[i] : at[i + 1]].tolist() == library.encode(block.text(i), add_special_tokens=False).ids


def test_repeated_rows_and_text_ids(spark, library):
    docs = spark.createDataFrame([("a", "one two two")] * 50 + [(None, None)] * 3 + [("b", "")], "doc_id string, text string")
    rows = bpe.encode(docs).collect()
    assert len(rows) == 54 and sum(r["n_tokens"] for r in rows) == 50 * len(library.encode("one two two").ids)


def test_word_table_may_start_anew(monkeypatch, library):
    import pyarrow as pa

    from emergent.llm.blocks import blocks_of

    monkeypatch.setattr(bpe, "KEPT_IDS", 4)
    monkeypatch.setattr(bpe, "SLOTS", 4)
    table = bpe.WordTable(bpe.read_vocabulary())
    for block in blocks_of(pa.array(TEXTS * 2), 64):
        ids, at = table.encode_block(block)
        for i in range(block.n):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(block.text(i), add_special_tokens=False).ids


def test_packing(spark, library):
    r = np.random.default_rng(2)
    texts = TEXTS + [" ".join(["word"] * int(n)) for n in r.integers(1, 3000, 300)]
    rows = packing.packed(frame(spark, texts), group=128).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        pieces[x["doc_id"]].append(x)
        sequences[x["sequence_id"]].append(x)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda x: x["piece"])
        assert [x["piece"] for x in own] == list(range(len(own))) and sum(x["length"] for x in own) == len(ids)
        assert len(own) == max(1, -(-len(ids) // 2048)) and all(x["length"] == 2048 for x in own[1:])
        for x in own:
            assert x["ids_crc32"] == zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes())
    for own in sequences.values():
        at = 0
        for x in sorted(own, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 2048
    least = -(-sum(x["length"] for x in rows) // 2048)
    assert len(sequences) <= 1.03 * least + 3
    assert packing.packed(frame(spark, [])).count() == 0


def test_least_squares_is_a_minimum():
    r = np.random.default_rng(4)
    a, b = np.abs(r.normal(size=(12, 30))), np.abs(r.normal(size=12))
    x = packing.least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope < 1e-6).all() and abs(slope[x > 0]).max() < 1e-5


def test_patterns_fill_a_sequence_exactly():
    shapes = packing.patterns(16, 3)
    assert (shapes.sum(axis=1) == 16).all() and len(np.unique(shapes, axis=0)) == len(shapes)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def brute(rows, k):
    good = {i: np.floor(256 * np.array(v, float)).astype(np.int64) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    out = set()
    for q in (i for i in good if i % 50 == 0):
        score = lambda i: int(good[q][: len(good[i])] @ good[i][: len(good[q])])
        best = sorted((i for i in good if i != q), key=lambda i: (-score(i), i))[:k]
        out |= {(q, n + 1, i, score(i)) for n, i in enumerate(best)}
    return out


def test_top_k(monkeypatch, spark):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=6).round(1).tolist(), 0) for i in range(150)]
    rows += [(200, [0.5] * 6, 0), (201, [0.5] * 6, 0), (202, [0.5] * 6, 0), (203, None, 0), (204, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (250, [float("nan")] * 6, 0), (205, [float("inf")] + [0.0] * 5, 0), (None, [9.0] * 6, 0), (206, [], 0), (207, [0.5, 0.5], 0), (300, [0.0] * 6, 0)]
    frame_ = vectors(spark, rows)
    found = {tuple(x) for x in topk.top_k(frame_, frame_.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == brute(rows, 5)
    few = vectors(spark, rows[:1] + rows[3:5])
    assert topk.top_k(few, few.where("vec_id % 50 = 0")).count() == 2
    assert topk.top_k(vectors(spark, []), vectors(spark, [])).count() == 0
