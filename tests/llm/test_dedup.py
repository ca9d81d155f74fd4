import random

import numpy as np
import pytest
from helpers import components, strip_lines, unlike_twins

from emergent.llm import lines, minhash
from emergent.llm.cuckoo import CuckooFilter

SCHEMA = "doc_id long, text string, lang string, n long"


def frame(spark, docs):
    """Documents with other columns, one of them named like one that the operators make."""
    return spark.createDataFrame([(d, t, None, 7) for d, t in docs], SCHEMA)


def corpus(seed=3, families=6, size=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    licence = " ".join(word() for _ in range(30))
    docs, n = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One "), (5, "two words"), (6, "x " * 20_000)], 7
    for _ in range(families):
        base = [word() for _ in range(60)]
        for k in range(size):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 9])):
                own[r.randrange(len(own))] = word()
            docs.append((n, " ".join(own) + (f" {licence}" if k % 3 == 0 else "")))
            n += 1
    return docs


@pytest.mark.parametrize(("words", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_are_the_brute_force_components(spark, words, num):
    docs = corpus()
    found = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, docs), words, num, 100).collect()}
    expected = components(docs, words, num, 100)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == expected
    assert all(r["kept"] == (d == r["component_id"]) for d, r in found.items())


def test_near_duplicates_of_nothing_and_of_rows_without_id(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = minhash.near_duplicates(frame(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "a b c d e f")])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows if r["doc_id"]) == [(2, 2, True), (2, 2, True), (5, 2, False)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]


def test_blocks_find_what_heads_miss(monkeypatch, spark):
    """With blocks of two, links between members that no head has still count."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    docs = corpus(seed=9, families=2, size=14)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, docs), 3, 85, 100).collect()}
    assert found == {d: c for d, (_, c) in components(docs, 3, 85, 100).items()}


def test_overlap_needed_misses_almost_nothing():
    c = minhash.overlap_needed(0.85)
    draws = np.random.default_rng(1).binomial(minhash.K, 0.85, 1_000_000)
    assert (draws < c).sum() == 0 and c > 8


LINES = [
    (0, "A shared line here\nown\nA shared line here"), (1, None), (2, "  a SHARED line here \nshort\nshort"), (3, "short\nanother common line\n\n"), (4, "another common line"), (5, ""),
    (6, "A shared line here"), (7, "ééééééééé\nééééééééé"), (8, "ééééééééé"), (9, "éééééééééé"), (10, "éééééééééé\r"), (11, "only mine, and twice\nonly mine, and twice"), (12, "x" * 200_000 + "\nanother common line"),
]


def stripped(index, docs):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"] or "") for r in lines.strip(index, docs).collect()}


def test_line_dedup(spark):
    docs = frame(spark, LINES)
    index = lines.insert(None, docs)
    assert stripped(index, docs) == strip_lines(LINES)
    assert lines.strip(index, docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert lines.strip(lines.insert(None, frame(spark, [])), frame(spark, [])).count() == 0


def test_line_dedup_is_reversible(spark):
    first, second = LINES[:5], LINES[5:]
    index = lines.insert(lines.insert(None, frame(spark, first)), frame(spark, second))
    assert stripped(index, frame(spark, LINES)) == strip_lines(LINES)
    less = lines.delete(index, spark.createDataFrame([(0,), (3,)], "doc_id long"))
    left = [x for x in LINES if x[0] not in (0, 3)]
    assert stripped(less, frame(spark, left)) == strip_lines(left)
    back = lines.insert(less, frame(spark, [LINES[0], LINES[3]]))
    assert stripped(back, frame(spark, LINES)) == strip_lines(LINES)


def filter_bytes(index):
    return {r["shard"]: bytes(r["filter"]) for r in index.filters.collect()}


def test_line_changes_edit_only_the_filters_of_crossing_keys(spark):
    docs = [(d, "\n".join(f"a line of family {f}" for f in range(40) if f % 5 != d)) for d in range(5)]
    index = lines.insert(None, frame(spark, docs))
    assert index.counts.count() == 40 and {r["n"] for r in index.counts.collect()} == {4}
    more = lines.insert(index, frame(spark, [(9, "a line met once\na line of family 1")]))
    assert filter_bytes(more) == filter_bytes(index)  # one key is new, one has more references: none crosses
    crossed = lines.insert(more, frame(spark, [(8, "A LINE met once ")]))
    changed = {k for k, v in filter_bytes(crossed).items() if v != filter_bytes(index).get(k)}
    assert len(changed) == 1
    back = lines.delete(crossed, spark.createDataFrame([(8,)], "doc_id long"))
    assert {k for k, v in filter_bytes(back).items() if v != filter_bytes(crossed).get(k)} == changed
    assert {(r["n"], r["first_doc"]) for r in back.counts.where("n <> 4").collect()} == {(1, 9), (5, 0 if 1 % 5 != 0 else 1)}


def test_line_filters_grow(monkeypatch, spark):
    monkeypatch.setattr(lines, "SHARD_KEYS", 5)
    make = lambda low, high: [(d, "\n".join(f"line number {k} of all" for k in range(low, high))) for d in (low, low + 1)]
    docs = make(0, 20)
    index = lines.insert(None, frame(spark, docs))
    for low, high in ((100, 350), (1000, 2000)):  # first fuller filters, then more shards
        index = lines.insert(index, frame(spark, make(low, high)))
        docs += make(low, high)
        assert stripped(index, frame(spark, docs)) == strip_lines(docs)
    assert index.shards > 16


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the very same line", 5, "x"), (2, "the very same line", 6, "y")], "doc_id long, text string, N_lines long, _drop string")
    index = lines.insert(None, docs)
    out = lines.strip(index, docs)
    assert out.columns == ["doc_id", "text", "_drop", "n_lines", "n_dropped"] and {(r["doc_id"], r["_drop"], r["n_dropped"]) for r in out.collect()} == {(1, "x", 0), (2, "y", 1)}
    assert lines.strip(index, docs, counts=False).columns == docs.columns


@pytest.mark.parametrize("size", [1024, 4096])
def test_twins_of_a_weak_hash_stay_apart(spark, size):
    a, b = unlike_twins(size)
    docs = [(1, f"{a}\nsome other words here"), (2, f"{b}\nand more of them too"), (3, f"{a}\n{b}\nlast")]
    assert stripped(lines.insert(None, frame(spark, docs)), frame(spark, docs)) == strip_lines(docs)
    words = [(1, a), (2, b), (3, a)]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, words), 3, 85, 100).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_near_duplicates_with_text_ids(spark):
    rows = spark.createDataFrame([("b", "one two three four five"), ("a", "one two three four five"), ("c", "else")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(rows).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_components_of_hubs_and_chains(spark):
    links = [(0, k) for k in range(1, 60)] + [(k, k + 100) for k in range(1, 30)] + [(500, 501), (501, 502)]
    found = {r["cid"]: r["label"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {v: 0 if v < 500 else 500 for pair in links for v in pair}


def test_cuckoo_filter():
    r = np.random.default_rng(5)
    keys = r.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    f = CuckooFilter.from_bytes(CuckooFilter.of(keys).to_bytes())
    assert f.contains(keys).all()
    others = r.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert f.contains(others).mean() < 1e-3
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01
