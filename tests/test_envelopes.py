"""Envelopes that Arrow and the JVM explode show the same columns and rows as those that Python explodes."""

import json
from dataclasses import replace

import pytest

from emergent.functions.lattice import Node, flatten
from emergent.operators import infer as inference
from emergent.operators.shred import shred, typed
from emergent.operators.transforms import apply

DAY = "2024-01-02"
FAST = {
    "list": ("r", [{"o": i, "s": "wéb\"\\", "d": DAY, "r": [{"l": k, "q": k / 2, "n": {"z": [k, 1]}, "t": "2024-01-02 03:04:05"} for k in range(1, 1 + i % 3 + 1)]} for i in range(20)]),
    "object": ("r", [{"r": {"l": i}, "o": [str(i)]} for i in range(3)]),
    "deep": ("r.p", [{"o": i, "r": [{"m": i * 2, "p": [{"x": 1, "y": False}, {"x": 2.5, "y": None}, {"x": 4}]}, {"m": None, "p": [{"x": 3, "y": True}]}]} for i in range(3)][::-1] + [{"o": None, "r": [{"m": 1, "p": [{"x": 1, "y": False}]}]}]),
    "own first": ("r", [{"v": "envelope", "e": 1, "r": [{"v": i, "w": {"v": 2}}]} for i in range(3)]),
    "same as path": ("r", [{"o": 1, "r": [{"r": 5, "x": 1}]}] * 2),
    "a later member": ("r", [{"o": 1, "r": [{"x": 1, "y": 1}, {"x": 1}]}, {"o": 2, "late": 5, "r": [{"y": 1, "x": 2}]}]),
}
SLOW = {
    "empty list": ("r", [{"only": 1, "o": 1, "r": []}, {"o": 2, "r": [{"x": 1}]}]),
    "null own": ("r", [{"v": 9, "r": [{"v": None, "x": 1}, {"x": 2}]}]),
    "no key": ("r", [{"o": 1}, {"o": 2, "r": [{"x": 1}]}, {"o": 3, "r": None}]),
    "bare": ("r", [{"o": 1, "r": [{"x": 1}, None]}]),
    "order": ("r", [{"o": 1, "r": [{"x": 1}, {"x": 1, "late": 2}]}]),
    "array": ("r", [[{"o": 1, "r": [{"x": 1}]}], {"o": 2, "r": [{"x": 1}]}]),
    "list and object": ("r", [{"o": 1, "r": [{"x": 1}]}, {"o": 2, "r": {"x": 1}}]),
    "kinds": ("r", [{"o": 1.50, "r": [{"x": "a"}]}, {"o": "b", "r": [{"x": 2}]}]),
    "case": ("r", [{"X": 1, "r": [{"x": 2}]}]),
    "case of path": ("r", [{"R": 1, "r": [{"x": 2}]}]),
    "json": ("r", [{"o": 1, "r": [{"x": [{"a": 1}]}]}, {"o": 1, "r": [{"x": [{"b": [1.0]}]}]}]),
}


def _found(spark, documents, path):
    payloads = spark.createDataFrame([(json.dumps(d, ensure_ascii=False),) for d in documents], "value string").coalesce(1)
    found = inference.infer(payloads, path)
    fast = typed(payloads, found, found.columns, path, False)
    slow = shred(inference.documents_of(payloads, replace(found, levels=None), path, False), found.columns, found.scalar)
    return found, fast, slow


def _told(path, documents):
    root = Node()
    for row in apply([d for x in documents for d in (x if isinstance(x, list) else [x])], path, False):
        root.add(row)
    return [(c.name, c.type) for c in flatten(root)]


@pytest.mark.parametrize("name", [*FAST, *SLOW])
def test_same_rows_as_python(spark, name):
    path, documents = (FAST | SLOW)[name]
    path = path.split(".")
    if name == "bare":
        with pytest.raises(ValueError):
            _found(spark, documents, path)
        return
    found, fast, slow = _found(spark, documents, path)
    assert [(c.name, c.type) for c in found.columns] == _told(path, documents)
    assert fast.schema == slow.schema
    assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in slow.collect()]
    if name in FAST:
        assert "MapInArrow" not in fast._jdf.queryExecution().executedPlan().toString()


def test_numbers_among_texts_of_other_batches_are_written_anew(spark):
    documents = [{"r": [{"x": 1}], "o": "b"}] * 2000 + [{"r": [{"x": 1}], "o": 0}]
    texts = [json.dumps(d) for d in documents[:-1]] + ['{"o":1.50,"r":[{"x":1}]}']
    payloads = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    found = inference.infer(payloads, ["r"])
    assert {r[0] for r in typed(payloads, found, found.columns, ["r"], False).select("o").collect()} == {"b", "1.5"}
