import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emergent.functions.jsonparse import loads, split
from emergent.functions.lattice import Node, PayloadError, flatten, join_column, join_scalar, raw_infer, raw_type
from emergent.functions.temporal import parse_timestamp, sniff


def columns(*documents):
    root = Node()
    for d in documents:
        root.add(d)
    return {c.name: c.type for c in flatten(root)}


@pytest.mark.parametrize(
    ("text", "kind"),
    [("null", "Null"), ("true", "Bool"), ("1", "Int64"), ("18446744073709551615", "UInt64"), ("1.5", "Double"), ('"x"', "String"), ("[1]", "Array"), ('{"a":1}', "Object"), ("{bad", "String"), (None, None)],
)
def test_raw_type(text, kind):
    assert raw_type(text) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("1", "BIGINT"), ("1.0", "DOUBLE"), ("18446744073709551615", "DOUBLE"), ('"2024-01-15"', "DATE"), ('"2024-01-15T10:30:00"', "TIMESTAMP"), ('"x"', "VARCHAR"), ("null", "VARCHAR"),
        ("[1,2]", "BIGINT[]"), ("[[1,2],[3]]", "BIGINT[][]"), ('[1,"x"]', "VARCHAR[]"), ("[]", "VARCHAR[]"), ('[{"x":1}]', "JSON"), ("{}", "JSON"), ("[1,[2]]", "JSON"), ("{bad", "VARCHAR"),
        ('{"a":1,"b":{"c":"x"}}', "OBJECT(a BIGINT, b.c VARCHAR)"),
    ],
)
def test_raw_infer(text, kind):
    assert raw_infer(text) == kind


def test_conflicts_and_order():
    assert columns({"v": 1}, {"v": 2.5}) == {"v": "DOUBLE"}
    assert columns({"v": 1}, {"v": "x"}) == {"v": "VARCHAR"}
    assert columns({"v": {"a": 1}}, {"v": 2}) == {"v": "JSON"}
    assert columns({"d": "2024-01-15"}, {"d": "2024-01-15T10:30:00"}) == {"d": "TIMESTAMP"}
    assert list(columns({"z": 1, "a": {"y": 1, "b": 2}}, {"m": 1})) == ["z", "a.y", "a.b", "m"]
    assert list(columns({"a.b": 1, "a": {"b": 2}, "A": {"B": 3}})) == ["a.b", "a.b_1", "A.B_2"]


def test_deep_objects_stop_at_the_limit():
    document = 1
    for _ in range(20):
        document = {"k": document}
    (name, kind), = columns(document).items()
    assert name.count(".") == 15 and kind == "JSON"
    for _ in range(200):
        document = [document]
    assert columns({"v": document}) == {"v": "JSON"} or columns({"v": document})["v"].startswith("JSON")


def test_row_formation():
    assert split('[{"a":1},{"a":2}]')[0] == [{"a": 1}, {"a": 2}]
    assert split('{"a":1}\n\n{"a":2}')[0] == [{"a": 1}, {"a": 2}]
    assert split("[1]\n[2]")[0] == [[1], [2]]
    assert split('{"a":1}\n{"a" 5}\n{"a":2}', True) == ([{"a": 1}, {"a": 2}], 1)
    with pytest.raises(PayloadError, match="parse error on line 2"):
        split('{"a":1}\n{"a" 5}')
    with pytest.raises(ValueError):
        loads('{"a":1} trailing')
    assert loads('{"a":1,"a":2}') == {"a": 2}


def test_temporal():
    assert [sniff(t) for t in ("2024-1-05", "2024/01/15", "20240115", "2024-13-01", "2024-01-15 10:30", "2024-01-15T10:30:00.123456789Z", "x2024-01-15")] == ["DATE", "DATE", "VARCHAR", "VARCHAR", "TIMESTAMP", "TIMESTAMP", "VARCHAR"]
    assert parse_timestamp("2024-01-15T10:30:00+02:00").hour == 10


KINDS = st.sampled_from(["UNSET", "BOOLEAN", "BIGINT", "DOUBLE", "DATE", "TIMESTAMP", "VARCHAR"])


@given(KINDS, KINDS, KINDS)
def test_scalar_join_is_a_join(a, b, c):
    assert join_scalar(a, a) == a
    assert join_scalar(a, b) == join_scalar(b, a)
    assert join_scalar(join_scalar(a, b), c) == join_scalar(a, join_scalar(b, c))


def test_column_join():
    assert join_column("INTEGER", "BIGINT") == "BIGINT"
    assert join_column("BIGINT[]", "DOUBLE[]") == "DOUBLE[]"
    assert join_column("BIGINT", "BIGINT[]") == "JSON"
    assert join_column("BIGINT", "JSON") == "JSON"
    assert join_column("DATE", "TIMESTAMP") == "TIMESTAMP"
    assert join_column("BOOLEAN", "BIGINT") == "VARCHAR"


JSON = st.recursive(st.none() | st.booleans() | st.integers(-10, 10) | st.floats(-5, 5) | st.sampled_from(["x", "2024-01-15"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(JSON, max_size=6), st.integers(0, 6))
def test_merging_parts_is_adding_all(documents, cut):
    whole, left, right = Node(), Node(), Node()
    for d in documents:
        whole.add(d)
    for d in documents[:cut]:
        left.add(d)
    for d in documents[cut:]:
        right.add(d)
    merged = Node.load(left.dump()).merge(Node.load(right.dump()))
    assert merged.dump() == whole.dump()


def test_native_reader_gives_the_same_trees():
    """Arrow's reader against value by value, on random documents; where it gives up the caller reads value by value."""
    import random

    import pyarrow as pa

    from emergent.functions.lattice import Node, compact
    from emergent.functions.native import Reader

    r = random.Random(8)
    texts = ["word", "2031-05-02", "2031/5/2", "2031-05-02T08:09:00Z", "2031-05-02 08:09", "2031-13-02", "12", "", "é\n\"x\"", "2031-05-02 and more"]

    def value(kind):
        return {
            "int": lambda: r.choice([1, -5, 0, 1 << 40]), "big": lambda: r.choice([1 << 63, 5]), "float": lambda: r.choice([1.5, 2.0, 1e300]), "mixed": lambda: r.choice([1, 2.5]),
            "bool": lambda: r.random() < 0.5, "text": lambda: r.choice(texts), "day": lambda: r.choice(texts[1:3]), "time": lambda: r.choice(texts[1:5]), "none": lambda: None,
            "list": lambda: [r.choice([1, None]) for _ in range(r.randrange(3))], "lists": lambda: [["a"], []][: r.randrange(3)], "object": lambda: {"k": r.choice([None, 1]), "d": {"e": r.choice(texts[1:3])}}, "empty": lambda: {},
            "objects": lambda: [{"q": 1}], "clash": lambda: r.choice([1, "x", {"y": 1}, [1], None, True]),
        }[kind]()

    kinds = ["int", "big", "float", "mixed", "bool", "text", "day", "time", "none", "list", "lists", "object", "empty", "objects", "clash"]
    native = 0
    for _ in range(300):
        columns = {f"c{i}": r.choice(kinds) for i in range(r.randrange(1, 6))}
        reader, whole, read = Reader(), Node(), Node()
        for _ in range(3):  # batches of one shape, with keys left out
            documents = [{c: value(k) for c, k in columns.items() if r.random() < 0.9} for _ in range(r.randrange(1, 12))]
            tree = reader.tree(pa.array([compact(d) for d in documents]))
            own = Node()
            for d in documents:
                own.add(d)
            whole.merge(own)
            native += tree is not None
            read.merge(tree or own)
        assert read.dump() == whole.dump()
    assert native > 300
    one = Reader().tree
    for odd in ('{"a":1}{"a":2}', '{"a":1,"a":"x"}', "[1]", "5", '{"a":1', '{"a":\n1}'):
        assert one(pa.array([odd])) is None
