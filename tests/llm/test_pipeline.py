"""The pipeline against brute force, and the queries that SQL expresses against it."""

from pathlib import Path

import duckdb
import pytest
from helpers import components, strip_lines

from emergent.llm import quality, secret_scan

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def test_stages_and_run(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.assess(docs, model).where("kept").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    stripped = {d: t for d, (_, _, t) in strip_lines(rows).items()}
    groups = components(sorted(stripped.items()), 5, 80, 100)
    left = {d: stripped[d] for d, (_, c) in groups.items() if d == c}
    one = secret_scan.scanner(secret_scan.RULES)
    expected = {d: bool(one.spans(t.encode())) for d, t in left.items()}
    frame = docs
    for _, stage in pipeline.STAGES[:-1]:
        frame = stage(spark, frame, DATA)
        assert frame.columns == docs.columns
    final = {r["doc_id"]: r for r in frame.collect()}
    assert set(final) == set(left) and all(("[secret]" in final[d]["text"]) == has for d, has in expected.items())
    assert all(final[d]["n_chars"] == len(final[d]["text"]) for d in final)
    out = pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == set(left)


def test_near_dedup_judges_rows_that_share_a_doc_id_alone(spark):
    import corpus_pipeline as pipeline

    text = lambda word: " ".join(f"{word}{i}" for i in range(60))
    docs = [(1, text("a")), (1, text("a")), (2, text("b")), (2, text("a") + " more"), (3, text("c")), (3, text("d")), (4, text("d")), (None, text("a")), (None, text("a"))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    left = pipeline.near_dedup(spark, frame, DATA)
    assert left.columns == frame.columns
    kept = [(d, t[0]) for d, t in left.collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "a"), (None, "a")], key=str)


@pytest.mark.parametrize("name", ["op1_minhash_near_dedup", "op2_line_dedup", "op3_exact_top_k"])
def test_queries_and_sql(spark, name):
    from emergent.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = queries.QUERIES[name](spark, DATA)
    expected = con.sql(queries.ORACLE[name])
    names = sorted(found.columns)
    assert sorted(expected.columns) == names
    right = sorted(tuple(r[expected.columns.index(n)] for n in names) for r in expected.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == right
