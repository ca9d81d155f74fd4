"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), keep=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).drop("mixture")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import secret_scan

    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.digest(lines.strip(lines.insert(None, docs), docs))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import topk

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emergent.llm import pii

    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES = {
    "op10_pii": op10_pii,
    "op3_exact_top_k": op3_exact_top_k,
    "op5_toxicity": op5_toxicity,
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op6_secret_scans": op6_secret_scans,
    "op9_language_id": op9_language_id,
    "op7_bpe": op7_bpe,
    "op8_quality_rules": op8_quality_rules,
}
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "[\\x20\\x09-\\x0D]+"

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_FOLD.format("coalesce(text, '')")}, '{_SPACE}'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.v = y.v AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN sets s USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, len(s.s)""",
    "op2_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), keyed AS (SELECT doc_id, i, x, {_FOLD.format(f"regexp_replace(regexp_replace(x, '^{_SPACE}', ''), '{_SPACE}$', '')")} AS k FROM lines),
held AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT doc_id, i, x, coalesce(doc_id <> first_doc, false) AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op3_exact_top_k": """
WITH usable AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), each AS (
  SELECT vec_id, unnest(range(len(embedding) + 1)) AS i, unnest(list_prepend(0, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)))) AS v FROM usable
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM each q JOIN each c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5""",
}
