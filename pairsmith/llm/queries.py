"""The thin queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsmith.llm import bpe, divergence, knn, lines, merkle, neardup, ordermin, packing, pii, quality, sst, substrings, toxicity
from pairsmith.sources import interim


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc.id").alias("doc_id"), "rep_id", "class_id", "n_links")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.find(documents, pii.learn(documents)).drop("redacted").withColumn("found", F.col("spans") != "")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sst.write(table(spark, sf_dir, "documents"), interim.new_path(spark, "token-shards"))
    return sst.read(spark, manifest, with_ids=False)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.char_length("t").cast("long").alias("n_chars_left"), F.sha2("t", 256).alias("left_sha256"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality.learn(documents, table(spark, sf_dir, "labels"))
    return quality.judge(documents, rules).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"

OP11_SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
    regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), w AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
every AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS p FROM every WINDOW s AS (PARTITION BY lang, source)),
ql AS (SELECT lang, term, sum(n) AS n FROM every GROUP BY lang, term),
q AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s) AS q FROM ql WINDOW s AS (PARTITION BY lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), more AS (SELECT p.lang, source, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM more
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_tampering(table(spark, sf_dir, "documents"))


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: crc32 of the identifier's decimal digits, byte by byte and bit by bit.
_CRC = "xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, xor(a, b)), 4294967295::UBIGINT))"
_JOINED = "string_agg(hash, '' ORDER BY idx)"
_SLOT = "(64 * (u.idx % 16))::BIGINT"
_ABOVE = f"u.idx // 16, p.n, u.level + 1, proof || substring(preimage, 1, {_SLOT}) || substring(preimage, {_SLOT} + 65), sha256(substring(preimage, 1, {_SLOT}) || folded || substring(preimage, {_SLOT} + 65))"

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_LOWERED.format("text"))} END AS changed FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes AS (
  SELECT 0 AS level, source, idx, n, leaf AS hash, '' AS preimage FROM placed
  UNION ALL
  SELECT level + 1, source, idx // 16, (max(n) + 15) // 16, sha256({_JOINED}), {_JOINED} FROM nodes WHERE n > 1 GROUP BY level, source, idx // 16
), tops AS (
  SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, idx, n, hash, '' AS preimage FROM tops
  UNION ALL
  SELECT level + 1, idx // 16, (max(n) + 15) // 16, sha256({_JOINED}), {_JOINED} FROM top WHERE n > 1 GROUP BY level, idx // 16
), up AS (
  SELECT doc_id, leaf, source, idx, n, 0 AS level, '' AS proof, coalesce(changed, leaf) AS folded FROM placed
  UNION ALL
  SELECT doc_id, leaf, u.source, {_ABOVE} FROM up u JOIN nodes p ON p.level = u.level + 1 AND p.source IS NOT DISTINCT FROM u.source AND p.idx = u.idx // 16 WHERE u.n > 1
), on_top AS (
  SELECT doc_id, leaf, hash AS subroot, t.idx, t.n, 0 AS level, proof, folded FROM up JOIN tops t ON up.source IS NOT DISTINCT FROM t.source WHERE up.n = 1
), over AS (
  SELECT * FROM on_top
  UNION ALL
  SELECT doc_id, leaf, subroot, {_ABOVE} FROM over u JOIN top p ON p.level = u.level + 1 AND p.idx = u.idx // 16 WHERE u.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM over, (SELECT hash AS root FROM top WHERE n = 1) WHERE n = 1
"""


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_bpe, op3_packing, op4_pii, op5_substrings, op6_token_shards, op7_lines, op8_top_k, op9_quality, op10_toxicity, op11_divergence, op12_order_minhash, op13_merkle)}

ORACLE_SQL = {"op8_top_k": OP8_SQL, "op11_divergence": OP11_SQL, "op13_merkle": OP13_SQL}
