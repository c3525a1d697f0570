"""The registered queries of the subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecount.llm import (
    bpe, fill_middle, jaccard, packing, pii, quality, secret_scan, sharding, spans, suffixes, topk, urls, vector_codes, word_bpe,
)
from gatecount.llm.common import documents, written

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The rules of the registered query (fixed values).
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]
JUNK_SIGNS = "[%]{3}|[*]{3}|[#]{3}|[$]{3}"
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = secret_scan.train(docs)
    scanned = secret_scan.scanned(docs, model, "base", "every").select("doc_id", "base", "every")
    names = secret_scan.KINDS
    return scanned.select(
        "doc_id",
        *[spans.count(F.col("base"), i).alias(f"n_{names[i]}") for i in range(3)],
        F.sha2(spans.listed(F.col("base"), names), 256).alias("base_sha256"),
        spans.listed(F.col("every"), names).alias("spans"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    decoded = bpe.encode_and_decode(docs, BYTE_RANKS, public_tokenizers.PATTERN, ["doc_id"])
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(documents(spark, sf_dir), ["doc_id"])
    base = F.col("base_spans")
    return found.select(
        "doc_id",
        *[spans.count(base, i).alias(f"n_{pii.KINDS[i]}") for i in range(pii.SEED_KINDS)],
        F.sha2(spans.listed(base, pii.KINDS), 256).alias("base_sha256"),
        spans.listed(F.col("all_spans"), pii.KINDS).alias("spans"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), WORD_TOKENIZER)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, F.col("vec_id") % 50 == 0, 5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    measured, counts = quality.measure(docs, ["doc_id", "lang"])
    measured = written(measured, "measured")
    rules = quality.fit(measured, counts, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(measured, counts, rules).select(
        "doc_id",
        *[F.col(f"{counts}.{n}").alias(n) for n in names],
        F.col(f"{counts}.failed").alias("base_failed"),
        F.col(f"{counts}.kept").alias("kept"),
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of the pages whose markup holds a run of three of the signs that junk pages repeat."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    junk = pages.where(F.col("html").rlike(JUNK_SIGNS))
    url = F.col("url")
    listed = junk.select(urls.canonical(urls.host(url), urls.path(url)).alias("canonical"))
    judged = urls.judge(pages.select("page_id", "url"), URL_RULES, listed)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = sharding.sharded(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, books = vector_codes.compressed(vectors, ["vec_id", "label"])
    summed = vector_codes.with_sums(coded, "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = word_bpe.encode_and_decode(documents(spark, sf_dir), WORD_TOKENIZER, ["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transformed(documents(spark, sf_dir), F.col("doc_id"), ["doc_id"])
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


OP5_SQL = f"""
WITH parsed AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{urls.CAPITALS}', '{urls.SMALL}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
named AS (
  SELECT *, CASE WHEN host <> '' THEN
    regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html|/+)$', '') END AS canonical
  FROM parsed
),
fits(verdict, rule_host, rule_path) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM named JOIN fits ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(html, '{JUNK_SIGNS}') AND canonical IS NOT NULL)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN best USING (page_id)
"""

OP6_SQL = """
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP8_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words
),
elements AS (SELECT doc_id, unnest(s) AS e FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have
  FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT x, y FROM common JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y
  WHERE 100 * both_have >= 90 * (len(p.s) + len(q.s) - both_have)
),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x
),
degree AS (SELECT x, count(*) AS n FROM edges GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(other) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id,
       coalesce(n, 0)::BIGINT AS n_links
FROM sets LEFT JOIN degree ON x = doc_id
"""


OP11_PARTS, OP11_ENTRIES, OP11_ROUNDS = 8, 16, 6
OP11_START = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v, len(embedding) // {OP11_PARTS} AS width,
         row_number() OVER (ORDER BY vec_id) AS place
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
components AS MATERIALIZED (
  SELECT vec_id, place, i // width AS part, i % width AS spot, v[i + 1] AS x FROM (SELECT *, unnest(range(len(v))) AS i FROM kept)
),
book0 AS MATERIALIZED (SELECT part, place - 1 AS entry, spot, x FROM components WHERE place <= {OP11_ENTRIES})"""
OP11_NEAREST = f"""
nearest{{r}} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {OP11_ENTRIES} + entry) AS best FROM (
    SELECT vec_id, part, entry, sum((c.x - b.x) * (c.x - b.x)) AS d
    FROM components c JOIN book{{r}} b USING (part, spot) GROUP BY vec_id, part, entry
  ) GROUP BY vec_id, part
)"""
OP11_MEANS = f"""
book{{next}} AS MATERIALIZED (
  SELECT part, entry, spot, coalesce(mean, x) AS x FROM book{{r}} LEFT JOIN (
    SELECT part, (best % {OP11_ENTRIES})::BIGINT AS entry, spot, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS mean
    FROM components JOIN nearest{{r}} USING (vec_id, part) GROUP BY part, best % {OP11_ENTRIES}, spot
  ) USING (part, entry, spot)
)"""
OP11_END = f"""
coded AS (
  SELECT vec_id, string_agg(printf('%02x', (best % {OP11_ENTRIES})::BIGINT), '' ORDER BY part) AS code,
         sum(best // {OP11_ENTRIES})::BIGINT AS error
  FROM nearest{OP11_ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, spot)) FROM book{OP11_ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
OP11_SQL = ",".join(
    [OP11_START]
    + [step.format(r=r, next=r + 1) for r in range(OP11_ROUNDS) for step in (OP11_NEAREST, OP11_MEANS)]
    + [OP11_NEAREST.format(r=OP11_ROUNDS), OP11_END]
)

OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
),
numbered AS (
  SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS c2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
),
parted AS (
  SELECT doc_id, t, n, array_to_string(units[:least(c1, c2)], '') AS p, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
              ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parted
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_urls": op5_urls,
    "op6_topk": op6_topk,
    "op7_quality": op7_quality,
    "op8_jaccard": op8_jaccard,
    "op9_suffixes": op9_suffixes,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_word_bpe": op12_word_bpe,
    "op13_fill_middle": op13_fill_middle,
    "pipeline": pipeline,
}
#: SQL says the same for these; the others are tested against plain loops over small tables.
ORACLES: dict[str, str] = {
    "op5_urls": OP5_SQL, "op6_topk": OP6_SQL, "op8_jaccard": OP8_SQL, "op11_vector_codes": OP11_SQL, "op13_fill_middle": OP13_SQL,
}
