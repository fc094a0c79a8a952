"""The thin queries over this subpackage's operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, linededup, neardup, nndescent, pseudonyms, quality, rotation, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_severity, grade, toxic of every document; labels of ids held out (crc32 mod 4 = 2) are not learned."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), "toxic", where=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.grade(docs, model).select("doc_id", "expected_severity", "grade", "toxic")


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, block, perspective, n_turns, n_learned, n_chars, mask (start:end, comma-joined), text_sha256."""
    seen = rotation.perspectives(_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return seen.select("conv_id", "block", "perspective", "n_turns", "n_learned", F.length("rendered").cast("bigint").alias("n_chars"), mask.alias("mask"), F.sha2("rendered", 256).alias("text_sha256"))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return made.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_replaced, kinds and pseudonyms of the replaced values in order, text_sha256 of the new text."""
    made = pseudonyms.pseudonymised(_table(spark, sf_dir, "documents"), key="a key that a deployment replaces")
    return made.select("doc_id", F.size("found").cast("bigint").alias("n_replaced"), F.transform("found", lambda x: x["kind"]).alias("kinds"), F.transform("found", lambda x: x["pseudonym"]).alias("pseudonyms"), F.sha2("text", 256).alias("text_sha256"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op7_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_crossing, and the tokens of the source, the language and each line of the text."""
    ranks = tokencount.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    made = tokencount.token_counts(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ("source", "lang", "text"), rule="first")
    of = lambda name: F.transform(F.filter("sections", lambda x: x["field"] == name), lambda x: x["n_tokens"])
    return made.select("doc_id", "n_tokens", "n_crossing", *(of(c).alias(f"{c}_tokens") for c in ("source", "lang", "text")))


def op8_setjoin_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and text_sha256 of what is left."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("bigint").alias("n_lines"))
    left = linededup.without_repeated_lines(docs, count="n_removed")
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(_table(spark, sf_dir, "documents"), bpe.load_tables(public_tokenizers.path("word_bpe_49k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ordinal_toxicity,
        op2_perspective_rotation,
        op3_winnowing_decontamination,
        op4_subword_quality,
        op5_feistel_pseudonyms,
        op6_circulant_minhash,
        op7_offset_token_counts,
        op8_setjoin_line_dedup,
        op9_nn_descent,
        op10_backtracking_bpe,
    )
}

#: DuckDB SQL of the operators that SQL can express; the others are tested against brute force.
SQL: dict[str, str] = {
    "op2_perspective_rotation": """
        WITH t AS (SELECT conv_id, CAST(floor(turn / 256) AS BIGINT) AS block, turn, role, text FROM conversations),
        p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> 'system'),
        s AS (SELECT t.conv_id, block, perspective, turn, role, text, role IS NOT DISTINCT FROM perspective AS learn,
                CASE WHEN role IS NOT DISTINCT FROM perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
                  ELSE '<|user name=' || coalesce(role, 'unknown') || '|>' END || chr(10) AS head,
                coalesce(text, '') || '<|end|>' || chr(10) AS body
              FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        w AS (SELECT *, row_number() OVER o AS k, sum(length(head) + length(body)) OVER o - length(body) AS pos
              FROM s WINDOW o AS (PARTITION BY conv_id, block, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, block, perspective, count(*) AS n_turns, CAST(count(*) FILTER (WHERE learn) AS BIGINT) AS n_learned,
          CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars,
          coalesce(string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos AS BIGINT) + length(body) - 1 AS VARCHAR), ',' ORDER BY k) FILTER (WHERE learn), '') AS mask,
          sha256(string_agg(head || body, '' ORDER BY k)) AS text_sha256
        FROM w GROUP BY conv_id, block, perspective""",
    "op3_winnowing_decontamination": """
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        bw AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n),
        h AS (SELECT DISTINCT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
        hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)""",
}
