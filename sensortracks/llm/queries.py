"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from sensortracks.llm import oracles
from sensortracks.llm.common import prepare, table

BPE_FILE = "byte_bpe_50k.json"
WORD_FILE = "word_bpe_49k.json"

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run
    return deco


@register("op2_shards")
def op2_shards(spark, sf_dir):
    from sensortracks.llm.sharding import shard_rows

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (
  SELECT rid, i, ws[i] AS a, ws[i+1] AS b, ws[i+2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits,
         coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest
  FROM w LEFT JOIN rep USING (rid)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 2 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
       AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AND 2 * digits <= word_chars
       AND 2 * longest <= word_chars AS kept
FROM g
"""


@register("op10_quality", OP10_SQL)
def op10_quality(spark, sf_dir):
    from sensortracks.llm.quality import quality_verdict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_verdict(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op4_langid")
def op4_langid(spark, sf_dir):
    from sensortracks.llm.langid import identify_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify_documents(docs).select("doc_id", "held_out", "lang_pred", "score")


@register("op1_ctw")
def op1_ctw(spark, sf_dir):
    from sensortracks.llm.ctw import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the installed tokenizer package; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_path() -> str:
    return tokenizer_path(BPE_FILE)


@register("op6_bpe")
def op6_bpe(spark, sf_dir):
    from sensortracks.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), bpe_path())


@register("op7_pack")
def op7_pack(spark, sf_dir):
    from sensortracks.llm.pack import pack_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, bpe_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op8_pii")
def op8_pii(spark, sf_dir):
    from sensortracks.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


@register("op9_html")
def op9_html(spark, sf_dir):
    from sensortracks.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@register("op5_neardup")
def op5_neardup(spark, sf_dir):
    from sensortracks.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@register("op3_permindex")
def op3_permindex(spark, sf_dir):
    from sensortracks.llm.permindex import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@register("op11_convrepair", oracles.op11())
def op11_convrepair(spark, sf_dir):
    from sensortracks.llm.convrepair import damaged, repair

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), rows)


@register("op12_dsir", oracles.op12())
def op12_dsir(spark, sf_dir):
    from sensortracks.llm.dsir import resample

    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"),
                    table(spark, sf_dir, "benchmark").select("text"))


@register("op13_kkpack")
def op13_kkpack(spark, sf_dir):
    from sensortracks.llm.kkpack import pack_documents

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(WORD_FILE))
