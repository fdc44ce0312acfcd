"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import agenda, bitplanes, crosstokens, decontaminate, jaccard, langid, licenses, packing, preference, spelling, substring, toxicity, vectors
from tidemark.llm.common import scratch

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    bitplanes.write_ids(_table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=2)
    return bitplanes.read_report(spark, path)


def op8_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, capacity=4096)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_table(spark, sf_dir, "documents"))


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.report(_table(spark, sf_dir, "conversations"))


def op11_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agenda.report(_table(spark, sf_dir, "documents"), PIECE_BPE)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(_table(spark, sf_dir, "documents"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstokens.report(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bit_planes": op2_bit_planes,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_vector_graph": op8_vector_graph,
    "op10_preference": op10_preference,
    "op11_piece_agenda": op11_piece_agenda,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_cross_tokens": op13_cross_tokens,
}

SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle(),
    "op10_preference": preference.ORACLE,
    "op12_spelling_variants": spelling.oracle(),
    "op7_substring_dedup": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
g as (select doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') as g from (select doc_id, w, unnest(range(0, len(w) - 12)) as i from d where len(w) >= 13)),
low as (select g, min(doc_id) as low from g group by g),
hit as (select g.doc_id, list(distinct i) as starts from g join low using (g) where g.doc_id > low.low group by g.doc_id),
k as (select d.doc_id, len(w) as n, case when starts is null then w else
  list_filter(w, lambda x, j: len(list_filter(starts, lambda s: s < j and j <= s + 13)) = 0) end as kept from d left join hit using (doc_id))
select doc_id, n::bigint as n_words, (n - len(kept))::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
""",
}
