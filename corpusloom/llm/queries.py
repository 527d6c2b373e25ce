"""The operators of this package as registered queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import language, toxicity, whitening
from corpusloom.llm.decontaminate import benchmark_hits, contamination_digest
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.neardup import near_duplicates
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.repetition import repetition_rules
from corpusloom.llm.secrets import secret_digest
from corpusloom.llm.spelling import spelling_variants
from corpusloom.llm.substrings import remove_repeats
from corpusloom.llm.toolcalls import EXCHANGE_SCHEMAS, exchanges, link_tool_calls
from corpusloom.llm.wrappers import main_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op3_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(benchmark_hits(docs, _table(spark, sf_dir, "benchmark")))


def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(_table(spark, sf_dir, "documents")).drop("n_covered_words", "longest_repeat")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept", "spans")


def op7_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op8_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(exchanges(_table(spark, sf_dir, "conversations")), EXCHANGE_SCHEMAS)


def op10_secret_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(_table(spark, sf_dir, "documents"))


def op11_trie_pair_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    return whitening.whitening_digest(whitening.whiten(vectors, model), model)


def op13_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("source", "times")


QUERIES = {
    "op1_bayesian_minhash": op1_bayesian_minhash,
    "op2_host_wrappers": op2_host_wrappers,
    "op3_subword_toxicity": op3_subword_toxicity,
    "op4_fm_index_decontamination": op4_fm_index_decontamination,
    "op5_suffix_repetition": op5_suffix_repetition,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_byte_network_language": op7_byte_network_language,
    "op8_sum_of_squares_packing": op8_sum_of_squares_packing,
    "op9_tool_call_linking": op9_tool_call_linking,
    "op10_secret_tests": op10_secret_tests,
    "op11_trie_pair_spelling": op11_trie_pair_spelling,
    "op12_qdwh_whitening": op12_qdwh_whitening,
    "op13_cube_mixing": op13_cube_mixing,
}
