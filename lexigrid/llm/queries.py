"""The registered queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexigrid.llm.common import table
from lexigrid.llm.audit import AUDIT_SQL
from lexigrid.llm.lines import LINES_SQL
from lexigrid.llm.manifest import MANIFEST_SQL
from lexigrid.llm.substrings import REPEATS_SQL
from lexigrid.llm.topk import TOP_K_SQL


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.pii import digest, personal_data

    return digest(personal_data(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.tokencounts import edited_counts, revision_edits

    docs = table(spark, sf_dir, "documents")
    return edited_counts(docs, revision_edits(), tokenizer_path("byte_bpe_50k.tiktoken"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.manifest import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexigrid.llm.lines import line_digests

    return line_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_decontamination, op3_simhash, op4_toxicity, op5_html, op6_substrings, op7_pii, op8_quality,
        op9_topk, op10_token_counts, op11_manifest, op12_filter_audit, op13_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op6_substrings": REPEATS_SQL, "op9_topk": TOP_K_SQL, "op11_manifest": MANIFEST_SQL, "op12_filter_audit": AUDIT_SQL, "op13_line_dedup": LINES_SQL,
}
