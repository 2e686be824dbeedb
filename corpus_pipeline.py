"""A corpus from raw documents: five stages, each of them one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrain.llm import bpe, decontaminate, langid, simhash, suffixes
from linkrain.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents_of(docs: DataFrame) -> DataFrame:
    """The columns of documents; one that is not there is null, n_chars is counted. Other columns go, whatever their names."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    made = {"n_chars": F.length("text").cast("long")}
    return docs.select(*(F.col(c) if c in docs.columns else made.get(c, F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which a language is found, and it as lang; null texts and texts without letters go.

    Repeated rows are judged each; without a labelled text all go; an empty table gives none.
    """
    docs = documents_of(docs)
    found = langid.identify(docs, langid.learn(docs)).where("lang_pred != 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash component, one of repeated rows; documents without an id stay."""
    return simhash.deduplicate(documents_of(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of 100-byte strings that start earlier; broken characters at the cuts go, and texts of which nothing is left.

    Of repeated rows the first keeps its text; null ids come last.
    """
    cut = suffixes.remove_repeats(documents_of(docs), keep=("doc_id", "lang", "source"))
    return cut.withColumn("text", valid_text("kept")).where("n_removed = 0 or length(text) > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def valid_text(name: str):
    """Bytes as text, without those that are no UTF-8 character."""
    return F.when(F.is_valid_utf8(F.col(name).cast("string")), F.col(name).cast("string")).otherwise(F.replace(F.make_valid_utf8(F.col(name).cast("string")), F.lit("\ufffd"), F.lit("")))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that are not contaminated by the benchmark; repeated rows are judged each, null and empty texts stay."""
    return decontaminate.decontaminate(documents_of(docs), table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with its id, language and source; repeated rows stay, a null text has no tokens."""
    return bpe.bpe_encode(documents_of(docs), bpe.vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("BPE", tokens),
]

#: The stages are no SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
