"""The corpus queries: one per operator of ``larder.llm``, and a pipeline that cleans and tokenizes ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (  # noqa: F401  (each registers its query)
    bpe,
    chat,
    decontamination,
    exact_dedup,
    fill_in_middle,
    filter_audit,
    language,
    licenses,
    near_dedup,
    packing,
    quality,
    sharding,
    url_lists,
)
from larder.llm.columns import load
from larder.llm.registered import ORACLE_SQL as _SQL
from larder.llm.registered import QUERIES as _QUERIES
from larder.session import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language that the labelled rows teach; texts without letters and distant ones go.

    Where no row teaches a language (an empty table, or no text with letters that has one) none is known: no row stays.
    """
    try:
        model = language.fit(docs)
    except language.NothingToLearn:
        return docs.where(F.lit(False))
    return language.identify(docs, model).where("NOT rejected").select(*[f"`{c}`" for c in docs.columns])


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the one with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): the one with the least id."""
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any ten-word window of a benchmark item."""
    return decontamination.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): token ids of each text, decoded again and compared before they are written."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "text"), path, pattern=public_tokenizers.PATTERN, verify=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", known_language),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_documents),
    ("decontamination", clean_of_benchmark),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification and tokenizing have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None

QUERIES = {**_QUERIES, "pipeline": run}
ORACLES = dict(_SQL)
