"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language, lines, mixing, packing, simhash
from tessera.llm.common import drop_tables, step, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`lang` becomes the language found, `und` where no language explains a text; documents that have no letters go."""
    return language.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on many sites go, but where they come first."""
    return lines.dedup_lines(docs).select(*(f"`{n}`" for n in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or cut so that each source meets its target."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of fixed-length token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID, SimHash and tokenisation are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, step(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        if before is not given:
            drop_tables(before)
    return STAGES[-1][1](spark, docs, sf_dir)
