"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again before the next stage. All stages but the last return the columns of documents, whatever these
are. Texts are processed whole, whatever their length.

Nulls, ties and the like: a null or empty text fails the quality rules; a null language or source is
a group of its own; a null doc_id is no one's copy but that of equal or similar texts. Repeated rows
are copies: one stays. Of similar documents that with the least doc_id stays, nulls last, ties by the
text's hash. An empty table passes all stages and packs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import jaccard, lines, mixing, packing, quality
from tidelake.llm.common import drop_tables, in_file_order, materialise
from tidelake.llm.queries import byte_bpe, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or their group's thresholds reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go; a document without any other line stays, with an empty text."""
    return lines.with_lines_dropped(docs, min_docs=10)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest doc_id."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that make up each training sequence, in the order in which mixing has written them."""
    return packing.pack(in_file_order(docs, ["doc_id", "text"]), packing.Packing(tokenizer=byte_bpe())).withColumn(
        "ids_crc32", F.crc32("ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizing is beyond SQL; tests/llm compares each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(before)  # not documents, which materialise() did not write
    return STAGES[-1][1](spark, docs, sf_dir)
