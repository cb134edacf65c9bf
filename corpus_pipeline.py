"""Corpus preparation in stages: each takes (spark, docs, sf_dir) and returns a table.

All but the last return rows of docs with their columns as they were, extra ones
with any name included; an empty table stays empty. Null and empty texts, null
and repeated ids, ties and repeated rows are as each stage states. Texts are read
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motiongraph.llm.decontaminate import drop_contaminated
from motiongraph.llm.exact_dedup import drop_exact_copies
from motiongraph.llm.mixing import mix_sources
from motiongraph.llm.ngram_join import drop_near_copies
from motiongraph.llm.quality import drop_low_quality
from motiongraph.llm.shared import cut, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier rejects go, judged by id and text; without words they stay."""
    return drop_low_quality(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, also of repeated rows and of null and empty texts, which are equal."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more one row stays, the smallest id's; without words all stay."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go, judged by id and text; null and empty texts stay."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document that bring the sources to their targets; one row a document, also of those taken 0 times."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Not given: the classifier's and the mix's numerical fits have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
