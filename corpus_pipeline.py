"""From documents to packed training bins, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varidia.llm._shared import removed, written
from varidia.llm.langid import UND, has_letter, identify_language, train_langid
from varidia.llm.mixing import mix_sources
from varidia.llm.neardup import deduplicate
from varidia.llm.packing import pack
from varidia.llm.quality import score_quality, train_quality

#: Least probability of the likeliest language: below it, all others together are likelier.
FLOOR = 0.5


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _free(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """The names with as many underscores before them as no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    return tuple(next(n for k in range(2, len(taken) + 3) if (n := "_" * k + name) not in taken) for name in names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones, scores below 0.3 go."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = _free(docs, "score", "predicted")
    return score_quality(docs, model, out=(score, predicted)).filter(F.col(predicted) == 1).select(*_own(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those in which no language has FLOOR of the network's probability.

    Where no language can be learned, all documents with a letter stay.
    """
    net, langs = train_langid(docs)
    if not langs:
        return docs.filter(has_letter("text"))
    lang, score = _free(docs, "lang_pred", "score")
    return identify_language(docs, net, langs, out=(lang, score)).filter((F.col(lang) != UND) & (F.col(score) >= FLOOR)).select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays."""
    return deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words without two texts of one source or two equal texts."""
    return pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No SQL: two stages apply models that are trained here. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
