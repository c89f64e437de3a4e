"""A training-corpus pipeline over ``documents``: language ID, quality rules, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept; its result is written as
parquet and read again as the next one's input. All stages but the last return all columns of
their input, whatever their names; what a stage derives never stands beside them. A table that one
stage needs twice is read from parquet, so nothing is held in memory. An empty table gives an
empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.llm import langid, mixing, packing, quality, simhash
from quiresmith.llm.common import Shelf, map_texts
from quiresmith.llm.tokens import public_path

#: Share of a document's letters that its language must have; below, it is a mixture of languages.
MIN_LANGUAGE_SHARE = 0.5
#: Words of a shingle and similarity from which documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Target token shares of the label domains; the quality rules have taken the low one.
MIX = {"clean": 0.90, "toxic": 0.10}


def _hidden(docs: DataFrame) -> tuple[DataFrame, list[str], str, str]:
    """The documents under names that clash with nothing, those names, and which are id and text."""
    names = [f"c{i}_" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("doc_id")], names[docs.columns.index("text")]


def _shown(rows: DataFrame, names: Sequence[str], docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; texts without a letter and mixtures go.

    Null and empty texts have no letter. Repeated rows and null ids are judged like any others; a tie
    of two languages with half of the letters each stays. Where no row has a language nothing can be
    learned, and all rows stay.
    """
    model = langid.fit(docs)
    hidden, names, _, text = _hidden(docs)
    if not model.langs:
        return docs
    labelled = map_texts(hidden, [F.col(c) for c in names], F.col(text), lambda: model.label, langid.RESULT[:2])
    keep = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE)
    return _shown(labelled.where(keep), names, docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rule and that no learned rule takes.

    Texts are measured once: statistics and documents are written together, rules are learned from
    the labelled ones, and the rest is a filter. Null and empty texts fail the base rule; repeated
    rows and null ids are judged like any others.
    """
    hidden, names, key, text = _hidden(docs)
    measured = Shelf(spark, "quality").put(map_texts(hidden, [F.col(c) for c in names], F.col(text), quality.measurer, quality.FIELDS))
    rules = quality.fit(measured.withColumnRenamed(key, "doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = F.when(~quality.base_failed(), F.coalesce(quality.verdict(rules), F.lit(-1)))
    return _shown(measured.where(verdict == -1), names, docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id (null last).

    Rows that share an id but not their text are documents of their own; of rows that repeat id and
    text one stays. Null and empty texts are copies of each other.
    """
    return simhash.distinct_documents(docs, width=SHINGLE, least=SIMILARITY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: the expected token shares match the targets.

    A rate is rounded up or down by the hash of id and text, so rows that repeat both are copied
    equally often. A null text has no words and the prior's rate. Without labels all rates are 1.
    """
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = mixing.fit_classifier(docs, labelled)
    hidden, names, key, text = _hidden(docs)
    table = Shelf(spark, "posteriors").put(mixing.posteriors(hidden, model, [], text))
    rates = mixing.fit_rates(table, model.domains, MIX)
    rated = mixing.posteriors(hidden, model, [F.col(c) for c in names], text, rates)
    rated = rated.withColumn("copies", mixing.copies(F.col("rate"), F.col(key), F.col(text))).where("copies > 0")
    return _shown(rated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), names, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 1024 tokens.

    A null or empty text is its end token alone; repeated rows are packed each for itself.
    """
    return packing.pack(docs, public_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("mixture", mixture),
    ("packing", packing_stage),
]

#: No stage but deduplication could be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shelf = Shelf(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shelf.put(docs)
    return docs
