"""A corpus made ready for training: five stages over ``documents``, each one operator.

Every stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns the columns of documents; the last gives the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, langid, packing, simhash_dedup, suffix_dedup
from folioscope.llm.common import blank, free_name, id_bucket, materialize, quoted

#: Share of a text's trigrams that its language must explain for it to stay.
LEAST_LANGUAGE = 0.2
#: Bytes of a repeated passage that is cut: what fifty words take, but for some 0.6 to 1.5 % of runs of 51 words (one short word
#: over and over, mostly), by language.
PASSAGE = 250


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no known language, and without a letter; fill in a missing language.

    A null or empty text has no letter and goes; rows without an id and
    repeated rows are judged like any other; an empty table stays empty.
    """
    model = langid.train(docs, id_bucket("doc_id", 3) != 1)
    found = free_name(docs, "language")
    judged = langid.predict(docs, model, into=found)
    known = judged.filter((F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_LANGUAGE))
    filled = F.coalesce("lang", f"{found}.lang_pred").alias("lang")
    return known.select(*(filled if c == "lang" else F.col(quoted(c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of five-word similarity of 0.8 or more: the one with the least id.

    Of a group whose rows have no id, the row with the least text key stays;
    of rows that repeat an id and a text, one.  Null and empty texts are alike.
    """
    return simhash_dedup.first_of_each_group(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every repeated passage of ``PASSAGE`` bytes; drop documents of which nothing is left.

    Null and empty texts stay, as empty ones; rows are told apart by id and text, so
    rows without an id, and different texts of one id, are cut each by itself, and
    repeated rows lose what they share; characters that a cut goes through go as a whole.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.without_repeats(docs, columns=rest, length=PASSAGE)
    return cut.select(*(F.length(blank("text")).cast("long").alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Rows are told apart by id and text, so a row without an id is judged too,
    and a clean row stays although another of its id goes; null and empty
    texts and items match nothing.
    """
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens.

    A null or empty text is the end token alone; repeated rows and rows without
    an id are packed once each.
    """
    return packing.pack(packing.token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
