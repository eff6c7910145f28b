"""A corpus pipeline: five operators in a row over ``documents``, each reading what the one before it wrote.

1. language: documents whose language cannot be told go;
2. near duplicates: one document of each group of linked documents stays;
3. repeats: strings of 100 bytes that also start earlier are cut from the texts (``n_chars`` follows);
4. decontamination: documents that hold a benchmark item, give or take a tenth of its length in edits, go;
5. mixing: every document gets its place in a mix of the sources to target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.base import materialise
from lexiloom.llm.decontaminate import drop_contaminated
from lexiloom.llm.language import fit_language, keep_identified
from lexiloom.llm.mixing import mix_sources, targets
from lexiloom.llm.ngram_join import keep_one_of_each
from lexiloom.llm.suffix_dedup import cut_repeats
from lexiloom.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go, and those under the model's level; repeated rows stay or go together; columns beyond
    those of documents go along.  Without labelled texts no language is known, and every document goes."""
    ship(spark)
    return keep_identified(docs, fit_language(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.75 the smallest id stays, of different texts under one id the one of the
    smallest hash; a null id is smallest, repeated rows are copies, texts without words all stay."""
    ship(spark)
    return keep_one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that start earlier; every row stays, a null text stays null, a text of which nothing is
    left is empty, and ``n_chars`` follows the text."""
    ship(spark)
    out = cut_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item within a tenth of its length in edits go; null and empty texts stay, null and empty items are
    found nowhere."""
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with its block, slot and place in the mix; a null source is a source of its own; an empty table gives none."""
    ship(spark)
    names = [r[0] for r in docs.select("source").distinct().collect()]  # one row a source
    return mix_sources(docs, targets(names))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("mixing", mixing)]

#: The models and the suffix order are beyond SQL: the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
