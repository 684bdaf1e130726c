"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared folder and reads again for the next. All but the last keep
the columns of documents: filters return rows as they came; the personal-data
stage rewrites text and n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm import decontam, jaccard, packing, pii, toxicity
from quillspar.llm.queries import word_tokenizer
from quillspar.llm.shared import settle, table
from quillspar.llm.textops import crc32_text


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the class-conditional Kneser-Ney models score below the rejection level.

    A null or wordless text scores as one unknown word does, and stays; repeated
    rows stay or go together; an empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels").where(F.pmod(crc32_text("doc_id"), F.lit(3)) != 1)
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join, under op10's contract: 4 words, 85 %.

    Null and wordless texts are linked with nothing and stay. Where ids repeat or
    are missing, rows are told apart by a number, so of repeated rows one stays.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the winnowing join with the benchmark finds clean: null texts, and all rows if the benchmark is empty, among them."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars, if there, follows the text.

    Every row and column stays, null texts null. Repeated rows are masked alike.
    """
    name = "spans"
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    found = pii.masked(pii.spans(docs, into=name), spans=name)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(f"`{name}`") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.drop(name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of each remaining document, with their token ids; a null or empty text is its closing id alone."""
    return packing.power_of_two_pieces(docs, word_tokenizer(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Learned models and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
