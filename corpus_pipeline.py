"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; the last one gives packed pieces, the others keep the columns
of the documents. ``run`` writes each stage's rows as Parquet to the folder of ``spark.checkpoint.dir`` and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subvox.llm import langid, minhash, mixing, packing, pii
from subvox.llm.common import fresh, prepare, saved
from subvox.llm.queries import tokenizer_path, training


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; rejected ones, and those without a letter, go.

    If no row that may be learned from has a language, nothing can be judged and all documents stay. Each row is judged by its
    own text, so that repeated rows stay or go together.
    """
    prepare(spark)
    model = langid.fit(training(docs))
    if not model.languages:
        return docs
    found = fresh(docs, "_judged")
    judged = docs.withColumn(found, langid.identify(docs, model))
    return judged.where(f"not {found}.rejected").drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more).

    Texts without words are in no group. Rows that repeat a key are one document and stay once for each different text; rows
    without a key stay.
    """
    prepare(spark)
    return minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    prepare(spark)
    found = fresh(docs, "_found")
    rows = docs.withColumn(found, pii.detect(docs, pii.fit(docs), redacted=True))
    new = {"text": F.col(f"{found}.redacted"), "n_chars": F.length(f"{found}.redacted").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a second copy is a row of its own."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    prepare(spark)
    return packing.pack_documents(docs, tokenizer_path(), special=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The learned and hashed stages can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{name}")
    return docs
