"""A training-data pipeline over ``documents``: language ID, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame, which
``run`` writes as Parquet and reads again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, langid, lines, simhash
from corvane.llm._common import remainder, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score below which no language is nearer than the others to speak of.
LEAST_SCORE = 0.3
#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that no learnt language is clearly nearest to; also rows without an
    id, to which no later decision could refer. Prototypes are learnt from labelled documents of other ids than every
    fourth's."""
    prototypes = langid.fit(docs.where(remainder("doc_id", 4) != 2), "text", "lang", "doc_id")
    found = langid.predict(docs.where("doc_id IS NOT NULL"), "text", prototypes, "_lang_pred", "_lang_score")
    return found.where((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_score") >= LEAST_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines away that stand before, equal or nearly so; documents that have no text left go."""
    found = lines.without_repeats(docs, "doc_id", "text", carry=("lang", "source"))
    found = found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))
    return found.where(F.col("text").rlike(r"[^\x09-\x0D ]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near-duplicates, by SimHash of five-word shingles; of
    several rows with that id, one. Fingerprints of two bits' difference are those of texts that are all but equal; how
    many pairs of similarity 0.8 that leaves is in the README."""
    groups = simhash.near_duplicates(docs, "doc_id", "text", shingle=SHINGLE)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    row = F.struct("text", "lang", "source", "n_chars")
    return docs.join(first, "doc_id").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs. Null and empty texts have none and stay, as do all
    columns of documents; repeated rows are judged alike; long texts are searched whole."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, "text", items, "item_id", "text").where(F.size("hit_spans") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to its bytes again. A null text is an empty one, without ids; repeated
    rows stay; long texts are encoded whole."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = bpe.encode(docs, "text", *vocabulary, decoded="decoded")
    return found.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: Edit distances, hyperdimensional profiles and BPE have no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
