"""A corpus pipeline over the documents table.

Each stage takes the rows that its predecessor kept; `run` writes each one's result as Parquet to the shared folder and
reads it again for the next one, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import prepare, table, written
from driftlake.llm.near_sets import SHINGLE, without_near_copies
from driftlake.llm.packing import pack
from driftlake.llm.secret_scan import secret_spans
from driftlake.llm.simhash import near_duplicates
from driftlake.llm.substring_dedup import without_repeats
from driftlake.llm.toxicity import CUTOFF, held_out, learn, scored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SECRET_MARK = "[secret]"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity classifier rejects; a document without id or text stays. Rows of equal text
    have equal scores, so they stay or go together; a long text is scored whole."""
    prepare(spark)
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    return scored(docs, model, carry=COLUMNS).where(F.col("score") < CUTOFF).select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: that of the smallest id, of equal ids the first. Rows are told apart by
    their place, so rows of one id with unlike texts are documents of their own. Rows without id link and bridge like
    others; they stay only if no row of their group has an id, one for each group. Null and empty texts and texts without
    words are one group; long texts are compared whole.

    Near copies share 0.8 or more of their 5-word shingles (Jaccard), counted with repeats or without. Groups of SimHash
    fingerprints, which count repeats, are checked with repeats: each text against the first of its group by id. Fingerprints
    of 64 bits miss most pairs that are alike without repeats, so an exact join on shingles finds those."""
    prepare(spark)
    return without_near_copies(docs, COLUMNS, groups=lambda rows: near_duplicates(rows, "row", shingle=SHINGLE))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages that stand earlier in the corpus out of the texts. A text without such passages stays as it is; one
    of which nothing is left is kept with an empty text, so every document of the stage before is still there."""
    prepare(spark)
    kept = without_repeats(docs, carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret. Null texts stay null, empty ones empty; a long text is read whole."""
    prepare(spark)
    found = secret_spans(docs, mark=SECRET_MARK, carry=COLUMNS)
    return found.withColumn("text", F.col("redacted")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into token sequences. A null or empty text is the end id alone; long ones are cut into pieces."""
    prepare(spark)
    return pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN, added_tokens=True)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("substrings", substrings), ("secrets", secrets), ("packing", packing)]
#: SQL has no counterpart of the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
