"""Corpus pipeline: toxicity, near-duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents (doc_id, text, lang, source, n_chars). `run` writes every stage's rows to the shared folder and
reads them back for the next one; a stage's working tables go once its rows are written, and its input with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import drop_path, kept_output, table
from strandline.llm.components import connected_components
from strandline.llm.jaccard import jaccard_links
from strandline.llm.mixing import curriculum, mix
from strandline.llm.packing import pack_documents
from strandline.llm.simhash import near_duplicates
from strandline.llm.suffixes import remove_repeats
from strandline.llm.toxicity import score_toxicity, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not reject; it learns from the labels of sf_dir that are not held out."""
    model = train(docs, table(spark, sf_dir, "labels"))
    judged = score_toxicity(docs, model, carry=tuple(c for c in COLUMNS if c != "doc_id"))
    return judged.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the smallest id of each near-duplicate component, and those without an id.

    Of rows that repeat an id and its text one stays, the smallest in the other columns; different texts under one id
    all stay or go with it. Documents link by op6's fingerprints (four words, at most 4 differing bits) or by a five-word Jaccard of 0.8 or more.
    """
    slim = docs.select("doc_id", "text")
    close = near_duplicates(slim).where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    gone = connected_components(close.union(jaccard_links(slim))).where("node <> component").select(F.col("node").alias("d"))
    own = docs.where("doc_id is not null").join(gone, F.col("doc_id") == F.col("d"), "left_anti")
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = own.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*")
    return one.unionByName(docs.where("doc_id is null").select(*COLUMNS)).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that also stand elsewhere; a text of which no word is left goes.

    A cut inside a character drops what is left of it.
    """
    left = remove_repeats(docs, carry=("lang", "source", "n_chars"))
    cut = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    changed = F.col("n_removed") > 0
    left = left.withColumn("text", F.when(changed, cut).otherwise(F.col("kept").cast("string"))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: every document as often as it is taken."""
    return curriculum(mix(docs.select(*COLUMNS))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token runs of all documents of the mix, packed into sequences."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("mix_to_weights", mix_sources),
    ("best_fit_packing", pack),
]

#: The classifier and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = kept_output(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
