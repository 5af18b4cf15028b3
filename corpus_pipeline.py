"""From raw documents to packed training sequences, in five stages.

Each stage works on all documents that the one before kept; its result is
written as Parquet and read again. All but the last return the columns of
documents, with ``n_chars`` as long as the text is; further columns of documents,
whatever their names, are kept as they are.
"""

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import decontaminate, lines, packing, quality, simhash
from ledgerlake.llm.rows import reachable
from ledgerlake.sources.shared import materialise

#: Scores from here on are kept: only documents that are likely bad go.
GOOD = 0.3
#: Near copies: sets of word 5-shingles alike to 0.8 or more.
NEAR = {"similarity": 0.8}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    weights = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = _unused(docs, "quality_score")
    scored = quality.score(docs, weights, keep=tuple(docs.columns), out=out)
    return scored.filter(F.col(out) >= GOOD).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites."""
    # whatever columns there are travel in a struct
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text", "source")
    stripped = lines.strip(packed)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return stripped.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, once
    however often its row repeats. Rows without an id stay."""
    reachable(spark)
    found = simhash.near_duplicates(docs.select("doc_id", "text"), **NEAR)
    kept = materialise(found.filter("doc_id = component_id").select("doc_id", "text_key").distinct(), "kept-rows")
    packed = docs.select("doc_id", _text_key().alias("text_key"), F.struct(*docs.columns).alias("row"))
    rows = packed.join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return rows.select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    bad = materialise(found.filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct(), "contaminated")
    packed = docs.select("doc_id", _text_key().alias("text_key"), F.struct(*docs.columns).alias("row"))
    clean = packed.join(bad, packed["doc_id"].eqNullSafe(bad["bad_id"]) & (packed["text_key"] == bad["bad_key"]), "left_anti")
    return clean.select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of 4096 tokens."""
    reachable(spark)
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: A trained classifier and a tokenizer can't be put in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
