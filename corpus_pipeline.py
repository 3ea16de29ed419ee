"""A training corpus from documents, in five stages; each is one operator of tabulon.llm.

quality: documents that the rules or the n-gram verdict reject go.
lines: lines that an earlier document holds go.
near_duplicates: of each group of near duplicates the document of smallest id stays.
mixing: documents are repeated or left out so that sources meet their target weights.
packing: what is left becomes token pieces packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import written
from tabulon.llm.op2_line_dedup import apply_bitmaps, keep_bitmaps
from tabulon.llm.op3_quality import fit, keep_good, trusted_labels
from tabulon.llm.op4_mixing import mix_documents
from tabulon.llm.op6_packing import pack_documents
from tabulon.llm.op8_jaccard_join import jaccard_groups

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass stay as they are, repeated rows and null ids too; a null or empty text fails the base rules."""
    return keep_good(docs, fit(docs, labelled=trusted_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller id holds go, null ids being the largest; n_chars follows the text; every row stays."""
    out = apply_bitmaps(docs, keep_bitmaps(docs), counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest id (nulls last), then of the smallest hash of its columns.

    Rows are known by two hashes of all their columns, so rows that share an id, or have none, are told
    apart; of rows that are equal in everything one stays.  A text without words is in no group, and all
    its rows stay.  An empty table gives an empty one.
    """
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"})
    carry = {"k1": F.xxhash64(whole), "k2": F.xxhash64(F.lit(1), whole)}
    groups = jaccard_groups(docs, carry=carry).filter("root is not null")
    rows = written(groups.groupBy("root", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times")), "groups")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("s")).select("root", "s.k1", "s.k2")
    once = best.join(rows, ["root", "k1", "k2"]).filter("times = 1").select("k1", "k2")
    gone = written(rows.select("k1", "k2").join(once, ["k1", "k2"], "left_anti"), "gone")
    key = ["__row_hash1", "__row_hash2"]
    keyed = docs.withColumns(dict(zip(key, carry.values(), strict=True)))
    out = keyed.join(gone.toDF(*key), key, "left_anti")
    # Of rows that are equal in everything the first of their group, if they are its best, comes back once.
    again = written(best.join(rows, ["root", "k1", "k2"]).filter("times > 1").select("k1", "k2"), "again")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again.toDF(*key), key, "left_semi").dropDuplicates(key))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows that share id, source and size share their copies."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashed n-gram scores, Newton steps and token ids are out of SQL's reach.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
