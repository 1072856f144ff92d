"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Null texts have no words, so the first stage drops them.
Rows with a null id are judged like others. Very long texts are read whole by every stage, and columns of other names go
along. Empty tables stay empty throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import bpe, decontaminate, line_dedup, near_dup, quality
from strataloom.llm.common import table, written
from strataloom.llm.queries import RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the cascade rejects go."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    return quality.judge(rows).where("kept").select("_row.*")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; n_chars follows the text.

    Null texts stay null. Rows that agree in id and text count as one document and lose the same lines.
    """
    out = line_dedup.line_dedup(docs, least_docs=10, least_chars=1)
    row = F.col("_row").withField("text", F.col("_lines.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("_lines.text").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("_row")).select("_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five words and a similarity of 0.8, one document stays: that of the smallest id.

    Where ids repeat or are null, rows are told apart by id and text and numbered in the order of their ids, nulls last:
    rows that agree in both are one, and of a group the row of the smallest number stays. Null and blank texts have no
    links and stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_ids")).first()
    if ids.n == ids.n_ids:
        keyed = docs.select(F.col("doc_id").cast("long").alias("key"), "text", row)
    else:
        rows = docs.select(row, "doc_id", "text").dropDuplicates(["doc_id", "text"]).orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        keyed = written(rows.select(F.monotonically_increasing_id().alias("key"), "text", "row"), "numbered")
    found = near_dup.near_duplicates(keyed, id_col="key", width=5, percent=80)
    gone = written(found.where("NOT kept").select("key"), "near")
    return keyed.join(gone, "key", "left_anti").select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, literally or with other parameters, go.

    Null and empty texts hold none and stay, as do rows with a null id and clean repeated rows.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and the digest of what they decode to, of each row; null texts have no tokens."""
    coded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_common_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", tokenise),
]
#: The near-duplicate stage follows links transitively and the last stage merges bytes by rank: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
