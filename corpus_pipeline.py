"""From raw documents to encoded training data, in five stages.

Each stage works on all that its predecessor kept:

1. toxicity: documents scored 0.7 or more go;
2. near_duplicates: one document of each group of five-word-shingle duplicates
   (similarity 0.8 or more) stays;
3. secrets: found spans are replaced, no document goes;
4. source_mix: documents repeat, or are left out, as source weights ask;
5. encoding: every document's byte-level BPE ids, checked by decoding.

Null and empty texts score what no evidence scores, have no duplicates and no
secrets, add no words to the mix (which leaves them out) and encode to nothing.
Rows that repeat in full count as one from the second stage on; rows that share
an id but not the text stay apart.  An empty table gives an empty one.  Extra
columns pass through all stages but the last, whatever their names.

``ORACLE_SQL`` is None: SQL can express neither the classifier nor the encoder.
The tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import stored
from tidewright.llm.near_dup import near_duplicates
from tidewright.llm.secret_scan import without_secrets
from tidewright.llm.source_mix import mix_sources
from tidewright.llm.toxicity import fit_toxicity, without_toxic
from tidewright.llm.tree_bpe import bpe_round_trip
from tidewright.plans import workers


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers.find_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, fit_toxicity(docs, labels), threshold=0.7)


def _free(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that the rows don't hold."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name += "_"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a hash of their text, which tells rows of one id apart, and its column's name."""
    key = _free(docs, "_th")
    return docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))), key


def _same_row(docs: DataFrame, key: str, other: DataFrame) -> F.Column:
    return docs["doc_id"].eqNullSafe(other["doc_id"]) & (docs[key] == other["th"])


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group; equal rows count as one."""
    workers.find_package(spark)
    rows, key = _keyed(docs)
    kept = near_duplicates(docs, width=5, percent=80, keep_hash=True).filter("kept").select("doc_id", "th").distinct()
    rows = rows.join(kept, _same_row(rows, key, kept), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers.find_package(spark)
    clean = without_secrets(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text")).cast(kind)
        clean = clean.withColumn("n_chars", length)
    return clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; equal rows share their copies evenly."""
    workers.find_package(spark)
    rows, key = _keyed(docs)
    one = _free(docs, "_copy")
    plain = rows.select("doc_id", "source", "text", F.col(key).alias("th"))
    mixed = mix_sources(plain, weights=(5, 2, 1), total=1.5, most=2, keep=("th",))
    mixed = mixed.groupBy("doc_id", "th").agg(F.round(F.avg("copies")).cast("int").alias("copies")).filter("copies > 0")
    taken = rows.join(mixed, _same_row(rows, key, mixed))
    return taken.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), mixed["copies"])).alias(one)).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    workers.find_package(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_dup),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
