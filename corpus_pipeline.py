"""A corpus pipeline over ``documents``: each stage calls one operator and its decisions take effect.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
for the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.llm import decontamination, jaccard_join, length_buckets, quality_fm, secret_ledger
from postgrain.llm.queries import BYTE_TOKENIZER
from postgrain.llm.shared import by_place, new_folder, position, short_batches, staged

# Documents without an id are known by their text: keys from here on. Ids are expected below.
UNNAMED = 1 << 62


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from every label of the folder.

    All columns stay, whatever their names. Null text is judged as an empty one, repeated rows alike; rows
    without an id are judged but not learned from. An empty table stays empty.
    """
    short_batches(spark)
    model = quality_fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = by_place(quality_fm.predict(docs, model))
    count = len(docs.columns)
    return judged.where(F.col(f"c{count + 1}") == 1).select(*(f"c{k}" for k in range(count))).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Documents without a doc_id take part, after all others, and are known by their text. Rows of one doc_id
    are one document: the row with the smallest text (by its digest), then the smallest of the other columns,
    stays. Documents without words are no duplicates of others. All columns stay, whatever their names; an empty
    table stays empty.
    """
    short_batches(spark)
    names, plain = docs.columns, by_place(docs)
    text, doc = F.col(f"c{position(docs, 'text')}"), F.col(f"c{position(docs, 'doc_id')}").cast("long")
    nameless = F.lit(UNNAMED) + F.abs(F.xxhash64(F.coalesce(text, F.lit(""))) % F.lit(UNNAMED))
    keyed = plain.withColumn("key", F.coalesce(doc, nameless))
    found = staged(jaccard_join.near_duplicates(keyed.select(F.col("key").alias("doc_id"), text.alias("text"))), "near-duplicates")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("key"))
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    again = staged(again.select(F.col("doc_id").alias("key")), "repeated")  # of its own, as there are few
    noted = staged(gone.union(again).distinct(), "noted")
    single = keyed.join(noted, "key", "left_anti").select(*plain.columns)
    ordered = [f.name for f in plain.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = F.struct(F.sha2(F.coalesce(text, F.lit("")), 256), *ordered)
    first = keyed.join(again, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct(*plain.columns), order).alias("first"))
    return single.unionByName(first.select("first.*")).toDF(*names)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage in them; each row counts by its own text, with or without a doc_id.

    All columns stay, whatever their names. Null text has no passage; repeated rows go or stay together; an empty
    table stays empty.
    """
    short_batches(spark)
    return decontamination.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and ``n_chars`` counted anew where there were any.

    All columns stay, whatever their names. Null text stays null; repeated rows all stay; an empty table stays empty.
    """
    short_batches(spark)
    at = {name: position(docs, name) for name in ("text", "n_chars")}
    plain = by_place(docs)
    found = secret_ledger.secrets(plain.withColumnRenamed(f"c{at['text']}", "text"))
    clean = found.withColumn("text", secret_ledger.masked(F.col("text"), F.col("spans")))
    counted = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col(f"c{at['n_chars']}"))
    columns = [F.col("text") if k == at["text"] else counted if k == at["n_chars"] else F.col(f"c{k}") for k in range(len(docs.columns))]
    return clean.select(*columns).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, a sequence each: the rows that a trainer reads.

    Null and empty texts are their end id alone; repeated rows are packed as often as they come; other columns
    end here; an empty table gives no pieces.
    """
    short_batches(spark)
    rows = by_place(docs).select(*(F.col(f"c{position(docs, n)}").alias(n) for n in ("doc_id", "text")))
    pieces = length_buckets.decompose(rows, BYTE_TOKENIZER)
    digests = staged(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return length_buckets.numbered(digests).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("packing", packing),
]

#: Not expressible: a trained classifier and a tokenizer decide on the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
