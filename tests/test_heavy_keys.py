"""Keys that have most of the rows: looking them up, and numbering within them."""

from pyspark.sql import functions as F

from postgrain.operators.extraction import pending_batches
from postgrain.operators.identity import look_up


def test_rows_of_a_heavy_key_do_not_move(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("url"))
    table = rows.where("url is not null").groupBy("url").agg(F.min("id").alias("first"))
    found = look_up(rows, table, ["url"])
    want = rows.join(table, "url")
    assert sorted(map(tuple, found.select("id", "url", "first").collect())) == sorted(map(tuple, want.select("id", "url", "first").collect()))
    spread = found.where("url = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < 1200  # of 2,666 rows


def test_a_thread_of_most_comments_is_numbered_by_many_tasks(spark):
    comments = spark.range(3000).select(
        F.when(F.col("id") % 4 != 0, 1).otherwise(F.col("id") % 7).alias("thread_id"), F.col("id").alias("comment_id"),
        ((F.col("id") * 7919) % 1500).alias("position"), F.lit("x").alias("text"))
    cache = comments.where("comment_id % 5 = 0").select("comment_id", F.lit("v").alias("prompt_version"))
    numbered = pending_batches(comments, cache, "v", size=9)
    got = {r.comment_id: r.batch_no for r in numbered.collect()}
    threads = {}
    for r in comments.collect():
        if r.comment_id % 5:
            threads.setdefault(r.thread_id, []).append((r.position, r.comment_id))
    assert got == {c: k // 9 for own in threads.values() for k, (_, c) in enumerate(sorted(own))}
