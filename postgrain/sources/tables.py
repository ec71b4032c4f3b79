"""Landed payload files, the raw archive, board seeds and the spreadsheet export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postgrain.functions.labels import formula_guard
from postgrain.functions.money_time import iso_text
from postgrain.rules.seeds import BOARD_SEEDS

SEEDS = "name string, board string, token string, verified boolean"
LANDING = "source string, token string, category string, query_no int, page int, payload string"


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses as JSON lines, one response per line, schema stated up front."""
    return spark.read.schema(LANDING).json(path)


def read_board_seeds(spark: SparkSession, path: str, only_verified: bool = True) -> DataFrame:
    """Company boards from a CSV with a header; unverified rows are kept out of scans."""
    seeds = spark.read.schema(SEEDS).option("header", True).csv(path)
    return seeds.where("verified") if only_verified else seeds


def board_seeds(spark: SparkSession, only_verified: bool = True) -> DataFrame:
    """The company boards that come with the library, as a table like :func:`read_board_seeds`."""
    return spark.createDataFrame([r for r in BOARD_SEEDS if r[3] or not only_verified], SEEDS)


def with_company(pages: DataFrame, seeds: DataFrame, board: str) -> DataFrame:
    """Landed board pages with the company name of their seed row; unknown boards drop out."""
    names = seeds.where((F.col("board") == board) & F.col("verified")).select(
        "token", F.col("name").alias("company"))
    return pages.join(names, "token")


def append_bronze(items: DataFrame, path: str, run_id: int, fetched_at: Column) -> None:
    """Append every fetched item with its verbatim payload, partitioned by source."""
    items.select(
        F.lit(run_id).cast("bigint").alias("run_id"), "source", "source_native_id", "payload",
        fetched_at.alias("fetched_at"),
    ).write.mode("append").partitionBy("source").parquet(path)


def export_text(rows: DataFrame) -> DataFrame:
    """Cells as spreadsheet text: times in ISO form, nulls empty, formulas disarmed."""
    def cell(name: str, kind: str) -> Column:
        shown = iso_text(name) if kind == "timestamp" else F.col(name).cast("string")
        if kind in ("double", "float"):
            shown = F.regexp_replace(shown, r"\.0$", "")
        return formula_guard(F.coalesce(shown, F.lit(""))).alias(name)

    return rows.select(*[cell(n, k) for n, k in rows.dtypes])


def csv_line(cells: list[Column]) -> Column:
    """Cells as one CSV line: quoted, with doubled quotes, where a cell has a comma, a quote or a line break."""
    quoted = [F.when(F.regexp_like(c, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
              .otherwise(c) for c in cells]
    return F.array_join(F.array(*quoted), ",")


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line): the exported cells of every row as a CSV line, whatever they hold."""
    text = export_text(rows)
    return text.select(csv_line([F.col(c) for c in text.columns]).alias("line"))


def write_csv_export(rows: DataFrame, path: str) -> None:
    """CSV with CRLF rows, doubled quotes and quoting only where needed; cells come back unchanged, line breaks too.

    Rows keep the order of ``rows``: sort them first, and the files in the order of their names are the
    whole. Each file begins with the header, as one file would.
    """
    header = csv_line([F.lit(c) for c in rows.columns])
    # numbers begin anew in the lower 33 bits of each partition
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = csv_lines(rows).select(F.when(first, F.concat(header, F.lit("\r\n"), "line")).otherwise(F.col("line")).alias("value"))
    if lines.isEmpty():
        lines = rows.sparkSession.range(1).select(header.alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)
