"""Scans and sinks.

All readers return lazy DataFrames, so Catalyst prunes columns and pushes filters into the
parquet scan; all writers are plain ``DataFrameWriter`` calls that are safe to re-run
(``mode("overwrite")``) after a lost executor or a failed job.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# The strings pandas' CSV reader turns into missing values by default.
PANDAS_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def null_tokens_to_null(c: Column, tokens=PANDAS_NULL_TOKENS) -> Column:
    """Map any exact null token to SQL NULL (trap T1)."""
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def read_csv(spark: SparkSession, path: str, null_tokens=PANDAS_NULL_TOKENS,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column read as a string, pandas null tokens -> NULL.

    ``escape='"'`` makes doubled quotes inside quoted fields a literal quote; ``multiLine``
    keeps quoted newlines inside a field, but then every file is one task; without it Spark
    splits files.
    """
    raw = (spark.read
           .option("header", True)
           .option("inferSchema", False)
           .option("escape", '"')
           .option("multiLine", multi_line)
           .option("mode", "PERMISSIVE")
           .csv(path))
    return raw.select([null_tokens_to_null(F.col(f"`{c}`"), null_tokens).alias(c)
                       for c in raw.columns])


def cap_rows(df: DataFrame, max_rows: int | None, order_by: str | None = None) -> DataFrame:
    """First ``max_rows`` rows, or all rows when ``max_rows`` is None.

    With ``order_by`` the cap is a top-k on the key; without it the first rows in file order
    (:func:`head_of_files`) where ``df`` reads files, so both are the same on every run.
    """
    if max_rows is None:
        return df
    if order_by is not None:
        return df.orderBy(order_by).limit(max_rows)
    return head_of_files(df, max_rows)


def head_of_files(df: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows in order of file path, block and place in the block, of a DataFrame that is
    a plain scan (or a projection of one) of files; other DataFrames have no file order and are an error.

    Rows are counted by file first (for Parquet from the footers), so only the files that the head
    reaches are read; of these a top-k by place is kept, never a sort of all rows."""
    files = df.inputFiles()
    if not files:
        raise ValueError("rows that are not read from files have no order; name a key")
    parquet = all(f.endswith(".parquet") for f in files)
    path = F.col("_metadata.file_path")
    # Parquet tells a row's place; elsewhere a split is read in order, and the id counts inside of it
    block, row = (F.lit(0), F.col("_metadata.row_index")) if parquet else \
        (F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    sizes = df.groupBy(path.alias("f")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    last = sizes.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))) \
        .where(F.col("before") < max_rows).agg(F.max("f")).first()[0]
    if last is None:
        return df.limit(0)
    named = df.where(path <= last).select(
        "*", path.alias("_head_file"), block.alias("_head_block"), row.alias("_head_row"))
    return named.orderBy("_head_file", "_head_block", "_head_row").limit(max_rows).drop(
        "_head_file", "_head_block", "_head_row")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One parquet table partitioned by split (train/val), so a reader of one split
    prunes the other folder."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, split_col: str = "split") -> DataFrame:
    """Read one split of a table written by :func:`write_splits` (partition pruning)."""
    return spark.read.parquet(path).where(F.col(split_col) == split)


def write_parquet(df: DataFrame, path: str) -> None:
    """S7 and other small dictionaries: plain overwrite parquet."""
    df.write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row (keyword documents, metadata)."""
    df.write.mode("overwrite").json(path)
