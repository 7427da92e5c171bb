"""Sources and sinks besides Parquet: CSV as it is exchanged, JSON, JDBC, documents through a pluggable extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Rows of an extractor: words of a page with their places.
WORDS = "path string, page int, ord bigint, text string, x double, y double, width double"
# Rows of an extractor: cells of the tables of a page.
CELLS = "path string, page int, `table` int, row int, col int, text string"


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """df as CSV with a header, every value quoted, quotes doubled; bom marks each file as UTF-8 for spreadsheets."""
    first = "\ufeff" if bom else ""
    named = df.toDF(f"{first}{df.columns[0]}", *df.columns[1:]) if bom else df
    named.write.option("header", True).option("quoteAll", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What write_csv wrote, by position; a mark at the start of a file is no part of a value."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').option("multiLine", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls left out."""
    df.write.option("ignoreNullFields", True).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table over JDBC in parts by ranges of a key; filters and limits on the result reach the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, pushDownLimit="true", pushDownOffset="true").load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", parts: int = 8, batch: int = 1_000) -> None:
    """df into a table over JDBC through at most `parts` connections, `batch` rows a call; a task that runs again may
    write its rows again, so give the table a key or write to a new one."""
    df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=parts, batchsize=batch).mode(mode).save()


def read_documents(spark: SparkSession, path: str, extract: Callable[[str, bytes], Iterator[dict]], schema: str, glob: str = "*.pdf") -> DataFrame:
    """Rows that `extract(path, content)` yields for each file, in Arrow batches; no extractor is built in.

    Files are read whole, one at a time. One that the extractor cannot read is not lost: it gives one row with its path,
    the error's text in a column `error` if schema has one, and nulls. Files without content are passed over by the scan.
    """
    out = spark.createDataFrame([], schema).schema
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                try:
                    rows = list(extract(name.as_py(), content.as_py()))
                except Exception as e:  # noqa: BLE001
                    rows = [{"path": name.as_py(), "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in arrow.names} for r in rows], schema=arrow)

    return files.mapInArrow(run, out)
