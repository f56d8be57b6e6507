"""Papers that arrive file by file: the same cleaning as a stream.

The batch functions take any DataFrame, so a stream of new files runs through them unchanged; each trigger cleans the
files that arrived since, exactly once by the checkpoint, and appends them to the yearly table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from citeweave.operators import cleaning
from citeweave.schema import PAPER_RAW


def arriving(spark: SparkSession, path: str, schema: StructType = PAPER_RAW, files_per_trigger: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def clean_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str, max_year: int, schema: StructType = PAPER_RAW) -> StreamingQuery:
    """Clean what has arrived, append it to ``target`` by year, and stop when nothing is left."""
    rows = cleaning.clean_types(arriving(spark, source, schema), max_year).where(F.col("year").isNotNull())
    return rows.writeStream.format("parquet").partitionBy("year").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
