"""Files that arrive or change, analysed as they come: a file stream, split and analysed by micro-batch.

A batch's files replace the rows of the same file in the target tables, which are partitioned by batch; readers take the last batch of a file
(``latest``). Replays after a failure overwrite the same batch folder, so a file is never counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.flow import Options
from ..plans.engine import Estate


def file_stream(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    rows = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", most_files).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def reanalyse(files: DataFrame, target: str, checkpoint: str, dialect: str = "auto", options: Options | None = None) -> StreamingQuery:
    """Analyses every batch of a stream of files into target/analysed and target/units."""

    def batch(df: DataFrame, number: int) -> None:
        estate = Estate(df, dialect, options=options or Options())
        for name, rows in (("units", estate.units), ("analysed", estate.rows)):
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """units joined with their analysis, of each file's last batch."""
    units = spark.read.parquet(f"{target}/units")
    last = units.withColumn("last", F.max("batch").over(Window.partitionBy("file_id"))).filter("batch = last").drop("last")
    return last.join(spark.read.parquet(f"{target}/analysed"), ["unit_id", "batch"])
