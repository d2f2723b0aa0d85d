"""The log as a stream: each micro-batch adds the events that are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import py_strip
from ..operators.claims import first_write_wins, missing_events
from ..session import path_exists


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(archivo, bloque, linea, id, ev) of the lines that arrive in a folder of log files."""
    place = [F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("bloque")]
    lines = spark.readStream.text(folder).select(*place, py_strip(F.col("value")).alias("linea")).where(F.col("linea") != "")
    return lines.select("archivo", "bloque", "linea", F.get_json_object("linea", "$.id").alias("id"), F.get_json_object("linea", "$.ev").alias("ev"))


def ingest_stream(lines: DataFrame, table: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keeps a Parquet table (seq, linea, id, ev) of the events the projection keeps.

    Of an id of one kind the first row in log order counts, a batch before a
    later one; rows with a null id and assertions, which are a bag, are all
    kept.  A batch that is run again after a failure, over the same splits,
    finds its rows already there and adds nothing twice.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = F.struct("archivo", "bloque", F.monotonically_increasing_id().alias("fila"))
        rows = batch.select(place.alias("seq"), "linea", "id", "ev")
        bag = F.col("id").isNull() | F.coalesce(F.col("ev") == "referente_assert", F.lit(False))
        key = F.struct(F.coalesce("ev", F.lit("")).alias("ev"), "id")
        every = rows.where(bag)
        first = first_write_wins(rows.where(~bag).withColumn("clave", key), "clave")
        if path_exists(spark, table):
            old = spark.read.parquet(table)
            every = missing_events(every, old, "seq")
            first = missing_events(first, old.where(~bag).select(key.alias("clave")), "clave")
        every.unionByName(first.drop("clave")).write.mode("append").parquet(table)

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
