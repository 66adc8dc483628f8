"""A stream of mail files as a stream of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.messages import parse
from postmill.operators.notes import note_path, render
from postmill.sources.mail import read_mail_stream


def note_stream(spark: SparkSession, folder: str, zone: str = "UTC", style: str = "markdown") -> DataFrame:
    """(path, markdown, error) of each mail that arrives; every step is narrow, so no state is kept."""
    messages = parse(read_mail_stream(spark, folder), style=style)
    return render(messages, zone, style=style).select(note_path("path").alias("path"), "markdown", "error")


def start(notes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the notes to a Parquet table, each once, whatever is restarted."""
    return notes.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
