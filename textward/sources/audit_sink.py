"""Sinks of audit records: append-only files, and a stream whose batches can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_audit(records: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Adds the records to the log in path; nothing there is changed. A rerun adds them again, with the same scan_id."""
    records.write.mode("append").format(file_format).save(path)


def stream_audit(records: DataFrame, path: str, checkpoint: str, file_format: str = "parquet", **trigger) -> StreamingQuery:
    """Writes a stream of records below path, one folder epoch=N a batch; a batch that is repeated after a failure
    replaces its own folder, so each record is in the log once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").format(file_format).save(f"{path}/epoch={epoch}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def latest(log: DataFrame) -> DataFrame:
    """One record for each scan_id of a log, the newest; records that tie are alike but for their time."""
    newest = F.max_by(F.struct(*log.columns), "timestamp")
    return log.groupBy("scan_id").agg(newest.alias("r")).select("r.*")
