"""A record stream into two tables, valid and quarantine, each record in one of them once.

Every micro-batch goes to a folder of its own in each table, overwritten if the batch is
tried again, and a commit written last makes both visible. Readers take committed batches
only, so they never see one table ahead of the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoscore.sources.storage import exists

_COMMITS = "batch long, checkpoint string"
SCORE_COLUMNS = ("risk_probability", "risk_level")


@dataclass(frozen=True)
class TwoOutputs:
    """The tables ``valid`` and ``quarantine`` below ``path``, filled by one stream.

    ``checkpoint`` names the stream's own log, on shared storage; a stream with another
    log counts its batches anew and is refused.
    """

    path: str
    checkpoint: str

    def committed(self, spark: SparkSession) -> int:
        """The last batch committed, -1 before the first; batches come in order."""
        if not exists(spark, f"{self.path}/commits"):
            return -1
        commits = spark.read.schema(_COMMITS).json(f"{self.path}/commits")
        last, others = commits.agg(
            F.max("batch"), F.count_if(F.col("checkpoint") != self.checkpoint)
        ).first()
        if others:
            raise ValueError(f"{self.path} is filled by a stream with another checkpoint")
        return -1 if last is None else last

    def write_table(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch}")

    def write_batch(self, scored: DataFrame, batch: int) -> None:
        """Both parts of one batch, then its commit; a batch committed before is left alone."""
        spark = scored.sparkSession
        if batch <= self.committed(spark):
            return
        # Checked and scored once for both tables; a lost block is made again from the batch's files.
        rows = scored.persist()
        try:
            good = F.size("errors") == 0
            self.write_table(rows.filter(good).drop("errors", "status"), "valid", batch)
            self.write_table(rows.filter(~good).drop("status", *SCORE_COLUMNS), "quarantine", batch)
        finally:
            rows.unpersist()
        # One file, so that its commit is one rename.
        commit = spark.createDataFrame([(batch, self.checkpoint)], _COMMITS).coalesce(1)
        commit.write.mode("append").json(f"{self.path}/commits")

    def start(self, scored: DataFrame, once: bool = False) -> StreamingQuery:
        """Run on a stream of ``score_stream``; ``once`` stops after the input present now."""
        self.committed(scored.sparkSession)
        writer = scored.writeStream.foreachBatch(self.write_batch).option(
            "checkpointLocation", self.checkpoint
        )
        if once:
            writer = writer.trigger(availableNow=True)
        return writer.start()

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The committed rows of ``valid`` or ``quarantine``, with their ``batch``."""
        last = self.committed(spark)
        if last < 0:
            raise ValueError(f"no batch of {self.path} is committed yet")
        rows = spark.read.parquet(f"{self.path}/{table}")
        return rows.withColumn("batch", F.col("batch").cast("bigint")).filter(F.col("batch") <= last)
