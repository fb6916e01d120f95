"""Audit files as they arrive.

A stream of new files (or rows) is audited into a results table, a folder per
batch.  The keys seen so far are kept in the stream's state store, so a batch
costs what it holds and no earlier result is read again.  A batch replayed
after a failure starts from the state before it and overwrites its own output:
late, repeated and re-run input all end in the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.sniff import detected_type, sniff, type_conformance
from sievework.operators.files import is_effectively_empty


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def state_on_disk(spark: SparkSession) -> None:
    """Keep state outside the heap and save what a batch changed, unless the cluster has chosen a store."""
    if not spark.sparkContext.getConf().contains(_PROVIDER):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        spark.conf.set(_CHANGELOG, "true")


def audit_stream(
    stream: DataFrame, audit: Callable[[DataFrame], DataFrame], key: str, target: str, checkpoint: str,
):
    """Run the audit over everything that has arrived, then stop.

    Returns the finished query.  ``audit`` maps each row to its result and
    keeps ``key``.  It comes before the exchange by key, so payloads do not
    travel.  The first batch a key arrives in gives its result; of several
    rows with one key in that batch any may be kept.  A null is a key like any
    other.
    """
    state_on_disk(stream.sparkSession)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (
        audit(stream).dropDuplicates([key]).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New files of a folder as (path, length, content)."""
    return (
        spark.readStream.format("binaryFile").option("maxFilesPerTrigger", max_files)
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").load(path)
    )


def audit_payloads(files: DataFrame, content: str = "content", declared: str | None = None) -> DataFrame:
    """First verdict on a payload: empty, kind, detected type, conformance."""
    body = F.col(content).cast("binary")
    size = F.octet_length(body)
    found = detected_type(body)
    claim = F.col(declared) if declared else F.lit("OTRO")
    return files.withColumns({
        "size_bytes": size.cast("bigint"), "empty": is_effectively_empty(size, body),
        "kind": sniff(body), "detected": found, "__c": type_conformance(claim, found),
    }).withColumns({"score": F.col("__c.score"), "code": F.when(F.col("empty"), "archivo-vacio").otherwise(F.col("__c.code"))}).drop("__c", content)
