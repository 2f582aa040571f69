"""Alerts that are sent once: quiet periods by key and kind, payloads by receiver, a ledger of what was sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERT = "tenant string, process string, case_id string, seq long, sent timestamp, kind string, value double, threshold double"
_NAMES = [c.split()[0] for c in ALERT.split(", ")]


def quieted(found: DataFrame, quiet_ms: int = 3_600_000) -> DataFrame:
    """``found`` (``ALERT``) without those that come within ``quiet_ms`` after the last that was let through, of the same tenant, process and kind.

    Times are the alerts' own; a trigger's are taken in order of time. State is one number a key.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["sent", "seq"], kind="stable")
        kept = []
        for at, row in zip(rows["sent"], rows.itertuples(index=False)):
            ms = int(at.value // 1_000_000)
            if last is None or ms - last >= quiet_ms:
                last = ms
                kept.append(row)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=_NAMES)

    return found.select(*_NAMES).groupBy("tenant", "process", "kind").applyInPandasWithState(update, ALERT, "last long", "append", GroupStateTimeout.NoTimeout)


def alert_id() -> Column:
    """The same for an alert whenever it is worked out again, so that a receiver knows it too."""
    return F.sha2(F.to_json(F.array("tenant", "process", "kind", F.col("seq").cast("string"), "case_id")), 256)


def summary() -> Column:
    return F.format_string("%s/%s: %s", "tenant", "process", F.concat(F.translate("kind", "_", " "), F.lit(" at "), F.round("value", 4).cast("string"), F.coalesce(F.concat(F.lit(", limit "), F.col("threshold").cast("string")), F.lit(""))))


def payload(receiver: str) -> Column:
    """An alert as a receiver's JSON: ``record`` (all fields), ``chat`` (one line of text), ``ticket`` (a project's issue: the tenant's) or ``event`` (with severity and a key that folds repeats)."""
    severity = F.when(F.col("kind") == "drift", "warning").otherwise("error")
    parts = {
        "record": F.struct("id", *_NAMES),
        "chat": F.struct(summary().alias("text")),
        "ticket": F.struct(F.struct(F.struct(F.col("tenant").alias("key")).alias("project"), summary().alias("summary"), F.concat(F.lit("case "), F.coalesce("case_id", F.lit("unknown"))).alias("description"), F.struct(F.lit("Bug").alias("name")).alias("issuetype")).alias("fields")),
        "event": F.struct(F.lit("trigger").alias("event_action"), F.concat_ws("/", "tenant", "process", "kind").alias("dedup_key"), F.struct(summary().alias("summary"), severity.alias("severity"), F.concat_ws("/", "tenant", "process").alias("source")).alias("payload")),
    }
    if receiver not in parts:
        raise ValueError(f"no receiver {receiver}: one of {', '.join(parts)}")
    return F.to_json(parts[receiver])


def deliver_once(found: DataFrame, receivers: dict[str, Callable[[str, str], None]], ledger: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start sending ``found``'s alerts: ``send(id, payload)`` of every receiver (by its kind of payload) is called on executors.

    What was sent is written to the folder ``ledger``, by receiver and trigger. If a call raises, the others of its trigger still go out and are written down, and the
    trigger fails; run again, it passes over what the ledger holds. Only an executor lost between a call and the end of its task's writing makes it call again, with the same id.
    """
    schema = "id string, receiver string, error string"

    def sending(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.select(alert_id().alias("id"), *_NAMES).dropDuplicates(["id"])
        every = [named.select("id", F.lit(r).alias("receiver"), payload(r).alias("payload")) for r in receivers]
        rows = every[0]
        for more in every[1:]:
            rows = rows.unionByName(more)
        path = f"{ledger}/trigger={number}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(folder):
            done = spark.read.schema(schema).parquet(path).where("error is null").select("id", "receiver")
            rows = rows.join(done, ["id", "receiver"], "left_anti")

        def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                errors = []
                for x in frame.itertuples():
                    try:
                        receivers[x.receiver](x.id, x.payload)
                        errors.append(None)
                    except Exception as e:  # written down; the trigger fails below
                        errors.append(f"{type(e).__name__}: {e}")
                yield pd.DataFrame({"id": frame["id"], "receiver": frame["receiver"], "error": pd.Series(errors, dtype=object)})

        before = spark.read.schema(schema).parquet(path).where("error is not null").count() if files.exists(folder) else 0
        rows.mapInPandas(call, schema).write.mode("append").parquet(path)
        failed = spark.read.schema(schema).parquet(path).where("error is not null").count() - before
        if failed:
            raise RuntimeError(f"{failed} alerts of trigger {number} were not delivered")

    return found.writeStream.foreachBatch(sending).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
