"""Conformance of many tenants' processes in one stream, with settings that the stream itself changes.

A key is a tenant's process. Its messages are traces, and settings that hold from their time on. Messages wait in the key's state until the watermark
has passed their time, and are then taken in order of time and number, so what comes late but within bounds is put right. A key that is silent for
long is given up: its state goes, with a last row that says so.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.functions.running import ALPHA, LEAST_FITNESS, LEAST_PERFECT, MOST_MISSING, WINDOW
from tracelake.operators.nets import net_of, replayed
from tracelake.streaming.conformance import CALIBRATION, SIGMAS, Running

#: A message: a trace with its events, or ``Config`` with settings by name.
MESSAGE = "type string, tenant string, process string, case_id string, seq long, sent timestamp, events array<struct<name:string>>, config map<string,double>"
#: Settings that hold until a message changes them.
SETTINGS = {"window": WINDOW, "alpha": ALPHA, "calibration": CALIBRATION, "sigmas": SIGMAS, "least_fitness": LEAST_FITNESS, "least_perfect": LEAST_PERFECT, "most_missing": MOST_MISSING}
_COUNTED = "tenant string, process string, type string, case_id string, seq long, sent timestamp, counts array<long>, config string"
SNAPSHOT = (
    "tenant string, process string, kind string, case_id string, seq long, sent timestamp, pos long, fitness double, windowed_fitness double, smooth_fitness double, smooth_perfect_rate double, "
    "smooth_avg_missing double, distance double, rules string, least_fitness double, least_perfect double, most_missing double"
)
_NAMES = [c.split()[0] for c in SNAPSHOT.split(", ")]


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The messages in a folder that files of JSON lines are added to; those of other types, or without tenant, process or time, are passed over."""
    rows = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return rows.where("type in ('Trace', 'Config') and tenant is not null and process is not null and sent is not null")


def counted_stream(stream: DataFrame, model: DataFrame) -> DataFrame:
    """Messages with the token counts of their traces on the net ``model``, worked out without state."""
    net = net_of(model)

    def run(batches):
        for batch in batches:
            counts = [None if a is None else list(replayed(net, a)[:4]) for a in batch.column("acts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tenant", "process", "type", "case_id", "seq", "sent")), pa.array(counts, pa.list_(pa.int64())), batch.column("config")], [c.split()[0] for c in _COUNTED.split(", ")])

    acts = F.when(F.col("type") == "Trace", F.transform(F.coalesce("events", F.array().cast("array<struct<name:string>>")), lambda e: e["name"]))
    return stream.select("tenant", "process", "type", "case_id", "seq", "sent", acts.alias("acts"), F.to_json("config").alias("config")).mapInArrow(run, _COUNTED)


class Process:
    """A key's state: its running measures, its settings, the messages that wait, and the time of the last one taken."""

    def __init__(self, kept: str | None = None):
        of = json.loads(kept) if kept else {}
        self.waiting = of.get("waiting", [])
        self.begin(of)

    def begin(self, of: dict) -> None:
        self.running, self.settings, self.last = Running(json.dumps(of["running"]) if of else None), of.get("settings", dict(SETTINGS)), of.get("last")

    def kept(self) -> str:
        return json.dumps({"running": self.running.__dict__, "settings": self.settings, "waiting": self.waiting, "last": self.last})

    def expired(self, at: int) -> tuple:
        return ("expired", None, None, at, self.running.n - 1, *[None] * 6, "", *[None] * 3)

    def taken(self, until: int, idle_ms: int) -> Iterator[tuple]:
        """Rows, from the kind on, of the waiting messages up to a time, in order; after ``idle_ms`` without any the state begins anew.

        A message is (sent in milliseconds, seq, type, case, counts, config).
        """
        ready = sorted((m for m in self.waiting if m[0] <= until), key=lambda m: (m[0], m[1] if m[1] is not None else -1, m[2], str(m[3])))
        self.waiting = [m for m in self.waiting if m[0] > until]
        for sent, seq, kind, case, counts, config in ready:
            if self.last is not None and sent - self.last > idle_ms:
                yield self.expired(self.last + idle_ms)
                self.begin({})
            self.last = sent
            s = self.settings
            if kind == "Config":
                # settings without a sense change nothing
                s |= {k: v for k, v in json.loads(config or "{}").items() if k in SETTINGS and v is not None and v >= 0 and (k != "alpha" or 0 < v <= 1) and (k not in ("window", "calibration") or v >= 1)}
                yield ("config", case, seq, sent, self.running.n - 1, *[None] * 6, "", s["least_fitness"], s["least_perfect"], s["most_missing"])
                continue
            measures = self.running.push(counts, not counts[2] and not counts[3], int(s["window"]), s["alpha"], int(s["calibration"]), s["sigmas"])
            fitness, windowed, smooth, distance, rules = measures
            yield ("trace", case, seq, sent, self.running.n - 1, fitness, windowed, *smooth, distance, rules, s["least_fitness"], s["least_perfect"], s["most_missing"])


def tenant_conformance(counted: DataFrame, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """A row (``SNAPSHOT``) for each message of :func:`counted_stream` once the watermark, ``late`` behind the latest time, has passed it; messages behind the watermark are left out.

    ``kind`` is ``trace``, ``config``, or ``expired`` for a key of which nothing came for ``idle_ms``; what comes after starts anew. State is as large as the last
    traces and what waits, and lies in the query's checkpoint.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        own = Process(state.get[0] if state.exists else None)
        for rows in batches:
            for x in rows.itertuples():
                sent = int(x.sent.value // 1_000_000)
                if sent > now or now == 0:
                    own.waiting.append([sent, None if pd.isna(x.seq) else int(x.seq), x.type, x.case_id, None if x.counts is None else [int(c) for c in x.counts], x.config])
        out = list(own.taken(now, idle_ms))
        if not own.waiting and (own.last is None or own.last + idle_ms < now):
            if own.last is not None:
                out.append(own.expired(own.last + idle_ms))
            if state.exists:
                state.remove()
        else:
            state.update((own.kept(),))
            due = min([m[0] for m in own.waiting] + ([] if own.last is None else [own.last + idle_ms + 1]))
            state.setTimeoutTimestamp(max(due, now + 1))
        frame = pd.DataFrame([(*key, *r) for r in out], columns=_NAMES)
        frame["sent"] = pd.to_datetime(frame["sent"], unit="ms")
        yield frame

    held = counted.withWatermark("sent", late)
    return held.groupBy("tenant", "process").applyInPandasWithState(update, SNAPSHOT, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def tenant_alerts(snapshots: DataFrame) -> DataFrame:
    """(tenant, process, case_id, seq, sent, kind, value, threshold): what each trace breaks of the settings that held for it; ``drift`` for rules of the chart."""
    alert = lambda kind, value, bound, broken: F.when(broken, F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"), bound.alias("threshold")))
    kinds = F.array_compact(F.array(
        alert("fitness_below_threshold", "smooth_fitness", F.col("least_fitness"), F.col("smooth_fitness") < F.col("least_fitness")),
        alert("perfect_rate_below_threshold", "smooth_perfect_rate", F.col("least_perfect"), F.col("smooth_perfect_rate") < F.col("least_perfect")),
        alert("missing_above_threshold", "smooth_avg_missing", F.col("most_missing"), F.col("smooth_avg_missing") > F.col("most_missing")),
        alert("drift", "distance", F.lit(None).cast("double"), F.col("rules") != ""),
    ))
    return snapshots.where("kind = 'trace'").select("tenant", "process", "case_id", "seq", "sent", F.explode(kinds).alias("alert")).select("tenant", "process", "case_id", "seq", "sent", "alert.*")
