"""Streams of several tenants: settings that change, late messages, keys that expire, alerts sent once."""

import json
import os

import pytest

from tracelake.operators import nets
from tracelake.streaming import delivery as D
from tracelake.streaming import tenants as N
from tracelake.streaming.conformance import Running


def message(tenant, seq, minute, acts=None, process="p", **config):
    return {"type": "Trace" if acts is not None else "Config", "tenant": tenant, "process": process, "case_id": f"{tenant}{seq}", "seq": seq, "sent": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "events": [{"name": a} for a in acts or ""], "config": config or None}


def written(spark, tmp_path, files, build, out="out"):
    (tmp_path / "in").mkdir(exist_ok=True)
    for k, rows in enumerate(files):
        (tmp_path / "in" / f"{k:03d}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / "in" / f"{k:03d}.json", (1_000_000 + k, 1_000_000 + k))
    found = build(N.message_stream(spark, str(tmp_path / "in"), 1))
    found.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"check-{out}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / out))


@pytest.fixture
def model(spark):
    return nets.net(spark, {"t_A": ("A", ["start"], ["p1"]), "t_B": ("B", ["p1"], ["end"])}, ["start"], ["end"])


def test_settings_late_messages_and_expiry(spark, tmp_path, model):
    first = [message("x", k, k, "AB") for k in (0, 2, 3)] + [message("y", k, k, "A") for k in range(4)] + [{"type": "Ping", "tenant": "x"}]
    second = [message("x", 1, 1, "A"), message("x", 4, 4, least_fitness=0.99, alpha=1.0, window=1, sigmas=-1), message("x", 5, 5, "B"), message("z", 0, 5, "AB", least_perfect=0.2)]
    third = [message("y", 9, 400, "AB")]
    last = [message("y", 10, 800, "AB"), message("x", 6, 2, "AB")]  # x is far too late now
    rows = written(spark, tmp_path, [first, second, third, last, [message("w", 0, 1_300, "AB")]], lambda s: N.tenant_conformance(N.counted_stream(s, model), "10 minutes", 3_600_000))
    got = {}
    for r in rows.orderBy("sent", "pos").collect():
        got.setdefault(r.tenant, []).append(r)
    x = got["x"]
    assert [(r.kind, r.seq) for r in x] == [("trace", 0), ("trace", 1), ("trace", 2), ("trace", 3), ("config", 4), ("trace", 5), ("expired", None)]
    own, net = Running(), nets.net_of(model)
    for k, acts in enumerate(["AB", "A", "AB", "AB", "B"]):
        counts = list(nets.replayed(net, acts)[:4])
        fitness, windowed, smooth, *_ = own.push(counts, not counts[2] and not counts[3], *((1, 1.0) if k == 4 else ()))
        r = next(r for r in x if r.kind == "trace" and r.pos == k)
        assert (r.fitness, r.windowed_fitness, r.smooth_fitness, r.least_fitness) == (fitness, windowed, smooth[0], 0.99 if k == 4 else 0.8)
    assert [(r.kind, r.pos) for r in got["y"]] == [*(("trace", k) for k in range(4)), ("expired", 3), ("trace", 0), ("expired", 0), ("trace", 0), ("expired", 0)]
    again = next(r for r in got["y"] if r.seq == 9)
    assert again.pos == 0 and again.fitness == 1.0  # after it had expired
    alerts = N.tenant_alerts(rows).collect()
    assert {(a.tenant, a.kind) for a in alerts if a.seq == 5} >= {("x", "fitness_below_threshold")}
    assert all(a.threshold == 0.99 for a in alerts if a.tenant == "x" and a.seq == 5 and a.kind == "fitness_below_threshold")


def test_alerts_are_sent_once(spark, tmp_path):
    source = spark.createDataFrame([("x", "p", f"c{k}", k, None, "drift" if k % 2 else "missing_above_threshold", 4.5, None if k % 2 else 5.0) for k in range(12)] * 2, D.ALERT.replace("sent timestamp", "sent string"))
    source.withColumn("sent", D.F.timestamp_seconds(D.F.lit(1_700_000_000) + D.F.col("seq") * 600)).coalesce(1).write.parquet(str(tmp_path / "alerts"))
    stream = spark.readStream.schema(D.ALERT).parquet(str(tmp_path / "alerts"))
    out, flaky = str(tmp_path / "sent"), str(tmp_path / "mended")
    os.makedirs(out)

    def send(kind):
        def call(key, payload):
            if kind == "chat" and "missing" in payload and not os.path.exists(flaky):
                raise ConnectionError("no answer")
            with open(f"{out}/{kind}-{key}", "a") as f:  # a second call would add a line
                f.write(payload + "\n")

        return call

    start = lambda: D.deliver_once(stream, {k: send(k) for k in ("record", "chat", "ticket", "event")}, str(tmp_path / "ledger"), str(tmp_path / "check"), availableNow=True)
    with pytest.raises(Exception, match="were not delivered"):
        start().awaitTermination()
    assert len(os.listdir(out)) == 12 * 4 - 6
    open(flaky, "w").close()
    start().awaitTermination()
    files = [(tmp_path / "sent" / f).read_text().splitlines() for f in os.listdir(out)]
    assert len(files) == 12 * 4 and all(len(lines) == 1 for lines in files)
    payloads = [json.loads(lines[0]) for lines in files]
    assert sum("text" in p for p in payloads) == sum("fields" in p for p in payloads) == sum("event_action" in p for p in payloads) == 12
    assert {p["fields"]["project"]["key"] for p in payloads if "fields" in p} == {"x"} and any(p.get("text") == "x/p: missing above threshold at 4.5, limit 5.0" for p in payloads)
    with pytest.raises(ValueError, match="no receiver"):
        D.payload("fax")


def test_quiet_periods(spark, tmp_path):
    rows = [("x", "p", f"c{k}", k, None, kind, 1.0, 1.0) for k in range(10) for kind in ("drift", "missing_above_threshold")]
    held = spark.createDataFrame(rows, D.ALERT.replace("sent timestamp", "sent string")).withColumn("sent", D.F.timestamp_seconds(D.F.lit(1_700_000_000) + D.F.col("seq") * 600))
    for k in (0, 5):
        held.where(f"seq >= {k} and seq < {k + 5}").coalesce(1).write.mode("append").parquet(str(tmp_path / "alerts"))
    stream = spark.readStream.schema(D.ALERT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "alerts"))
    D.quieted(stream, 1_800_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.kind, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((kind, k) for kind in ("drift", "missing_above_threshold") for k in (0, 3, 6, 9))
