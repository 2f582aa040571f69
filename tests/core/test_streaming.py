"""The stream against its twin over all traces at once."""

import json
import random

from pyspark.sql import functions as F

from tracelake.functions import running as U
from tracelake.operators import nets
from tracelake.streaming import conformance as S
from tracelake.streaming import traces as T


def messages(n, seed):
    random.seed(seed)
    kinds = ["AB", "AB", "AB", "A", "B", "BA", "ABB"]
    return [{"type": "Trace", "process": f"p{k % 2}", "case_id": f"c{k}", "seq": k, "sent": f"2024-01-01T{k % 24:02d}:00:00Z", "events": [{"name": a} for a in ("AB" if k < 80 else random.choice(kinds))]} for k in range(n)]


def test_stream_agrees_with_the_batch_twin(spark, tmp_path):
    sent = messages(260, 4)
    (tmp_path / "in").mkdir()
    model = nets.net(spark, {"t_A": ("A", ["start"], ["p1"]), "t_B": ("B", ["p1"], ["end"])}, ["start"], ["end"])
    for k in range(0, 260, 100):  # three files, one a trigger
        (tmp_path / "in" / f"{k:03d}.json").write_text("\n".join(map(json.dumps, [*sent[k : k + 100], {"type": "Ping"}])))
    stream = T.trace_stream(spark, str(tmp_path / "in"), 1)
    found = S.conformance(S.replay_stream(stream, model))
    query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.key, r.pos): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    net = nets.net_of(model)
    rows = []
    for k, m in enumerate(sent):
        p, c, missing, r, *_ = nets.replayed(net, [e["name"] for e in m["events"]])
        rows.append((m["process"], k // 2, p, c, missing, r, missing == 0 and r == 0))
    arrivals = spark.createDataFrame(rows, "key string, pos long, produced long, consumed long, missing long, remaining long, fit boolean")
    twin = {(r.key, r.pos): r for r in U.smoothed(U.running(arrivals)).collect()}
    assert got.keys() == twin.keys() and len(got) == 260
    for at, r in got.items():
        for name in ("fitness", "windowed_fitness", "smooth_fitness", "smooth_perfect_rate", "smooth_avg_missing"):
            assert abs(r[name] - twin[at][name]) < 1e-9, (at, name)
    assert all(r.distance is None and not r.rules for r in got.values() if r.pos < 30)
    sent_out = S.alerts(spark.read.parquet(str(tmp_path / "out")))
    assert sent_out.where("kind != 'drift'").count() == U.alerts(U.smoothed(U.running(arrivals))).count()


def test_rules_of_drift():
    flat = [0.0, 0.1] * 5
    assert S.broken_rules([*flat, 3.5])[:1] == [1] and 2 in S.broken_rules([0, 2.5, 0, -2.2][:2] + [2.1]) and S.broken_rules([0.5]) == []
    assert 3 in S.broken_rules([1.5, 1.2, 0.1, 1.3, 1.1]) and 3 not in S.broken_rules([-1.5, -1.2, 0.1, 1.3, 1.1])
    assert 4 in S.broken_rules([0.1, 0.2] * 4) and 5 in S.broken_rules([0, -1, -0.5, -0.4, -0.3, 0.1, 0.2, 0.3]) and 5 not in S.broken_rules([1, 2, 3, 4, 5, 6][:6])
    assert 6 in S.broken_rules([0.1, -0.1] * 7) and 6 not in S.broken_rules([0.1, -0.1] * 6)


def test_alerts_are_delivered_and_late_traces_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, messages(60, 1))))
    stream = T.trace_stream(spark, str(tmp_path / "in"))
    out = str(tmp_path / "sent")

    def send(rows):
        import os
        import uuid

        os.makedirs(out, exist_ok=True)
        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{r.key} {r.start}\n" for r in rows)

    S.deliver(T.arrival_rate(stream).where(F.col("traces") > 0), send, str(tmp_path / "check"), availableNow=True).awaitTermination()
    lines = [x for p in (tmp_path / "sent").iterdir() for x in p.read_text().splitlines()] if (tmp_path / "sent").exists() else []
    assert len(lines) == len(set(lines)) and all(x.startswith(("p0 2024-01-01", "p1 2024-01-01")) for x in lines)
