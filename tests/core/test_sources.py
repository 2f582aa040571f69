"""Every source against its sink."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import follows, objects
from tracelake.sources import logs


@pytest.fixture
def log(spark):
    rows = [
        ("1", 0, "A & <b>", 1_577_872_800_123, {"who": 'O"Neil', "x": "1"}), ("1", 1, "C", None, {}), ("1", 2, "A & <b>", 1_577_872_900_000, {"who": "é"}),
        ("2", 0, "C", 1_577_872_800_000, {}), ("3>4", 0, "D, E", 0, {"k": "a,b"}),
    ] + [(f"n{k}", i, "N", None, {}) for k in range(40) for i in range(3)]
    return spark.createDataFrame(rows, "case_id string, event_idx long, activity string, ts_ms long, attributes map<string,string>")


def rows(df):
    return sorted((r.case_id, r.event_idx, r.activity, str(r.ts_ms), json.dumps(r.attributes, sort_keys=True)) for r in df.collect())


def test_xes(spark, log, tmp_path):
    logs.write_xes(log.repartition(3, "case_id"), str(tmp_path / "x"))
    assert rows(logs.read_xes(spark, str(tmp_path / "x"))) == rows(log)


def test_xes_repeats_a_key_and_lacks_a_name(spark, tmp_path):
    event = '<event><string key="concept:name" value="{}"/><string key="k" value="1"/><string key="k" value="2"/><int key="k" value="3"/><string key="j" value="4"/></event>'
    (tmp_path / "a.xes").write_text(f'<?xml version="1.0"?><log><trace><string key="concept:name" value="c"/>{event.format("A")}</trace><trace>{event.format("B")}</trace></log>')
    got = sorted(logs.read_xes(spark, str(tmp_path / "a.xes")).collect(), key=lambda r: r.activity)
    assert [r.attributes for r in got] == [{"k": "3", "j": "4"}] * 2 and got[0].case_id == "c" and got[1].case_id.startswith("case_")


def test_csv(spark, log, tmp_path):
    logs.write_csv_log(log, str(tmp_path / "c"))
    back = logs.read_csv_log(spark, str(tmp_path / "c"))
    plain = log.withColumn("attributes", F.create_map().cast("map<string,string>"))
    assert rows(back) == rows(plain)


def test_csv_headers_blanks_and_further_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Case:Concept:Name,ACTIVITY,cost\n1,A,5\n,B,\n1, ,9\n1,C,7\n")
    got = logs.read_csv_log(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.activity, r.case_id == "1", r.attributes) for r in got) == [("A", True, {"cost": "5"}), ("B", False, {}), ("C", True, {"cost": "7"})]
    (tmp_path / "b.csv").write_text("activity,timestamp\nA,2020-01-01\n")
    with pytest.raises(ValueError, match="no case column"):
        logs.read_csv_log(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("case,timestamp\nA,2020-01-01\n")
    with pytest.raises(ValueError, match="no activity column"):
        logs.read_csv_log(spark, str(tmp_path / "c.csv"))


def test_json(spark, log, tmp_path):
    logs.write_json_log(log, str(tmp_path / "j"))
    assert rows(logs.read_json_log(spark, str(tmp_path / "j"))) == rows(log)
    (tmp_path / "a.json").write_text('{"traces":[{"case_id":"c","events":[{"name":"A","lifecycle":"start","attributes":{"x":"1"}}]}]}')
    assert logs.read_json_log(spark, str(tmp_path / "a.json")).first().attributes == {"x": "1", "lifecycle:transition": "start"}


def test_pairs(spark, log, tmp_path):
    logs.write_pairs(follows.dfg(log), str(tmp_path / "p"))
    assert sorted(map(tuple, logs.read_pairs(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, follows.dfg(log).collect()))


def test_object_log(spark, tmp_path):
    doc = {
        "events": [{"id": "e1", "activity": "Create", "timestamp": "2020-01-01T10:00:00Z", "cost": 5, "attributes": {"who": "x"}}, {"id": "e2", "activity": "Pay", "timestamp": "2020-01-01T11:00:00Z"}],
        "objects": [{"id": "o1", "type": "order", "total": "9"}, {"id": "o2", "type": "order"}], "relations": [{"event_id": "e1", "object_id": "o1", "qualifier": "q"}, {"event_id": "e2", "object_id": "o1"}],
        "o2o": [{"source": "o1", "target": "o2", "qualifier": "part"}], "globals": {},
    }
    (tmp_path / "a.json").write_text(json.dumps(doc))
    log = objects.read_json(spark, str(tmp_path / "a.json"))
    objects.write_json(log, str(tmp_path / "w"), rows=1)
    (tmp_path / "long.json").write_text(json.dumps(doc, indent=2))
    for read in (log, objects.read_json(spark, str(tmp_path / "long.json"), multi_line=True), objects.read_json(spark, str(tmp_path / "w"))):
        assert sorted((r.event_id, r.activity, r.ts_ms, r.attributes) for r in read.events.collect()) == [("e1", "Create", 1577872800000, {"cost": "5", "who": "x"}), ("e2", "Pay", 1577876400000, {})]
        assert sorted((r.object_id, r.type, r.attributes) for r in read.objects.collect()) == [("o1", "order", {"total": "9"}), ("o2", "order", {})]
        assert sorted(map(str, (tuple(r) for r in read.relations.collect()))) == sorted(map(str, [("e1", "o1", "q"), ("e2", "o1", None)]))
        assert [tuple(r) for r in read.object_links.collect()] == [("o1", "o2", "part")] and read.event_links.count() == 0
        one = objects.summary(read).first()
        assert (one.events, one.objects, one.relations, one.event_type_names, one.object_type_names, one.is_ocel20) == (2, 2, 2, "Create,Pay", "order", True)
    assert sorted(map(tuple, objects.flattened_cases(log, "order").collect())) == [("o1", 2), ("o2", 0)]
