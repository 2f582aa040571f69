"""Object-centric logs: tables of events (event_id, activity, ts_ms), objects (object_id, type) and relations (event_id, object_id)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracelake.sources.logs import millis, parsed_millis


class ObjectLog(NamedTuple):
    """``events`` and ``objects`` may have ``attributes`` map<string,string>, ``relations`` a ``qualifier``; links between objects
    (source, target, qualifier) and between events are tables of their own, None where there are none."""

    events: DataFrame
    objects: DataFrame
    relations: DataFrame
    object_links: DataFrame | None = None
    event_links: DataFrame | None = None


_OWN = {"event": ("id", "activity", "timestamp"), "object": ("id", "type")}
_LINK = "source:string,target:string,qualifier:string"


def _attributes(row: Column, own: tuple[str, ...]) -> Column:
    """A JSON object's keys but for ``own``, and those of its ``attributes``, as strings."""
    every = F.from_json(row, "map<string,string>")
    nested = F.coalesce(F.from_json(every["attributes"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(every, lambda k, _: ~k.isin(*own, "attributes") & ~F.map_contains_key(nested, k)), nested)


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> ObjectLog:
    """JSON lines, each a document with ``events``, ``objects``, ``relations``, and ``o2o`` and ``e2e`` links where there are any.

    A line is read by one task, so a large log is written as many lines, see :func:`write_json`. Keys of events and objects
    beyond their own are attributes. With ``multi_line`` each file is one document, over as many lines as it likes, read by one task.
    """
    schema = f"events array<string>, objects array<string>, relations array<struct<event_id:string,object_id:string,qualifier:string>>, o2o array<struct<{_LINK}>>, e2e array<struct<{_LINK}>>"
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    value = lambda key: F.get_json_object("row", f"$.{key}")
    events = doc.select(F.explode("events").alias("row")).select(value("id").alias("event_id"), value("activity").alias("activity"), parsed_millis(value("timestamp")).alias("ts_ms"), _attributes(F.col("row"), _OWN["event"]).alias("attributes"))
    objects = doc.select(F.explode("objects").alias("row")).select(value("id").alias("object_id"), value("type").alias("type"), _attributes(F.col("row"), _OWN["object"]).alias("attributes"))
    return ObjectLog(events, objects, doc.select(F.inline("relations")), doc.select(F.inline("o2o")), doc.select(F.inline("e2e")))


def write_json(log: ObjectLog, path: str, rows: int = 10_000) -> None:
    """JSON lines as :func:`read_json` reads them: a document holds some ``rows`` rows of one of the tables, so no task gathers more."""
    none = F.create_map().cast("map<string,string>")
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    own = lambda df: F.col("attributes") if "attributes" in df.columns else none
    parts = {
        "events": log.events.select(F.struct(F.col("event_id").alias("id"), "activity", stamp.alias("timestamp"), own(log.events).alias("attributes")).alias("row")),
        "objects": log.objects.select(F.struct(F.col("object_id").alias("id"), "type", own(log.objects).alias("attributes")).alias("row")),
        "relations": log.relations.select(F.struct("event_id", "object_id", *(["qualifier"] if "qualifier" in log.relations.columns else [])).alias("row")),
        "o2o": log.object_links and log.object_links.select(F.struct("source", "target", "qualifier").alias("row")),
        "e2e": log.event_links and log.event_links.select(F.struct("source", "target", "qualifier").alias("row")),
    }
    for key, part in parts.items():
        if part is not None:
            at = F.monotonically_increasing_id()
            documents = part.withColumn("chunk", F.floor(at / rows)).groupBy("chunk").agg(F.collect_list("row").alias(key))
            documents.select(key).write.mode("append").json(path)


def sales(spark: SparkSession, sf_dir: str) -> ObjectLog:
    """Orders placed and lines shipped or returned, with their orders, customers, parts and suppliers.

    Lines that share an order and number are events of their own, numbered in order of what they hold.
    """
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    again = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate").withColumn("again", again)
    line = F.concat(F.lit("l:"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"), F.when(F.col("again") > 1, F.concat(F.lit("-"), F.col("again"))).otherwise(""))
    placed = orders.select(key("o:", "o_orderkey").alias("event_id"), F.lit("Place").alias("activity"), millis(F.col("o_orderdate")).alias("ts_ms"))
    moved = lines.select(line.alias("event_id"), F.when(F.col("l_returnflag") == "R", "Return").otherwise("Ship").alias("activity"), millis(F.col("l_shipdate")).alias("ts_ms"))
    kind = lambda rows, name, mark, c: rows.select(key(mark, c).alias("object_id"), F.lit(name).alias("type")).distinct()
    objects = kind(orders, "order", "o:", "o_orderkey").unionByName(kind(orders, "customer", "c:", "o_custkey")).unionByName(kind(lines, "part", "p:", "l_partkey")).unionByName(kind(lines, "supplier", "s:", "l_suppkey"))
    of_order = orders.select(key("o:", "o_orderkey").alias("event_id"), F.explode(F.array(key("o:", "o_orderkey"), key("c:", "o_custkey"))).alias("object_id"))
    of_line = lines.select(line.alias("event_id"), F.explode(F.array(key("o:", "l_orderkey"), key("p:", "l_partkey"), key("s:", "l_suppkey"))).alias("object_id"))
    return ObjectLog(placed.unionByName(moved), objects, of_order.unionByName(of_line))


def flatten(log: ObjectLog, kind: str) -> DataFrame:
    """(case_id, event_idx, activity, ts_ms): a case per object of the type, its distinct events in order of time, then id.

    A log has rows for events alone; :func:`flattened_cases` lists the objects without any too.
    """
    of_kind = log.relations.join(log.objects.where(F.col("type") == kind).select("object_id"), "object_id", "left_semi")
    rows = of_kind.select("object_id", "event_id").distinct().join(log.events.select("event_id", "activity", "ts_ms"), "event_id")
    place = F.row_number().over(Window.partitionBy("object_id").orderBy(F.asc_nulls_last("ts_ms"), "event_id")) - 1
    return rows.select(F.col("object_id").alias("case_id"), place.cast("long").alias("event_idx"), "activity", "ts_ms")


def flattened_cases(log: ObjectLog, kind: str) -> DataFrame:
    """(case_id, events): every object of the type and the number of its events, 0 included."""
    objects = log.objects.where(F.col("type") == kind).select(F.col("object_id").alias("case_id")).distinct()
    counted = flatten(log, kind).groupBy("case_id").agg(F.count("*").alias("events"))
    return objects.join(counted, "case_id", "left").fillna(0, ["events"])


def etot(log: ObjectLog) -> DataFrame:
    """(activity, type, n): relations whose event and object are both there."""
    rows = log.relations.join(log.events.select("event_id", "activity"), "event_id").join(log.objects, "object_id")
    return rows.groupBy("activity", "type").agg(F.count("*").alias("n"))


def types_of_activity(log: ObjectLog, activity: str) -> DataFrame:
    return etot(log).where(F.col("activity") == activity).select("type")


def activities_of_type(log: ObjectLog, kind: str) -> DataFrame:
    return etot(log).where(F.col("type") == kind).select("activity")


def object_types(log: ObjectLog) -> DataFrame:
    return log.objects.groupBy("type").agg(F.count("*").alias("n"))


def event_types(log: ObjectLog) -> DataFrame:
    return log.events.groupBy("activity").agg(F.count("*").alias("n"))


def summary(log: ObjectLog) -> DataFrame:
    """One row: events, objects, relations, the names of event and object types in order, and whether objects or events are linked among themselves."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    e = log.events.agg(F.count("*").alias("events"), F.count_distinct("activity").alias("event_types"), names("activity").alias("event_type_names"))
    o = log.objects.agg(F.count("*").alias("objects"), F.count_distinct("type").alias("object_types"), names("type").alias("object_type_names"))
    links = [x.select(F.lit(1).alias("x")).limit(1) for x in (log.object_links, log.event_links) if x is not None]
    linked = links[0].unionByName(links[-1]).agg(F.count("*") > 0).scalar() if links else F.lit(False)
    return e.join(F.broadcast(o)).join(F.broadcast(log.relations.agg(F.count("*").alias("relations")))).withColumn("is_ocel20", linked)


def objects_of_event(log: ObjectLog, event_id: str) -> DataFrame:
    return log.objects.join(log.relations.where(F.col("event_id") == event_id), "object_id", "left_semi")


def events_of_object(log: ObjectLog, object_id: str) -> DataFrame:
    return log.events.join(log.relations.where(F.col("object_id") == object_id), "event_id", "left_semi")
