"""Event logs as DataFrames.

A log has one row per event: case_id string, event_idx long (place in its case, from 0), activity string,
ts_ms long (epoch milliseconds, UTC; null if unknown), attributes map<string,string>. Sources without an
order of their own get event_idx from time and a tie-breaker, in one shuffle by case that later windows
over the case reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Accepted CSV headers in lower case (fixed values of the exchange format).
CASE_HEADERS = ("case_id", "case:concept:name", "case")
ACTIVITY_HEADERS = ("concept:name", "activity")
TIME_HEADERS = ("time:timestamp", "timestamp")


def millis(ts: Column) -> Column:
    """Floor of epoch milliseconds of a timestamp column."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1000)).cast("long")


def parsed_millis(text: Column) -> Column:
    """Epoch milliseconds of an ISO timestamp string; null where it is none."""
    return millis(F.try_to_timestamp(text))


def as_log(rows: DataFrame, case: Column, activity: Column, ts: Column, order: list[Column], attributes: Column | None = None) -> DataFrame:
    """The log of ``rows``; ``order`` must be total within a case. Rows without case or activity are left out."""
    attributes = attributes if attributes is not None else F.create_map().cast("map<string,string>")
    named = rows.where(case.isNotNull() & activity.isNotNull())
    place = F.row_number().over(Window.partitionBy(case.cast("string")).orderBy(*order)) - 1
    return named.select(case.cast("string").alias("case_id"), place.cast("long").alias("event_idx"), activity.alias("activity"), millis(ts).alias("ts_ms"), attributes.alias("attributes"))


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows, F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("props"), F.col("props"))


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per user of the events table."""
    rows, attributes = _events(spark, sf_dir)
    return as_log(rows, F.col("user_id"), F.col("event_type"), F.col("ts"), [F.col("ts"), F.col("event_id")], attributes)


def day_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per user and day of the events table."""
    rows, attributes = _events(spark, sf_dir)
    return as_log(rows, F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")), F.col("event_type"), F.col("ts"), [F.col("ts"), F.col("event_id")], attributes)


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per conversation, its roles as activities; no timestamps."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return as_log(rows, F.col("conv_id"), F.col("role"), F.lit(None).cast("timestamp"), [F.col("turn"), F.col("text")])


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per customer, order priorities as activities."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return as_log(rows, F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")])


def traces(log: DataFrame) -> DataFrame:
    """(case_id, acts array<string> in order, n): one shuffle by case. A case's activities meet in one row, so the longest
    case has to fit a task; operators that need no whole sequence use windows instead."""
    acts = F.transform(F.array_sort(F.collect_list(F.struct("event_idx", "activity"))), lambda e: e["activity"])
    return log.groupBy("case_id").agg(acts.alias("acts"), F.count("*").alias("n"))


def variants(log: DataFrame) -> DataFrame:
    """(acts, count): distinct traces; operators that look at order alone work on these."""
    return traces(log).groupBy("acts").agg(F.count("*").alias("count"))


def read_csv_log(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, columns found by name whatever their case; an error without one of the case or the activity.

    Rows with a blank activity go; a blank case id makes a case of its own; order is that of the rows. Further columns
    are attributes.
    """
    rows = spark.read.option("header", True).csv(path)
    found = {c.strip().lower(): c for c in rows.columns}
    named = {part: next((found[n] for n in names if n in found), None) for part, names in (("case", CASE_HEADERS), ("activity", ACTIVITY_HEADERS), ("ts", TIME_HEADERS))}
    for part, names in (("case", CASE_HEADERS), ("activity", ACTIVITY_HEADERS)):
        if named[part] is None:
            raise ValueError(f"no {part} column in {path}: one of {', '.join(names)}")
    column = lambda name: F.col("`" + name.replace("`", "``") + "`")
    value = lambda part: F.nullif(F.trim(column(named[part])), F.lit("")) if named[part] else F.lit(None).cast("string")
    rest = [c for c in rows.columns if c not in named.values()]
    others = F.map_filter(F.create_map(*(x for c in rest for x in (F.lit(c.strip()), column(c)))), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    rows = rows.select(value("case").alias("case"), value("activity").alias("activity"), value("ts").alias("ts"), others.alias("others"), F.monotonically_increasing_id().alias("line")).where("activity is not null")
    return as_log(rows, F.coalesce("case", F.concat(F.lit("case_"), F.col("line"))), F.col("activity"), F.try_to_timestamp("ts"), [F.col("line")], F.col("others"))


_XES_VALUES = "array<struct<_key:string,_value:string>>"
_XES_KINDS = ("string", "date", "int", "float", "boolean")
_XES_EVENT = ",".join(f"`{kind}`:{_XES_VALUES}" for kind in _XES_KINDS)
_XES_TRACE = f"`string` {_XES_VALUES}, event array<struct<{_XES_EVENT}>>"


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """XES files, traces split by the XML source; attributes are strings, and nested ones are not read.

    Of a key that an event repeats the last value counts, strings before dates, numbers and truth values.
    """
    rows = spark.read.format("xml").option("rowTag", "trace").schema(_XES_TRACE).load(path).withColumn("trace", F.monotonically_increasing_id())
    name = F.get(F.filter("string", lambda a: a["_key"] == "concept:name"), F.lit(0))["_value"]
    rows = rows.select(F.coalesce(name, F.concat(F.lit("case_"), F.col("trace"))).alias("case"), "trace", F.posexplode("event").alias("place", "event"))
    empty = F.array().cast(_XES_VALUES)
    values = F.filter(F.concat(*(F.coalesce(F.col(f"event.{kind}"), empty) for kind in _XES_KINDS)), lambda a: a["_key"].isNotNull())
    rows = rows.select("case", "trace", "place", values.alias("values"))
    keys = F.transform("values", lambda a: a["_key"])
    last = F.filter("values", lambda a, i: ~F.array_contains(F.slice(keys, i + 2, F.size("values")), a["_key"]))
    rows = rows.select("case", "trace", "place", F.map_from_entries(F.transform(last, lambda a: F.struct(a["_key"], a["_value"]))).alias("all"))
    named = F.map_filter("all", lambda k, _: ~k.isin("concept:name", "time:timestamp"))
    return as_log(rows.withColumn("named", named), F.col("case"), F.col("all")["concept:name"], F.try_to_timestamp(F.col("all")["time:timestamp"]), [F.col("trace"), F.col("place")], F.col("named"))


def _stamp() -> Column:
    return F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def write_xes(log: DataFrame, path: str) -> None:
    """A folder of XES files, each a whole document; every attribute is written as a string, times as dates.

    A case is gathered in one task, as it is one element of a file. :func:`read_xes` reads the folder back.
    """
    pair = lambda key, value: F.struct(key.alias("_key"), value.alias("_value"))
    rest = F.transform(F.array_sort(F.map_entries(F.map_filter("attributes", lambda _, v: v.isNotNull()))), lambda e: pair(e["key"], e["value"]))
    event = F.struct(F.concat(F.array(pair(F.lit("concept:name"), F.col("activity"))), rest).alias("string"), F.when(F.col("ts_ms").isNotNull(), F.array(pair(F.lit("time:timestamp"), _stamp()))).alias("date"))
    rows = log.select("case_id", "event_idx", event.alias("event")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("event_idx", "event"))).alias("events"))
    rows = rows.select(F.array(pair(F.lit("concept:name"), F.col("case_id"))).alias("string"), F.transform("events", lambda e: e["event"]).alias("event"))
    rows.write.format("xml").option("rootTag", 'log xes.version="1.0"').option("rowTag", "trace").option("declaration", 'version="1.0" encoding="UTF-8"').save(path)


def write_csv_log(log: DataFrame, path: str) -> None:
    """Columns case_id, activity, timestamp, in order of case and place."""
    log.orderBy("case_id", "event_idx").select("case_id", "activity", _stamp().alias("timestamp")).write.option("header", True).csv(path)


_JSON_LOG = "traces array<struct<case_id:string,events:array<struct<name:string,timestamp:string,lifecycle:string,attributes:map<string,string>>>>>"


def read_json_log(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines, each with ``traces`` of a case_id and events (name, timestamp, lifecycle, attributes). A document is read by one
    task, so a large log is many documents; the parts of a case that several hold follow one another. With ``multi_line`` a
    file is one document."""
    rows = spark.read.schema(_JSON_LOG).option("multiLine", multi_line).json(path).withColumn("doc", F.monotonically_increasing_id())
    rows = rows.select("doc", F.posexplode("traces").alias("nth", "trace")).select("doc", "nth", "trace.case_id", F.posexplode("trace.events").alias("place", "event"))
    own = F.coalesce(F.col("event.attributes"), F.create_map().cast("map<string,string>"))
    lifecycle = F.when(F.col("event.lifecycle").isNotNull() & ~F.coalesce(F.map_contains_key(own, "lifecycle:transition"), F.lit(False)), F.map_concat(own, F.create_map(F.lit("lifecycle:transition"), F.col("event.lifecycle")))).otherwise(own)
    return as_log(rows, F.col("case_id"), F.col("event.name"), F.try_to_timestamp(F.col("event.timestamp")), [F.col("doc"), F.col("nth"), F.col("place")], lifecycle)


def write_json_log(log: DataFrame, path: str) -> None:
    """JSON lines as :func:`read_json_log` reads them, one case each."""
    event = F.struct(F.col("activity").alias("name"), _stamp().alias("timestamp"), "attributes")
    in_order = lambda a, b: F.signum(a["event_idx"] - b["event_idx"]).cast("int")  # noqa: E731  maps have no order of their own
    rows = log.select("case_id", "event_idx", event.alias("event")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("event_idx", "event")), in_order).alias("events"))
    rows.select(F.array(F.struct("case_id", F.transform("events", lambda e: e["event"]).alias("events"))).alias("traces")).write.json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The rows of a directly-follows graph (source, target, n and any measures) as JSON lines."""
    pairs.write.json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, n) as :func:`write_pairs` wrote them."""
    return spark.read.schema("source string, target string, n long").json(path)
