"""The samples table of the checks, derived from the events table.

The 30 days of events become one load test of 2592 s.  It is told twice, as Spark SQL and
as DuckDB SQL; both give the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadgauge.session import shared_folder, side_by_side

# {S} string type, {D} integer division, {US} epoch microseconds, {K} the k of props.
BASE = """
SELECT event_id,
       CASE WHEN event_id % 5 < 2 THEN 'run-a' WHEN event_id % 5 < 4 THEN 'run-b'
            ELSE 'run-c' END AS run_id,
       t0 + offs AS timestamp_ms, elapsed,
       'Transaction ' || CAST(user_id % 5 + 1 AS {S}) AS label,
       CASE WHEN event_type <> 'error' THEN '200' WHEN k < 50 THEN '500'
            WHEN k < 75 THEN '503' ELSE '404' END AS response_code,
       CASE WHEN event_type = 'error' THEN 'Error' ELSE 'OK' END AS response_message,
       'Thread Group 1-' || CAST(user_id % 10 + 1 AS {S}) AS thread_name,
       event_type <> 'error' AS success,
       CASE WHEN event_type = 'error' THEN 'Connection refused' ELSE '' END AS failure_message,
       CAST(1024 + k * 41 AS BIGINT) AS bytes,
       CAST(256 + event_id % 512 AS BIGINT) AS sent_bytes,
       CAST(1 + user_id % 50 AS BIGINT) AS grp_threads,
       CAST(1 + least(99, offs {D} 26000) AS BIGINT) AS all_threads,
       'http://example.com/api/endpoint' || CAST(user_id % 5 AS {S}) AS url,
       (elapsed * 8) {D} 10 AS latency, event_id % 7 AS idle_time, 10 + event_id % 50 AS connect
FROM (SELECT *, CAST(1704067200000 AS BIGINT) AS t0,
             ({US} - 1704067200000000) {D} 1000000 AS offs,
             CAST(round(value * 10) AS BIGINT) AS elapsed, {K} AS k
      FROM {events}) e
"""

# Every 40th bucket of 10 s, and the first 30 s, are slow and fail.
STRESSED = """
SELECT event_id, run_id, timestamp_ms,
       CASE WHEN hot THEN elapsed * 4 ELSE elapsed END AS elapsed, label,
       CASE WHEN hot THEN '500' ELSE response_code END AS response_code,
       response_message, thread_name,
       CASE WHEN hot THEN FALSE WHEN event_id % 97 = 0 THEN NULL ELSE success END AS success,
       failure_message, bytes, sent_bytes, grp_threads, all_threads, url, latency, idle_time,
       connect
FROM (SELECT *, (timestamp_ms {D} 10000) % 40 = 1
             OR timestamp_ms < 1704067230000 AS hot FROM {base}) b
"""

# Text fields as a result file may hold them, some of them bad.
RAW = """
SELECT event_id, run_id,
       CASE event_id % 11
            WHEN 0 THEN CAST(timestamp_ms {D} 1000 AS {S})
            WHEN 1 THEN {day_space} WHEN 2 THEN {day_t} WHEN 3 THEN {day_t} || 'Z'
            WHEN 4 THEN {day_slash} WHEN 5 THEN 'not-a-timestamp' WHEN 6 THEN NULL
            WHEN 7 THEN CAST(timestamp_ms AS {S}) || '.0'
            WHEN 8 THEN '  ' || CAST(timestamp_ms AS {S}) || ' '
            ELSE CAST(timestamp_ms AS {S}) END AS timestamp_ms,
       CASE event_id % 13 WHEN 0 THEN '-5' WHEN 1 THEN NULL WHEN 2 THEN '100.5'
            WHEN 3 THEN 'abc' ELSE CAST(elapsed AS {S}) END AS elapsed,
       label, response_code, response_message, thread_name,
       CASE event_id % 7 WHEN 0 THEN 'maybe' WHEN 1 THEN CASE WHEN success THEN '1' ELSE '0' END
            WHEN 2 THEN CASE WHEN success THEN ' yes' ELSE 'no ' END
            WHEN 3 THEN CASE WHEN success THEN 'TRUE' ELSE 'False' END
            ELSE CASE WHEN success THEN 'true' ELSE 'false' END END AS success,
       failure_message, CAST(bytes AS {S}) AS bytes, CAST(sent_bytes AS {S}) AS sent_bytes,
       CAST(grp_threads AS {S}) AS grp_threads, CAST(all_threads AS {S}) AS all_threads, url,
       CAST(latency AS {S}) AS latency, CAST(idle_time AS {S}) AS idle_time,
       CAST(connect AS {S}) AS connect
FROM {base} b
"""


def _spark_day(pattern: str) -> str:
    return f"date_format(timestamp_millis(timestamp_ms), \"{pattern}\")"


def _duckdb_day(pattern: str) -> str:
    return f"strftime(make_timestamp(timestamp_ms * 1000), '{pattern}')"


SPARK = {
    "S": "STRING",
    "D": "div",
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
    "K": "CAST(get_json_object(props, '$.k') AS INT)",
    "day_space": _spark_day("yyyy-MM-dd HH:mm:ss"),
    "day_t": _spark_day("yyyy-MM-dd'T'HH:mm:ss"),
    "day_slash": _spark_day("yyyy/MM/dd HH:mm:ss"),
}
DUCKDB = {
    "S": "VARCHAR",
    "D": "//",
    "US": "epoch_us(ts)",
    "K": "CAST(json_extract_string(props, '$.k') AS INT)",
    "day_space": _duckdb_day("%Y-%m-%d %H:%M:%S"),
    "day_t": _duckdb_day("%Y-%m-%dT%H:%M:%S"),
    "day_slash": _duckdb_day("%Y/%m/%d %H:%M:%S"),
}


def _sql(kind: str, dialect: dict[str, str], events: str) -> str:
    base = BASE.format(**dialect, events=events, base="")
    if kind == "base":
        return base
    text = STRESSED if kind == "stressed" else RAW
    return text.format(**dialect, events=events, base=f"({base})")


def duckdb_samples(kind: str = "base") -> str:
    return _sql(kind, DUCKDB, "events")


def samples(spark: SparkSession, sf_dir: str, kind: str = "base") -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = f"parquet.`{sf_dir}/events.parquet`"
    return spark.sql(_sql(kind, SPARK, events))


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# The header names of result files.
CSV_NAMES = {
    "timestamp_ms": "timeStamp",
    "elapsed": "elapsed",
    "label": "label",
    "response_code": "responseCode",
    "response_message": "responseMessage",
    "thread_name": "threadName",
    "success": "success",
    "failure_message": "failureMessage",
    "bytes": "bytes",
    "sent_bytes": "sentBytes",
    "grp_threads": "grpThreads",
    "all_threads": "allThreads",
    "url": "URL",
    "latency": "Latency",
    "idle_time": "IdleTime",
    "connect": "Connect",
}


# run -> (order of the columns after dataType, delimiter)
CSV_LAYOUTS = {
    "run-a": (list(CSV_NAMES), ","),
    "run-b": (list(CSV_NAMES)[::-1], ";"),
    "run-c": (list(CSV_NAMES)[3:] + list(CSV_NAMES)[:3], "\t"),
}


def write_csv_files(raw: DataFrame) -> str:
    """CSV files of the raw rows: one folder per run, the runs with headers of their own."""
    folder = fresh_folder(raw.sparkSession, "csv")

    def write(run: str) -> None:
        columns, delimiter = CSV_LAYOUTS[run]
        rows = raw.filter(F.col("run_id") == run)
        (
            rows.select(F.lit("text").alias("dataType"), *[F.col(c).alias(CSV_NAMES[c]) for c in columns])
            .write.option("header", True)
            .option("sep", delimiter)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .option("emptyValue", "")
            .csv(f"{folder}/{run}")
        )

    side_by_side(raw.sparkSession, write, CSV_LAYOUTS)
    return folder


VARIANTS = 30


def write_varied_csv(raw: DataFrame) -> str:
    """CSV files of the raw rows, a folder per variant: columns turned round by another number, other delimiters."""
    folder, names = fresh_folder(raw.sparkSession, "varied"), list(CSV_NAMES)
    variant = F.col("event_id") % VARIANTS
    line = header = None
    for v in range(VARIANTS):
        turned = names[v % len(names) :] + names[: v % len(names)]
        mark = ",;\t"[v % 3]
        title = F.lit(mark.join(["dataType", *[CSV_NAMES[c] for c in turned], f"extra{v}"]))
        cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in turned]
        row = F.concat_ws(mark, F.lit("text"), *cells, F.lit("more"))
        is_it = F.col("variant") == v
        line = F.when(is_it, row) if line is None else line.when(is_it, row)
        header = F.when(is_it, title) if header is None else header.when(is_it, title)
    rows = raw.withColumn("variant", variant).select("variant", F.col("event_id").alias("at"), line.alias("value"))
    heads = rows.select("variant").distinct().select("variant", F.lit(-1).cast("long").alias("at"), header.alias("value"))
    whole = rows.unionByName(heads).repartition("variant").sortWithinPartitions("variant", "at")
    whole.select("variant", "value").write.partitionBy("variant").text(folder)
    return folder


def run_of_folder(path):
    return F.element_at(F.split(path, "/"), -2)


def write_xml_files(raw: DataFrame) -> str:
    """XML files of the raw rows: each httpSample of an even event holds the next as sample."""
    from loadgauge.model import XML_ATTRIBUTES

    folder = fresh_folder(raw.sparkSession, "xml")

    def element(rows: DataFrame, name: str) -> DataFrame:
        fields = [F.col(c).alias(f"_{a}") for a, c in XML_ATTRIBUTES.items()]
        fields += [
            F.col("failure_message").alias("failureMessage"),
            F.col("url").alias("java.net.URL"),
        ]
        pair = (F.col("event_id") - F.col("event_id") % 2).alias("pair")
        return rows.select("run_id", pair, F.struct(*fields).alias(name))

    even = element(raw.filter("event_id % 2 = 0"), "outer")
    odd = element(raw.filter("event_id % 2 = 1"), "inner").drop("run_id")
    nested = even.join(odd, "pair", "full").select(
        "outer.*", F.when(F.col("inner").isNotNull(), F.array("inner")).alias("sample")
    )
    (
        nested.write.format("xml")
        .option("rowTag", "httpSample")
        .option("rootTag", "testResults")
        .option("attributePrefix", "_")
        .save(f"{folder}/run-x")
    )
    return folder


def _xml_elements(raw: DataFrame, failure: Column | None = None) -> DataFrame:
    """run_id, event_id and each row's begin tag, child texts and end tag; both tags in turn.

    ``failure`` is the XML of the failure's text, by default the escaped text.
    """
    from loadgauge.model import XML_ATTRIBUTES

    def escaped(name: str) -> Column:
        text = F.col(name)
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(char), F.lit(entity))
        return text

    tag = F.when(F.col("event_id") % 2 == 0, "httpSample").otherwise("sample")
    attributes = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {a}="'), escaped(c), F.lit('"'))).otherwise("") for a, c in XML_ATTRIBUTES.items()
    ]
    texts = [
        F.when(text.isNotNull(), F.concat(F.lit(f"<{t}>"), text, F.lit(f"</{t}>"))).otherwise("")
        for text, t in ((escaped("failure_message") if failure is None else failure, "failureMessage"), (escaped("url"), "java.net.URL"))
    ]
    return raw.select(
        "run_id", "event_id", F.concat(F.lit("<"), tag, *attributes, F.lit(">")).alias("begin"), F.concat(*texts).alias("texts"),
        F.concat(F.lit("</"), tag, F.lit(">")).alias("end"),
    )


def write_deep_xml(raw: DataFrame) -> str:
    """XML of the raw rows, ten deep, both tags in turn, child texts behind the nested samples."""
    parts = _xml_elements(raw).select(
        "run_id", F.expr("event_id div 10").alias("nest"), "event_id", "begin", F.concat("texts", "end").alias("end")
    )
    nests = parts.groupBy("run_id", "nest").agg(F.sort_array(F.collect_list(F.struct("event_id", "begin", "end"))).alias("x"))
    folder = fresh_folder(raw.sparkSession, "deep-xml")
    nests.select(F.concat(F.array_join("x.begin", ""), F.array_join(F.reverse("x.end"), ""))).write.text(f"{folder}/run-x")
    return f"{folder}/run-x"


def write_cdata_xml(raw: DataFrame) -> str:
    """XML of the raw rows; every fifth failure's text is markup in CDATA, behind plain text."""
    event = F.col("event_id").cast("string")
    cdata = F.concat(F.lit("at "), event, F.lit('&gt; <![CDATA[<sample t="1" lb="ghost"/> <!-- ]] &lt; ]]><![CDATA[</failureMessage>]]>'))
    plain = F.replace(F.replace("failure_message", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = _xml_elements(raw, F.when(F.col("event_id") % 5 == 0, cdata).otherwise(plain))
    folder = fresh_folder(raw.sparkSession, "cdata-xml")
    parts.select(F.concat("begin", "texts", "end")).write.text(f"{folder}/run-x")
    return f"{folder}/run-x"


def write_commented_xml(raw: DataFrame) -> str:
    """XML of the raw rows; those of every eleventh event are commented out, others hold comments."""
    parts = _xml_elements(raw)
    whole = F.concat("begin", F.lit('<!-- <sample t="1" lb="ghost"/> <![CDATA[ -->'), "texts", F.lit("<?note <sample/> ?>"), "end")
    hidden = F.concat(F.lit("<!-- old: "), "begin", "texts", F.lit("<![CDATA[ ]]>"), "end", F.lit(" -->"))
    folder = fresh_folder(raw.sparkSession, "commented-xml")
    parts.select(F.when(F.col("event_id") % 11 == 0, hidden).otherwise(whole)).write.text(f"{folder}/run-x")
    return f"{folder}/run-x"
