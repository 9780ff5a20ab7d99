import json
import math
import os
from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loadgauge.functions.parsing import normalize_bool, normalize_int, normalize_timestamp, quoted
from loadgauge.functions.parsing import timestamp_format
from loadgauge.model import SAMPLES_SCHEMA
from loadgauge.sources import ingest, tables
from loadgauge.sources.cleaning import clean
from loadgauge.sources.csv_files import column_positions, map_columns, read_jtl_csv
from loadgauge.sources.detect import classify_inputs, csv_delimiter, file_format, file_uri
from loadgauge.sources.xml_files import read_jtl_xml
from loadgauge.streaming import live

MS = 1_700_000_000_000
HEADER_2 = "timeStamp,elapsed,label,responseCode,responseMessage,threadName,dataType,success,bytes"


def apply(spark, expression, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r["out"] for r in frame.select("i", expression.alias("out")).orderBy("i").collect()]


# ---- values ------------------------------------------------------------------------------


def test_timestamps(spark):
    good = [
        str(MS), "1700000000", "1700000000000.0", "2023-11-14 22:13:20", "2023-11-14T22:13:20",
        "2023-11-14T22:13:20Z", "2023/11/14 22:13:20", f"  {MS}\t", "1.7e12", "1700000000.9",
    ]
    assert apply(spark, normalize_timestamp("v"), good[:-2]) == [MS] * 8
    assert apply(spark, normalize_timestamp("v"), good[-2:]) == [MS, MS]
    bad = ["not-a-timestamp", None, "", "nan", "inf", "12d", "1e400", "2023-13-14 22:13:20",
           "2023-11-14 22:13:20.5", "2023-11-14"]
    assert apply(spark, normalize_timestamp("v"), bad) == [None] * len(bad)


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert apply(spark, normalize_timestamp("v"), ["2023-11-14 22:13:20"]) == [MS]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_timestamp_formats(spark):
    values = [str(MS), "1700000000", "0", "2023-11-14T22:13:20Z", "x", None]
    want = ["epoch_ms", "epoch_s", "epoch_s", "datetime", None, None]
    assert apply(spark, timestamp_format("v"), values) == want


def timestamp_by_hand(text):
    try:
        number = int(float(text.strip()))
    except (ValueError, OverflowError):
        for form in ("%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S"):
            try:
                found = datetime.strptime(text.strip(), form).replace(tzinfo=UTC)
                return int(found.timestamp() * 1000)
            except ValueError:
                continue
        return None
    return number if number > 10**12 else number * 1000


numbers = st.one_of(
    st.integers(0, 10**15).map(str),
    st.floats(0, 1e15, allow_nan=False).map(str),
    st.datetimes(datetime(1971, 1, 1), datetime(2100, 1, 1)).map(
        lambda d: d.strftime("%Y-%m-%d %H:%M:%S")
    ),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(numbers, min_size=60, max_size=100))
def test_any_timestamp(spark, values):
    assert apply(spark, normalize_timestamp("v"), values) == [timestamp_by_hand(v) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=8), min_size=50))
def test_any_text_is_a_bool_or_null(spark, values):
    words = {w: True for w in ("true", "1", "yes")} | {w: False for w in ("false", "0", "no")}
    want = [words.get(v.strip(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0").lower()) for v in values]
    assert apply(spark, normalize_bool("v"), values) == want


def test_bools_and_ints(spark):
    values = ["true", "TRUE", "1", "yes", " Yes ", "false", "FALSE", "0", "no", "maybe", "", None]
    assert apply(spark, normalize_bool("v"), values) == [True] * 5 + [False] * 4 + [None] * 3
    assert apply(spark, normalize_int("v"), ["7", "-5", "100.5", "abc", "", None]) == [
        7, -5, None, None, None, None,
    ]


def test_quoted_like_a_literal(spark):
    values = ["x", "it's", 'a"b', "both ' and \"", "tab\t\\"]
    assert apply(spark, quoted("v"), values) == [repr(v) for v in values]


# ---- cleaning ----------------------------------------------------------------------------


def raw(spark, rows, columns="timestamp_ms string, elapsed string, success string"):
    return spark.createDataFrame(rows, columns)


def test_clean_keeps_or_explains_every_row(spark):
    rows = [
        (str(MS), "100", "maybe"),
        (str(MS), "-5", "true"),
        (str(MS), None, "true"),
        (str(MS), "100.5", "true"),
        ("not-a-timestamp", "1", "true"),
        (None, "abc", "true"),
    ]
    samples, quarantine = clean(raw(spark, rows))
    kept = samples.collect()
    assert len(kept) == 1 and kept[0]["success"] is None
    assert samples.columns == SAMPLES_SCHEMA.fieldNames()
    assert sorted(r["reason"] for r in quarantine.collect()) == [
        "elapsed is negative: -5",
        "elapsed is null",
        "elapsed is null",
        "elapsed is null; missing required field: timestamp_ms",
        "unparseable timestamp: 'not-a-timestamp'",
    ]
    texts = [json.loads(r["raw_json"]) for r in quarantine.collect()]
    assert {"timestamp_ms": None, "elapsed": "abc", "success": "true"} in texts
    assert len({r["row_index"] for r in quarantine.collect()}) == 5


def test_absent_column_gives_no_reason(spark):
    samples, quarantine = clean(raw(spark, [(str(MS), "home")], "timestamp_ms string, label string"))
    assert samples.first()["elapsed"] is None and quarantine.count() == 0
    samples, quarantine = clean(raw(spark, [("home",)], "label string"))
    assert samples.count() == 1 and quarantine.count() == 0


def test_validate_wording(spark):
    rows = [("1", "abc", "x"), ("1", "-1.5", "x"), (None, None, "x"), ("1", "1.5", "x")]
    found = {r["reason"] for r in clean(raw(spark, rows), "validate")[1].collect()}
    assert found == {
        "elapsed is not numeric: 'abc'",
        "elapsed is negative: -1.5",
        "missing required field: elapsed; missing required field: timestamp_ms",
    }
    absent = clean(raw(spark, [("home",)], "label string"), "validate")[1].first()["reason"]
    assert absent == "missing required field: elapsed; missing required field: timestamp_ms"


# ---- files -------------------------------------------------------------------------------


def test_file_formats():
    assert file_format(b"<?xml version='1.0'?>") == "xml"
    assert file_format(b"\n  <testResults version='1.2'>") == "xml"
    assert file_format(b"\xef\xbb\xbf<?xml?>") == "xml"
    assert file_format(b"\n\na,b\n") == "csv" and file_format(b"a;b") == "csv"
    assert file_format(b"hello") == "unknown" and file_format(b"") == "unknown"


@pytest.mark.parametrize("mark", [",", "\t", ";"])
def test_delimiters(mark):
    lines = [HEADER_2.replace(",", mark)] + [mark.join(["1", "2", "x", "200", "OK", "t", "", "true", "9"])] * 5
    assert csv_delimiter("\n".join(lines)) == mark


def test_one_column_counts_as_comma():
    assert csv_delimiter("abc\n") == ","


def test_first_source_column_wins():
    assert column_positions(["ts", "timeStamp", "Elapsed", "label", "Label", "junk"]) == {
        "label": 3, "timestamp_ms": 0, "elapsed": 2,
    }
    assert column_positions(["ts", "timestamp_ms"]) == {"timestamp_ms": 1}


def test_map_columns(spark):
    frame = spark.createDataFrame([("a", "1", "z", "9")], "LABEL string, ts string, dataType string, `URL` string")
    assert map_columns(frame).first().asDict() == {"timestamp_ms": "1", "label": "a", "url": "9"}


def write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_ragged_rows(spark, tmp_path):
    header = HEADER_2
    full = f"{MS},100,home,200,OK,t-1,text,true,10"
    path = write(tmp_path, "a.jtl", "\n".join([header, full, full + ",x,y,z", f"{MS},5", '1,2,"a ""b"", c"']) + "\n")
    rows = read_jtl_csv(spark, path, header).collect()
    assert len(rows) == 4 and all(len(r) == 9 for r in rows)
    assert [r["label"] for r in rows] == ["home", "home", None, 'a "b", c']
    assert [r["bytes"] for r in rows] == ["10", "10", None, None]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'ts,elapsed,label\n1,2,"two\nlines"\n')
    assert read_jtl_csv(spark, path, "ts,elapsed,label", multi_line=True).first()["label"] == "two\nlines"


NESTED = """<?xml version="1.0"?>
<testResults>
<httpSample t="1" lb="H1"><sample t="2" lb="S2"><httpSample t="3" lb="H3"><httpSample t="4" lb="H4"/></httpSample><sample t="5" lb="S5"/></sample><httpSample t="6" lb="H6"/></httpSample>
<sample t="7" lb="S7"><httpSample t="8" lb="H8"><sample t="9" lb="S9"/></httpSample></sample>
<httpSample t="10" lb="H10"/><sample t="11" lb="S11"><java.net.URL>http://x/?a=1&amp;b=2</java.net.URL></sample>
</testResults>
"""


def test_xml_elements_come_out_once(spark, tmp_path):
    path = write(tmp_path, "n.xml", NESTED)
    rows = read_jtl_xml(spark, path).collect()
    assert sorted(int(r["elapsed"]) for r in rows) == list(range(1, 12))
    assert all(r["label"][1:] == r["elapsed"] and r["unread_xml"] is None for r in rows)
    assert [r["url"] for r in rows if r["url"]] == ["http://x/?a=1&b=2"]


DEEP = (
    '<testResults><httpSample t="1" lb="H1"><httpSample t="2" lb="H2"><httpSample t="3" lb="H3"><httpSample t="4" lb="H4">'
    '<sample t="5" lb="S5"><httpSample t="6" lb="H6"/><httpSample t="7" lb="H7"></httpSample><failureMessage>late &lt;5&gt;'
    "</failureMessage></sample><assertionResult><failureMessage>not H4's</failureMessage></assertionResult></httpSample>"
    "</httpSample></httpSample><java.net.URL>http://a/?x=1&amp;y=2</java.net.URL></httpSample></testResults>"
)


def test_xml_at_any_depth(spark, tmp_path):
    rows = {r["label"]: r for r in read_jtl_xml(spark, write(tmp_path, "d.xml", DEEP)).collect()}
    assert {k: int(r["elapsed"]) for k, r in rows.items()} == {f"{'S' if i == 5 else 'H'}{i}": i for i in range(1, 8)}
    assert {k for k, r in rows.items() if r["failure_message"]} == {"S5"} and rows["S5"]["failure_message"] == "late <5>"
    assert {k: r["url"] for k, r in rows.items() if r["url"]} == {"H1": "http://a/?x=1&y=2"}
    assert all(r["unread_xml"] is None for r in rows.values())


def test_xml_file_is_split(spark, tmp_path):
    body = "".join(
        f'<httpSample t="{i}" lb="a > b"><sample t="{i}" lb="c"/><failureMessage>f{i}</failureMessage></httpSample>' for i in range(400)
    )
    path = write(tmp_path, "s.xml", f'<testResults><sample t="-1" lb="top">{body}<java.net.URL>u</java.net.URL></sample></testResults>')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        found = read_jtl_xml(spark, path)
        rows = found.collect()
        assert spark.read.option("lineSep", "<").text(path).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 801
    assert all(r["failure_message"] == f"f{r['elapsed']}" for r in rows if r["label"] == "a > b")
    assert all(r["failure_message"] is None for r in rows if r["label"] != "a > b")
    assert [r["label"] for r in rows if r["url"] == "u"] == ["top"]


def test_xml_failure_and_truncated_tail(spark, tmp_path):
    text = (
        f'<testResults><httpSample ts="{MS}" t="5" lb="a" s="false" it="3"><failureMessage>boom'
        f'</failureMessage></httpSample><sample ts="{MS}" t="6" lb="b" s="true"/>'
        f'<httpSample ts="{MS}" t="7" lb="c'
    )
    samples, quarantine = clean(read_jtl_xml(spark, write(tmp_path, "t.xml", text)))
    rows = {r["label"]: r for r in samples.collect()}
    assert rows["a"]["failure_message"] == "boom" and rows["a"]["idle_time"] == 3
    assert rows["b"]["elapsed"] == 6 and "c" not in rows
    assert [r["reason"] for r in quarantine.collect()] == ["not a whole XML element"]


def lines(n, header=HEADER_2, mark=",", bad=()):
    rows = [header.replace(",", mark)]
    for i in range(n):
        ms = "oops" if i in bad else str(100 + i % 900)
        rows.append(mark.join([str(MS + 1000 * i), ms, f"T{i % 5 + 1}", "200", "OK", "t-1", "text", "true", "9"]))
    return "\n".join(rows) + "\n"


def test_ingest_of_mixed_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox, "one.jtl", lines(100, bad={3, 4}))
    write(inbox, "two.csv", lines(50, mark=";"))
    swapped = "elapsed,timeStamp,label\n" + "".join(f"{i},{MS + i},x\n" for i in range(20))
    write(inbox, "three.csv", swapped)
    write(inbox, "four.xml", NESTED)
    found = {r["path"].rsplit("/", 1)[-1]: r for r in classify_inputs(spark, str(inbox)).collect()}
    assert {k: (r["format"], r["delimiter"]) for k, r in found.items()} == {
        "one.jtl": ("csv", ","), "two.csv": ("csv", ";"), "three.csv": ("csv", ","), "four.xml": ("xml", None),
    }
    done = ingest.ingest(spark, str(inbox), str(tmp_path / "out"))
    counts = {r["run_id"].rsplit("-", 1)[0]: tuple(r)[1:] for r in done.counts.collect()}
    assert counts == {"one": (98, 2, 100), "two": (50, 0, 50), "three": (20, 0, 20), "four": (0, 11, 11)}
    assert done.samples.count() == 168 and done.quarantine.count() == 13
    assert done.summary.agg(F.sum("count")).first()[0] == 168
    three = done.samples.filter("run_id like 'three-%'")
    assert three.agg(F.max("elapsed")).first()[0] == 19
    again = ingest.open_ingested(spark, str(tmp_path / "out"))
    assert again.quarantine.filter("reason like '%null%'").count() == 2


def test_names_of_all_kinds(spark, tmp_path):
    assert file_uri("s3a://bucket/a b/c#1%.csv") == "s3://bucket/a%20b/c%231%25.csv"
    assert file_uri("file:/tmp/x[1].csv") == "file:///tmp/x%5B1%5D.csv" and file_uri("/tmp/a b") == "file:///tmp/a%20b"
    inbox = tmp_path / "in put"
    inbox.mkdir()
    for name in ("a b.csv", "x[1].csv", "p%20q.csv", "h#1.csv", "{y}.csv"):
        write(inbox, name, lines(10))
    write(inbox, "broken.csv", lines(3) + f'{MS},5,"one\nlabel",200,"said ""no""\n\nthen",t-1,text,true,9\n')
    write(inbox, "notes.txt", "nothing to see here")
    done = ingest.ingest(spark, str(inbox), str(tmp_path / "out"))
    assert done.counts.count() == 6 and done.samples.count() == 54 and done.quarantine.count() == 0
    row = done.samples.filter("elapsed = 5").first()
    assert (row["label"], row["response_message"], row["bytes"]) == ("one\nlabel", 'said "no"\n\nthen', 9)
    rejected = spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["reason"]) for r in rejected] == [("notes.txt", "neither CSV nor XML results")]
    with pytest.raises(ValueError, match="neither CSV nor XML"):
        ingest.ingest(spark, str(inbox), str(tmp_path / "strict"), strict=True)


def test_ingest_without_bad_rows_has_an_empty_quarantine(spark, tmp_path):
    done = ingest.ingest(spark, write(tmp_path, "a.csv", lines(10)), str(tmp_path / "out"))
    assert done.quarantine.collect() == []
    assert done.quarantine.columns == ["row_index", "reason", "raw_json", "run_id"]


def test_unknown_file_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="neither CSV nor XML"):
        ingest.ingest(spark, write(tmp_path, "a.txt", "hello"), str(tmp_path / "out"))


def test_sinks(spark, tmp_path, fast):
    tables.write_samples(fast, f"{tmp_path}/s")
    assert tables.read_samples(spark, f"{tmp_path}/s").filter("run_id = 'run-1'").count() == 200
    none = clean(raw(spark, [(str(MS), "1", "true")]))[1].withColumn("run_id", F.lit("r"))
    tables.write_quarantine(none, f"{tmp_path}/q")
    assert tables.read_quarantine(spark, f"{tmp_path}/q").collect() == []


def test_live_metrics_survive_a_restart_and_arriving_files(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run():
        source = live.stream_jtl_csv(spark, str(inbox), HEADER_2, run_id=F.lit("r"), files_per_trigger=1)
        live.write_live(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return live.bucket_metrics(live.read_live(spark, f"{tmp_path}/out"))

    write(inbox, "a.csv", lines(100))
    first = run()
    assert first.agg(F.sum("total_count")).first()[0] == 100
    write(inbox, "b.csv", lines(200, bad={0}))
    rows = run().orderBy("bucket").collect()
    assert sum(r["total_count"] for r in rows) == 299
    assert math.isclose(rows[-1]["p50"], 100 + 194.5)
    assert live.live_samples(spark, f"{tmp_path}/out").count() == 299
    assert [r["reason"] for r in live.live_quarantine(spark, f"{tmp_path}/out").collect()] == ["elapsed is null"]
    with pytest.raises(ValueError, match="another checkpoint"):
        source = live.stream_jtl_csv(spark, str(inbox), HEADER_2, run_id=F.lit("r"))
        live.write_live(source, f"{tmp_path}/out", f"{tmp_path}/other")


def test_live_metrics_do_not_depend_on_the_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for k, day in enumerate((2, 1, 0)):  # the oldest run arrives last
        rows = lines(50).splitlines()
        late = [rows[0], *[f"{int(x.split(',', 1)[0]) + day * 86_400_000},{x.split(',', 1)[1]}" for x in rows[1:]]]
        os.utime(write(inbox, f"r{k}.csv", "\n".join(late) + "\n"), (MS / 1000 + k, MS / 1000 + k))
    found = []
    for n in (1, 1000):
        source = live.stream_jtl_csv(spark, str(inbox), HEADER_2, files_per_trigger=n)
        live.write_live(source, f"{tmp_path}/out{n}", f"{tmp_path}/state{n}").awaitTermination()
        found.append(sorted(live.read_live(spark, f"{tmp_path}/out{n}").collect()))
    assert found[0] == found[1] and sum(r["n"] for r in found[0]) == 150


def test_live_rows_keep_line_breaks_in_quotes(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    header = "timeStamp,elapsed,label,failureMessage,success,bytes"
    rows = [f'{MS},100,Home,"first ""line""\nsecond, line",false,10', f"{MS + 1},x,API,,true,20", f'{MS + 2},300,"a\r\nb",,true,30']
    write(inbox, "a.csv", "\n".join([header, *rows]) + "\n")
    write(inbox, "b.csv", "\n".join([header, f"{MS + 3},400,Plain,,true,40"]) + "\n")
    source = live.stream_jtl_csv(spark, str(inbox), header, run_id=F.lit("r"))
    live.write_live(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    found = live.live_samples(spark, f"{tmp_path}/out").orderBy("timestamp_ms").collect()
    assert [(r.elapsed, r.success, r.bytes) for r in found] == [(100, False, 10), (300, True, 30), (400, True, 40)]
    assert found[0].failure_message == 'first "line"\nsecond, line' and found[1].label.split() == ["a", "b"]
    assert live.live_quarantine(spark, f"{tmp_path}/out").count() == 1
    assert live.read_live(spark, f"{tmp_path}/out").agg(F.sum("errors")).first()[0] == 1


def test_a_stream_reads_a_large_file_in_many_tasks(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    header = "timeStamp,elapsed,label,failureMessage,success"
    plain = [f"{MS + i},{i},Home,ab\"c,true" for i in range(400)]
    broken = [f'{MS + i},{i},"Ho""me",{chr(34)}first,\n\nsecond {i}{chr(34)},false' for i in range(400)]
    files = {
        "plain": "\n".join([header, *plain, "", f"{MS},,x"]) + "\n", "returns": "\r\n".join([header, *plain]) + "\r\n",
        "broken": "\n".join([header, *broken]) + "\n", "both": "\r\n".join([header, *broken, *plain]), "blank": "\n".join([header, *plain, "  ", "\t"]),
        "old": "\n".join([header, *plain, f"{MS},7,a\rb,,true"]), "lost": "\n".join([header, *plain, f'{MS},8,"never', "closed,,true"]),
        "hidden": "\n".join([header, f'{MS},9,a"b,"two', 'lines",true']), "head": header + "\n",
    }
    for name, text in files.items():
        (inbox / f"{name}.csv").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = []
        for k, multi_line in enumerate((None, True)):
            source = live.stream_jtl_csv(spark, str(inbox), header, multi_line=multi_line)
            live.write_live(source, f"{tmp_path}/out{k}", f"{tmp_path}/state{k}").awaitTermination()
            bad = live.live_quarantine(spark, f"{tmp_path}/out{k}").select("run_id", "reason", "raw_json")
            good = live.live_samples(spark, f"{tmp_path}/out{k}")
            found.append([sorted(map(repr, good.collect())), sorted(map(repr, bad.collect())), good.schema])
        assert found[0] == found[1] and len(found[0][0]) > 2400 and len(found[0][1]) == 3
        assert len(list((tmp_path / "out0").glob("rows/*/*/kind=samples/*.parquet"))) > 9
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
