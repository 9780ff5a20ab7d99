"""Files of any number of headers, read by one scan."""

from __future__ import annotations

import io
import random
from collections import Counter
from contextlib import redirect_stdout

import pytest

from loadgauge.sources import ingest
from loadgauge.sources.csv_files import layouts_of, read_jtl_csv, read_placed_csv
from loadgauge.sources.detect import classify_inputs

FIELDS = ["timeStamp", "elapsed", "label", "responseCode", "success", "bytes", "Latency", "junk", "ts", "threadName"]
COLUMNS = ["timestamp_ms", "elapsed", "label", "response_code", "success", "bytes", "latency", "thread_name"]


def write_many(folder, files, variants, seed=5, broken=0):
    """Result files whose headers differ in columns, order and delimiter."""
    r = random.Random(seed)
    headers = []
    while len(headers) < variants:
        names = r.sample(FIELDS, r.randint(4, len(FIELDS)))
        headers.append((r.choice(",;\t"), [*{"elapsed": 1, **dict.fromkeys(names)}]))
    for i in range(files):
        mark, names = headers[i % variants]
        lines = [mark.join(names)]
        for j in range(4):
            cells = [r.choice([f"{n}{j}", str(j), "", f'"a{mark} ""b"""', f' "{j}']) for n in names]
            cells = cells[: len(cells) - (j == 2)] + ["more"] * (j == 3)
            lines.append(mark.join(cells))
        if i < broken:
            lines.append(mark.join(['"x\ny"'] * len(names)))
        end = r.choice(["\n", "\r\n"])
        (folder / f"run {i}.csv").write_text(r.choice(["", end, "\ufeff"]) + end.join(lines), encoding="utf-8", newline="")
    return headers


def rows_of(df):
    return Counter((r.source_file, *[r[c] if c in df.columns else None for c in COLUMNS]) for r in df.collect())


def plan_of(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("simple")
    return text.getvalue()


@pytest.fixture(params=[500, 3])
def few(request, monkeypatch):
    monkeypatch.setattr(ingest, "FEW_FILES", request.param)
    return request.param


def test_equals_a_scan_per_header(spark, tmp_path, few):
    write_many(tmp_path, 24, 8)
    (tmp_path / "other.xml").write_text('<?xml version="1.0"?><testResults><sample t="1" lb="x,y"/></testResults>')
    raw = ingest.read_raw(spark, str(tmp_path), multi_line=False)
    expected = Counter({})
    for row in classify_inputs(spark, str(tmp_path)).filter("format = 'csv'").collect():
        expected += rows_of(read_jtl_csv(spark, row.path, row.header, row.delimiter))
    found = rows_of(raw)
    assert sum(v for k, v in found.items() if k[0].endswith("other.xml")) == 1
    assert Counter({k: v for k, v in found.items() if not k[0].endswith("other.xml")}) == expected


def test_line_breaks_under_many_headers(spark, tmp_path, few):
    write_many(tmp_path, 12, 6, broken=5)
    expected = Counter({})
    for row in classify_inputs(spark, str(tmp_path)).collect():
        expected += rows_of(read_jtl_csv(spark, row.path, row.header, row.delimiter, multi_line=True))
    assert rows_of(ingest.read_raw(spark, str(tmp_path))) == expected


def test_one_scan_for_all_headers(spark, tmp_path):
    write_many(tmp_path, 300, 60)
    kinds = classify_inputs(spark, str(tmp_path))
    layouts = layouts_of(kinds.selectExpr("*", "false AS whole"))
    assert kinds.select("delimiter", "header").distinct().count() > 50
    plan = plan_of(read_placed_csv(spark, str(tmp_path), layouts))
    assert plan.count("FileScan csv") == 1 and "Union" not in plan
    assert len(layouts.delimiters) == 3


@pytest.mark.parametrize("headers", [0, 4])
def test_repeated_header_lines_are_rows(spark, tmp_path, monkeypatch, headers):
    monkeypatch.setattr(ingest, "FEW_HEADERS", headers)
    (tmp_path / "a.csv").write_text("\n\nts,elapsed,label\n1,2,a\nts,elapsed,label\n3,4,b\n")
    raw = ingest.read_raw(spark, str(tmp_path))
    assert sorted(r.elapsed for r in raw.collect()) == ["2", "4", "elapsed"]


def test_delimiter_of_the_caller(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts|elapsed,label\n1|2,3\n")
    row = ingest.read_raw(spark, str(tmp_path), delimiter="|").first()
    assert row.timestamp_ms == "1"
