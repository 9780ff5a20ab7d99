"""CSV files with line breaks inside quotes, put together from the lines of many splits."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from loadgauge.sources.csv_files import read_broken_csv, read_jtl_csv

HEADER = "timeStamp,elapsed,label,failureMessage"


def rows_of(df):
    # Spark's parser turns \r\n inside quotes into \n if the lines of a file end so; read_broken_csv keeps it.
    same = lambda x: x and x.replace("\r\n", "\n")
    return Counter((r.timestamp_ms, r.elapsed, same(r.label), same(r.failure_message)) for r in df.collect())


@pytest.fixture(params=["400", "128m"])
def split_size(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def field(r):
    inner = "".join(r.choices(["a", "é", " ", ",", ";", "\n", "\n\n", '""', "x" * 30, "\r\n"], k=r.randint(0, 7)))
    return f'"{inner}"' if r.random() < 0.6 else r.choice(["plain", "", '5" wide', 'a "quoted" word', "it's"])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_whole_file(spark, tmp_path, split_size, end):
    r = random.Random(3)
    for i in range(3):
        lines = [f"{j},{j},{field(r)},{field(r)}" for j in range(60)]
        (tmp_path / f"{i}.csv").write_text(end.join([HEADER, *lines]) + r.choice(["", end, end + end]), encoding="utf-8", newline="")
    found = read_broken_csv(spark, str(tmp_path), HEADER)
    if split_size == "400":
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert rows_of(found) == rows_of(read_jtl_csv(spark, str(tmp_path), HEADER, multi_line=True))


def test_line_ends_inside_quotes_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{HEADER}\r\n1,1,"a\r\nb\nc",d\r\n', newline="")
    assert [r.label for r in read_broken_csv(spark, str(tmp_path), HEADER).collect()] == ["a\r\nb\nc"]


def test_other_delimiters_and_order(spark, tmp_path, split_size):
    header = "label;elapsed;other;timeStamp"
    text = "\n\n" + header + '\n"a;\nb";1;"x\n\n""y""";7\nc;2;z;8\n"d";3;"' + "long\n" * 60 + '";9\n'
    (tmp_path / "a.csv").write_text(text)
    rows = read_broken_csv(spark, str(tmp_path), header, ";").collect()
    assert sorted((r.label, r.elapsed, r.timestamp_ms) for r in rows) == [("a;\nb", "1", "7"), ("c", "2", "8"), ("d", "3", "9")]
