"""Merged batch folders of a stream: bounded, equal for readers, safe against a merge that stops."""

from __future__ import annotations

import os
from pathlib import Path
from threading import Barrier

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.session import side_by_side
from loadgauge.sources import cleaning
from loadgauge.streaming import compaction, live

HEADER = "timeStamp,elapsed,label,success"
ROWS = T.StructType([T.StructField("v", T.LongType()), compaction.KIND])
COUNTS = T.StructType([T.StructField(x, T.LongType()) for x in ("key", "n", "errors")])
SCHEMAS = {"rows": ROWS, "counts": COUNTS}


def batch(spark, out, n):
    """Batch n: one row, and a count for one of three keys."""
    place = f"stream=s/batch={n}"
    spark.createDataFrame([(n, "samples")], ROWS).write.mode("overwrite").partitionBy("kind").parquet(f"{out}/rows/{place}")
    spark.createDataFrame([(n % 3, 1, n % 2)], COUNTS).write.mode("overwrite").parquet(f"{out}/counts/{place}")


def seen(spark, out):
    rows = sorted(r.v for r in compaction.stored(spark, out, "rows").collect())
    counts = compaction.stored(spark, out, "counts").agg(F.sum("n"), F.sum("errors")).first()
    return rows, tuple(counts)


def want(n):
    return list(range(n)), (n, n // 2)


def folders(out):
    return len(list(Path(out).glob("*/stream=*/batch=*"))) + len(list(Path(out).glob("merged/*/batches=*")))


def test_levels_stay_few(spark, tmp_path):
    out, most = str(tmp_path), 0
    for n in range(20):
        batch(spark, out, n)
        compaction.compact(spark, out, "s", n, SCHEMAS, 2)
        most = max(most, folders(out))
        if n % 5 == 4:
            assert seen(spark, out) == want(n + 1)
    manifest = compaction.read_manifest(spark, out)
    levels = [s.level for s in manifest.segments]
    assert levels == sorted(set(levels), reverse=True)  # with a fan of 2, one segment a level
    assert [s.first for s in manifest.segments[1:]] == [s.upto for s in manifest.segments[:-1]]
    assert most <= 2 * (6 + 2 * 5) and len(list(tmp_path.glob("manifest/*"))) == 2


@pytest.mark.parametrize("step", ["second table", "manifest", "deletion"])
def test_a_merge_that_stops_changes_nothing(spark, tmp_path, monkeypatch, step):
    out = str(tmp_path)
    for n in range(4):
        batch(spark, out, n)
    assert compaction.compact(spark, out, "s", 2, SCHEMAS, 2)
    before = compaction.read_manifest(spark, out)
    with monkeypatch.context() as patch:
        def stop(*args):
            if step != "second table" or args[2] == "counts":
                raise RuntimeError("killed")
            return merge(*args)

        merge = compaction._merge
        patch.setattr(compaction, {"second table": "_merge", "manifest": "_commit", "deletion": "_delete"}[step], stop)
        with pytest.raises(RuntimeError, match="killed"):
            compaction.compact(spark, out, "s", 4, SCHEMAS, 2)
    assert seen(spark, out) == want(4)
    if step == "deletion":
        assert compaction.read_manifest(spark, out).upto == 4
    else:
        assert compaction.read_manifest(spark, out) == before
        assert compaction.compact(spark, out, "s", 4, SCHEMAS, 2)
    batch(spark, out, 4)
    batch(spark, out, 5)
    assert compaction.compact(spark, out, "s", 6, SCHEMAS, 2)
    assert seen(spark, out) == want(6)


def test_readers_keep_what_a_merge_replaces(spark, tmp_path):
    out = str(tmp_path)
    for n in range(3):
        batch(spark, out, n)
    rows = compaction.stored(spark, out, "rows")
    assert compaction.compact(spark, out, "s", 2, SCHEMAS, 2)
    assert rows.count() == 3 and seen(spark, out) == want(3)
    batch(spark, out, 1)  # a folder that is merged already does not count again
    assert seen(spark, out) == want(3)


def test_a_stream_with_merges_equals_one_without(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for k in range(7):
        text = [HEADER, *[f"{1_700_000_000_000 + k * 20_000 + i * 500},{100 + i},a,true" for i in range(40 * (k != 3))]]
        text.append(f"{1_700_000_000_000},,a,true" if k % 2 else text.pop())
        path = inbox / f"{k}.csv"
        path.write_text("\n".join(text) + "\n")
        os.utime(path, (1_700_000_000 + k,) * 2)
    found = []
    for every in (2, 100):
        out, state = f"{tmp_path}/out{every}", f"{tmp_path}/state{every}"
        for _ in range(2):  # the second start has nothing to do
            source = live.stream_jtl_csv(spark, str(inbox), HEADER, run_id=F.lit("r"), files_per_trigger=1)
            live.write_live(source, out, state, merge_every=every).awaitTermination()
        found.append([
            sorted(live.read_live(spark, out).collect()), live.live_samples(spark, out).count(),
            sorted(live.live_quarantine(spark, out).collect()), live.live_samples(spark, out).schema,
        ])
    assert found[0][:3] == found[1][:3] and set(found[0][3].names) == set(found[1][3].names)
    assert compaction.read_manifest(spark, f"{tmp_path}/out2").upto == 6
    assert compaction.read_manifest(spark, f"{tmp_path}/out100") is None
    with pytest.raises(ValueError, match="another checkpoint"):
        live.write_live(source, f"{tmp_path}/out2", f"{tmp_path}/other")


def test_tables_are_merged_side_by_side(spark, tmp_path, monkeypatch):
    out, both, merge = str(tmp_path), Barrier(2), compaction._merge
    for n in range(2):
        batch(spark, out, n)
    monkeypatch.setattr(compaction, "_merge", lambda *args: (both.wait(60), merge(*args)))
    assert compaction.compact(spark, out, "s", 2, SCHEMAS, 2)
    assert seen(spark, out) == want(2) and compaction.read_manifest(spark, out).upto == 2


def test_jobs_side_by_side_end_before_one_that_fails_raises(spark):
    ended, started = [], Barrier(2)

    def job(n):
        started.wait(60)
        found = spark.sparkContext.getLocalProperty("told"), spark.range(n).count()
        if n == 1:
            raise RuntimeError("first")
        ended.append(found)

    spark.sparkContext.setLocalProperty("told", "by caller")
    try:
        with pytest.raises(RuntimeError, match="first"):
            side_by_side(spark, job, [1, 2])
    finally:
        spark.sparkContext.setLocalProperty("told", None)
    assert ended == [("by caller", 2)]


def test_a_stream_builds_its_expressions_once(spark, tmp_path, monkeypatch):
    inbox, built, read = tmp_path / "in", [], cleaning.normalize_timestamp
    inbox.mkdir()
    for k in range(3):
        (inbox / f"{k}.csv").write_text(f"{HEADER}\n{1_700_000_000_000 + k},{k},a,true\nnever,7,b,true\n")
    monkeypatch.setattr(cleaning, "normalize_timestamp", lambda value: (built.append(value), read(value))[1])
    source = live.stream_jtl_csv(spark, str(inbox), HEADER, run_id=F.lit("r"), files_per_trigger=1)
    live.write_live(source, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert len(built) == 2  # the column and its reason, not once more for each of three batches
    assert sorted(r.elapsed for r in live.live_samples(spark, f"{tmp_path}/out").collect()) == [0, 1, 2]
    assert live.live_quarantine(spark, f"{tmp_path}/out").count() == 3


def test_line_facts(spark):
    lines = ["", "\r", " ", " \r", "\t\x00 ", "\r\r", " \r\r", "a", "a\r", "a\rb", " a", "!", "é ", "\u00a0", 'a,"b', '"b\r', 'a,"b"', 'a"b,c']
    found = spark.createDataFrame([(x,) for x in lines], "value string").select("value", *live._line_facts(",")).collect()
    cut = {x: x[:-1] if x.endswith("\r") else x for x in lines}
    odd = {x for x in lines if "\r" in cut[x] or (cut[x] and all(c <= " " for c in cut[x]))}
    assert {r.value for r in found if r.odd} == odd and {r.value for r in found if r.returns} == {x for x in lines if "\r" in x}
    assert {r.value for r in found if r.open} == {'a,"b', '"b\r'}
