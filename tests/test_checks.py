"""Every registered query against its DuckDB twin."""

import pytest

from checks import catalog, inputs
from checks.catalog import CHECKS
from checks.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKS)
def test_query_equals_its_twin(spark, con, sf_dir, name):
    outcome = compare(spark, con, sf_dir, name)
    # The smallest data set has no knee; larger ones do.
    if name in ("w3_knee", "e5_saturation_knee") and outcome == "no rows on either side":
        return
    assert outcome == ""


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys() >= CHECKS.keys()
    rows = entry.entry(spark).collect()
    assert len(rows) == 15 and rows[0].run_id == "run-a"


class Watched:
    """A started stream that can only be awaited once all runs have theirs."""

    started: list = []

    def __init__(self, query):
        self.query = query
        self.started.append(self)

    def awaitTermination(self):
        assert len(self.started) == len(inputs.CSV_LAYOUTS)
        self.query.awaitTermination()

    def stop(self):
        self.query.stop()


def _raw_rows(spark):
    fields = {c: "1" for c in inputs.CSV_NAMES} | {"timestamp_ms": "1700000000000"}
    rows = [(run, *fields.values()) for run in inputs.CSV_LAYOUTS for _ in range(3)]
    return spark.createDataFrame(rows, ["run_id", *fields])


def test_streams_run_side_by_side(spark, monkeypatch):
    start = catalog.live.write_live
    monkeypatch.setattr(Watched, "started", [])
    monkeypatch.setattr(catalog.live, "write_live", lambda *args, **options: Watched(start(*args, **options)))
    outs = catalog._streams(_raw_rows(spark))
    found = [[r.run_id for r in catalog.live.live_samples(spark, out).collect()] for out in outs]
    assert found == [[run] * 3 for run in reversed(inputs.CSV_LAYOUTS)]


def test_a_stream_that_cannot_start_stops_the_others(spark, monkeypatch):
    start, started = catalog.live.write_live, []

    def fails_last(*args, **options):
        if len(started) == 2:
            raise ValueError("no third")
        started.append(start(*args, **options))
        return started[-1]

    monkeypatch.setattr(catalog.live, "write_live", fails_last)
    with pytest.raises(ValueError, match="no third"):
        catalog._streams(_raw_rows(spark))
    assert len(started) == 2 and not any(q.isActive for q in started)
