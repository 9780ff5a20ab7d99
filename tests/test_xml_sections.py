"""Comments, CDATA sections and instructions in XML results, against the standard library's parser."""

from __future__ import annotations

import random
from collections import Counter
from xml.etree import ElementTree

import pytest

from loadgauge.sources import xml_files, xml_sections
from loadgauge.sources.cleaning import clean
from loadgauge.sources.xml_files import read_jtl_xml

GHOST = '<httpSample t="666" lb="ghost"/>'


def by_parser(text):
    builder = ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)
    root = ElementTree.fromstring(text, ElementTree.XMLParser(target=builder))
    child = lambda e, name: next((c.text or None for c in e if c.tag == name), None)
    return Counter((e.get("t"), e.get("lb"), child(e, "failureMessage"), child(e, "java.net.URL")) for e in root.iter() if e.tag in ("httpSample", "sample"))


def by_spark(spark, path):
    rows = read_jtl_xml(spark, str(path)).collect()
    assert all(r.unread_xml is None for r in rows)
    return Counter((r.elapsed, r.label, r.failure_message, r.url) for r in rows)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def noise(r):
    inner = "".join(r.choices([GHOST, "<sample ", "</sample>", "<", ">", "&", " - ", "?", "]]", "text ", '"', "<failureMessage>"], k=r.randint(0, 9)))
    return r.choice([
        f"<!--{inner.replace('-', '')}-->", f"<!-- <![CDATA[ ]]> {inner.replace('-', '')}-->", f"<?note {inner.replace('?', '')} <!-- ?>", "",
    ])


def message(r):
    parts = []
    for _ in range(r.randint(0, 3)):
        inner = "".join(r.choices([GHOST, "<", "</failureMessage>", "<!--", "-->", "<?", "?>", " x ", "&amp;", "]] ", "end"], k=r.randint(0, 8)))
        parts.append(r.choice([f"<![CDATA[{inner}]]>", "plain &lt;b&gt; ", "<!-- note -->", "<i>in</i>"]))
    return "<failureMessage>" + "".join(parts) + "</failureMessage>"


def element(r, number, depth):
    tag = r.choice(["httpSample", "sample"])
    inner = [noise(r), message(r) if r.random() < 0.6 else "", noise(r)]
    if r.random() < 0.3:
        inner.append("<java.net.URL><![CDATA[http://a/?b<c&d]]></java.net.URL>")
    for _ in range(r.randint(0, 2) if depth else 0):
        inner.append(element(r, number, depth - 1))
    r.shuffle(inner)
    number[0] += 1
    return f'<{tag} t="{number[0]}" lb="l > {number[0]}">{"".join(inner)}</{tag}>'


def test_made_files_equal_the_parser(spark, tmp_path, small_splits):
    r = random.Random(8)
    want = Counter()
    for i in range(6):
        number = [1000 * i]
        text = f'<?xml version="1.0"?><testResults>{"".join(noise(r) + element(r, number, 3) for _ in range(8))}</testResults>'
        (tmp_path / f"{i}.xml").write_text(text, encoding="utf-8")
        want += by_parser(text)
    assert any("<" in (k[2] or "") for k in want) and not any(k[0] == "666" for k in want)
    assert by_spark(spark, tmp_path) == want


def test_sections_over_many_splits(spark, tmp_path, small_splits):
    long = GHOST * 60
    text = (
        f'<testResults><sample t="1" lb="a"><failureMessage>before <![CDATA[{long}]]> after<![CDATA[ &amp; ]]></failureMessage></sample>'
        f'<!-- {long} --><sample t="2" lb="b"/><?keep {long} ?><sample t="3" lb="c"><java.net.URL>u</java.net.URL></sample></testResults>'
    )
    path = tmp_path / "s.xml"
    path.write_text(text)
    assert spark.read.option("lineSep", "<").text(str(path)).rdd.getNumPartitions() > 10
    found = by_spark(spark, path)
    assert found == by_parser(text)
    assert ("1", "a", f"before {long} after &amp; ", None) in found


def test_a_section_without_end_is_set_aside(spark, tmp_path):
    for section in ("<!-- lost ", "<![CDATA[ lost ", "<?lost "):
        path = tmp_path / f"{len(section)}.xml"
        path.write_text(f'<testResults><sample ts="1700000000000" t="1" lb="a"/>{section}{GHOST}{GHOST}')
        samples, quarantine = clean(read_jtl_xml(spark, str(path)))
        assert [r.label for r in samples.collect()] == ["a"]
        (bad,) = quarantine.collect()
        assert bad.reason == "not a whole XML element" and "lost" in bad.raw_json


def test_plain_cdata(spark, tmp_path):
    path = tmp_path / "c.xml"
    path.write_text('<r><sample t="1"><failureMessage><![CDATA[boom]]></failureMessage></sample><!-- <sample t="2"/> --></r>')
    assert by_spark(spark, path) == Counter({("1", None, "boom", None): 1})


def test_python_sees_a_split_block_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xml_sections, "BLOCK_BITS", 3)
    monkeypatch.setattr(xml_sections, "LEAST_BITS", 4)
    long = GHOST * 40
    r, number = random.Random(5), [0]
    text = f'<testResults>{"".join(noise(r) + element(r, number, 2) for _ in range(6))}<!-- {long} --><sample t="9000" lb="z"/></testResults>'
    path = tmp_path / "b.xml"
    path.write_text(text, encoding="utf-8")
    seen = spark.sparkContext.accumulator(0)
    function = xml_sections._function_of_block

    def counted(table):
        seen.add(1)
        assert table.num_rows <= 8
        return function(table)

    monkeypatch.setattr(xml_sections, "_function_of_block", counted)
    assert spark.read.option("lineSep", "<").text(str(path)).rdd.getNumPartitions() == 1
    assert by_spark(spark, path) == by_parser(text)
    assert seen.value > 5


def test_what_blocks_carry_on_is_found_without_sorting_splits(spark, tmp_path, monkeypatch):
    path = tmp_path / "c.xml"
    path.write_text(f'<r><sample t="1" lb="a"><failureMessage>at <![CDATA[{GHOST}]]></failureMessage></sample></r>')
    settle, plans = xml_sections.settle, []

    def seen(facts):
        if "carried" in facts.columns:
            plans.append(facts._jdf.queryExecution().executedPlan().toString())
        return settle(facts)

    monkeypatch.setattr(xml_sections, "settle", seen)
    monkeypatch.setattr(xml_files, "settle", seen)
    assert by_spark(spark, path) == Counter({("1", "a", f"at {GHOST}", None): 1})
    assert len(plans) == 2
    assert all("HashAggregate" in p and "SortAggregate" not in p for p in plans)
