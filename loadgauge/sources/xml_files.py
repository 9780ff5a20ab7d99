"""XML result files as raw strings under canonical names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.model import XML_ATTRIBUTES
from loadgauge.plans.joining import settle
from loadgauge.sources.xml_sections import (
    BLOCK,
    Blocks,
    Sections,
    begins_cdata,
    block_of,
    blocks_of,
    closes,
    continued_texts,
    in_markup,
    latest,
    opens,
    sections_of,
)

# The element and child names of a result file.
TAGS = ["httpSample", "sample"]
CHILDREN = {"failureMessage": "failure_message", "java.net.URL": "url"}

# A tag up to its end; a > inside quotes does not end it.
_HEAD = r"""^[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>"""
_NAME = r"^/?([^\s/>]+)"
_CORRUPT = "_corrupt_record"


def _records(spark: SparkSession, paths: Sequence[str] | str, files: DataFrame | None) -> DataFrame:
    """One row per tag, in the order of (source_file, split, id), with the text behind it."""
    found = spark.read.option("lineSep", "<").text(paths if isinstance(paths, str) else list(paths))
    if files is not None:
        named = found.select("*", "_metadata").withColumn("source_file", F.col("_metadata.file_path"))
        found = named.join(files.select("source_file"), "source_file", "left_semi")
    value = F.col("value")
    tags = found.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        value,
        F.regexp_extract(value, _HEAD, 0).alias("head"),
        F.regexp_extract(value, _NAME, 1).alias("name"),
        F.startswith(value, F.lit("/")).alias("closing"),
    )
    whole, own_end = F.col("head") != "", F.endswith("head", F.lit("/>"))
    step = F.when(F.col("name").rlike("^[!?]") | ~whole | (own_end & ~F.col("closing")), 0)
    step = step.when(F.col("closing"), -1).otherwise(1)
    sample = F.col("name").isin(TAGS) & ~F.col("closing")
    return tags.select(
        "source_file", "split", block_of(F.col("id")).alias("block"), "id", step.alias("step"), sample.alias("is_sample"),
        F.when(F.col("name").isin(list(CHILDREN)) & (step == 1), F.col("name")).alias("child"),
        F.length("head").alias("head_size"), opens(value).alias("opens"), closes(value).alias("closes"),
        begins_cdata(value).alias("cdata"), "value",
    )


def _parents(records: DataFrame, blocks: Blocks, sections: Sections | None) -> DataFrame:
    """id of each child text and of the sample whose direct child it is.

    The depth is a running sum per block plus the sums of the blocks before.  The parent of an
    element is the last one opened one level up: in its own block, else in the latest block before
    it that opened one.  Only one row per block and level is carried over, so that a file of any
    size is worked on in as many tasks as its number of records asks for.
    """
    tags = records.filter("step <> 0").select(*BLOCK, "id", "step", "is_sample", "child")
    tags = settle(in_markup(tags, blocks, sections))
    sums = tags.groupBy(*BLOCK).agg(F.sum("step").alias("steps"))
    before = Window.partitionBy("source_file").orderBy(*BLOCK[1:]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(sums.select(*BLOCK, F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy(*BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    levels = blocks.dealt(tags).withColumn("depth", F.sum("step").over(inside)).filter("step = 1").join(offsets, BLOCK)
    levels = levels.withColumn("depth", F.col("depth") + F.col("offset"))
    opened = F.struct("id", "is_sample")
    rows = levels.select(*BLOCK, "depth", "id", opened.alias("opened"), F.lit(False).alias("asks")).unionByName(
        levels.filter("child is not null").select(
            *BLOCK, (F.col("depth") - 1).alias("depth"), "id", F.lit(None).cast("struct<id:bigint,is_sample:boolean>").alias("opened"),
            F.lit(True).alias("asks"),
        )
    )
    # Stored: joined lazily with the carried rows, this union gave some rows twice.
    rows = settle(rows)
    by_level = Window.partitionBy(*BLOCK, "depth").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    asked = blocks.dealt(rows).withColumn("up", F.last("opened", ignorenulls=True).over(by_level)).filter("asks")
    last = rows.groupBy(*BLOCK, "depth").agg(latest(F.col("opened.id"), F.col("opened.is_sample"), "is_sample").alias("last"))
    earlier = Window.partitionBy("source_file", "depth").orderBy(*BLOCK[1:]).rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(last.select(*BLOCK, "depth", F.last("last", ignorenulls=True).over(earlier).alias("carried")))
    up = F.coalesce("up", "carried")
    found = asked.join(carried, [*BLOCK, "depth"]).select("id", up.alias("up")).filter("up.is_sample")
    return found.select("id", F.col("up.id").alias("parent"))


def read_jtl_xml(spark: SparkSession, paths: Sequence[str] | str, files: DataFrame | None = None) -> DataFrame:
    """Canonical raw strings, source_file and unread_xml from XML files.

    The files are read once, as text that ends at every ``<``; so Spark splits them anywhere, and
    each record holds one tag with all its attributes, at whatever depth.  Child texts join the
    sample that they lie in directly; of several, the first counts.  A child's text is what stands
    before its first inner tag or comment, with the content of CDATA sections as it is.  What stands in
    comments, CDATA sections and processing instructions is no sample, also where a section
    goes on over splits.  A sample tag that the end of the file cuts off, or that is no XML, and the
    beginning of a section that is never closed, come out as rows with their text in unread_xml,
    which cleaning sets aside with a reason.  ``files`` (source_file) leaves out other files below the paths.
    """
    records = settle(_records(spark, paths, files))
    blocks = blocks_of(records)
    sections = sections_of(records, blocks)
    behind = F.expr("substring(value, head_size + 1)")
    texts = blocks.dealt(records.filter("child is not null").select("id", "child", behind.alias("text")), "id")
    more = continued_texts(records, blocks, sections)
    if more is not None:
        texts = texts.join(blocks.dealt(more, "id"), "id", "left")
        texts = texts.select("id", "child", F.concat("text", F.coalesce("more", F.lit(""))).alias("text"))
    # Only children have a parent, so none that begins inside a section is left.
    children = texts.join(blocks.dealt(_parents(records, blocks, sections), "id"), "id")
    said = [F.min_by(F.when(F.col("child") == child, F.col("text")), F.when(F.col("child") == child, F.col("id"))).alias(name) for child, name in CHILDREN.items()]
    said = blocks.dealt(children, "parent").groupBy("parent").agg(*said).withColumnRenamed("parent", "id")
    whole = F.col("head_size") > 0
    element = F.concat(F.lit("<"), F.expr("rtrim('/', substring(value, 1, head_size - 1))"), F.lit("/>"))
    fields = [T.StructField(f"_{name}", T.StringType()) for name in XML_ATTRIBUTES]
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"attributePrefix": "_", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": _CORRUPT}
    cut_off = F.when(~whole, F.col("value"))
    found = records.filter("is_sample").select("id", "source_file", F.when(whole, element).alias("element"), cut_off.alias("cut"))
    found = in_markup(found, blocks, sections)
    if sections is not None:
        lost = records.join(sections.unclosed, "id").select("id", "source_file", F.lit(None).cast("string").alias("element"), F.col("value").alias("cut"))
        found = blocks.dealt(found.unionByName(lost), "id")
    parsed = found.withColumn("e", F.from_xml("element", schema, options))
    unread = F.coalesce("cut", F.col(f"e.{_CORRUPT}"))
    samples = parsed.select("id", "source_file", "e", unread.alias("unread_xml")).join(said, "id", "left")
    for name in CHILDREN.values():
        inner = F.from_xml(F.concat(F.lit("<x><v>"), name, F.lit("</v></x>")), "v string", {"ignoreSurroundingSpaces": "false"})
        samples = samples.withColumn(name, inner["v"])
    return samples.select(
        "source_file",
        *[F.col(f"e._{attribute}").alias(name) for attribute, name in XML_ATTRIBUTES.items()],
        F.nullif("failure_message", F.lit("")).alias("failure_message"),
        F.nullif("url", F.lit("")).alias("url"),
        "unread_xml",
    )
