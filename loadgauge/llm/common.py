"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.plans.joining import settle

SPACES = " \t\n\x0b\x0c\r"
# Words are runs of anything but the six ASCII spaces.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null and blank texts."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner != "", F.split(inner, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def n_words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner != "", F.size(F.split(inner, SPACE_RUN))).otherwise(0).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, and only if the whole is asked for."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_row_per_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The table itself if its ids are unique; else one row per id, that with the least text
    and, among equals, the least other plain columns.

    Rows without id stay as they are.
    """
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1")
    if not repeated.take(1):
        return docs
    plain = [f.name for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.name not in (id_col, text_col)]
    rest = [c for c in docs.columns if c != id_col]
    first = F.min_by(F.struct(*rest), F.struct(text_col, *plain)).alias("__row")
    keyed = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(first)
    keyed = keyed.select(id_col, "__row.*").select(docs.columns)
    return keyed.unionByName(docs.filter(F.col(id_col).isNull()))


def with_row_key(docs: DataFrame, id_col: str, name: str) -> DataFrame:
    """``docs`` with a column ``name`` that tells every row apart and rises with ``id_col``.

    Where no id is null or repeated, it is the id.  Else the table is stored in the order of its
    ids (null last), then of a digest of all columns, and ``name`` is a long that rises in that
    order; rows equal in every column are dealt keys by their place, so a share of rows without id
    spreads over all tasks.
    """
    unnamed = docs.filter(F.col(id_col).isNull())
    repeated = docs.groupBy(id_col).count().filter("count > 1")
    if not unnamed.take(1) and not repeated.take(1):
        return docs.withColumn(name, F.col(id_col))
    digest, place = free_name(docs, "__digest"), free_name(docs, "__place")
    all_columns = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    order = [F.col(id_col).isNull(), F.col(id_col), F.col(digest), F.col(place)]
    rows = docs.withColumns({digest: F.sha2(all_columns, 256), place: F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(rows.drop(digest, place).withColumn(name, F.monotonically_increasing_id()))
