"""SimHash fingerprints and near-duplicate groups by deletion-variant signatures.

With at most four differing bits over three segments, one segment differs in at most one bit.
Each distinct fingerprint is therefore indexed under every segment with one bit taken out: two
fingerprints within reach share such a key, whichever bit differs.  An equality grouping on the
keys finds candidates, all 64 bits verify them.  Within a key only a spanning forest of the
verified links leaves the task, so a large group of near copies gives as many links as members,
not as many as pairs; the connected components are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadgauge.llm.common import WORD_BYTES, free_name, with_row_key
from loadgauge.llm.components import components
from loadgauge.plans.joining import settle

SHINGLE = 4
SEED = 42
REACH = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))
FEW = 8  # members of a key that are compared pair by pair in one numpy pass
BLOCK = 1 << 22  # comparisons held in memory at a time

_WORD = re.compile(WORD_BYTES)
_BITS = np.arange(64, dtype=np.uint64)
SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the hashes of all shingles, repeats included; 0 without words."""
    spans = [] if text is None else _WORD.findall(text.lower().encode() if text.isascii() else text.encode().lower())
    if not spans:
        return 0
    joined = b" ".join(spans)
    ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(spans))
    starts, ends = starts[: len(spans) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        part = zip(starts[i : i + SLICE], ends[i : i + SLICE], strict=True)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in part), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BITS[2 * ones > n]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long): one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def variant_keys(fp: Column) -> Column:
    """One key per bit: the segment of the bit without it, tagged with the place of the bit."""
    keys = []
    for start, width in SEGMENTS:
        segment = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            low = segment.bitwiseAND(F.lit((1 << bit) - 1))
            high = F.shiftleft(F.shiftright(segment, bit + 1), bit)
            keys.append(F.lit((start + bit) << 32).bitwiseOR(high.bitwiseOR(low)))
    return F.explode(F.array(*keys))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= REACH


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked among distinct fingerprints: fewer than there are.

    Members near a pivot are linked to it and need no comparison with each other.  What is left
    is compared between pivots' clusters, block by block, until every two clusters that touch
    are connected.  Pivots over three reaches apart cannot have members that link.
    """
    links, pivots, clusters, rest = [], [], [], fps
    while len(rest):
        close = near(rest, rest[0])
        links += [(int(rest[0]), int(x)) for x in rest[close][1:]]
        pivots.append(rest[0])
        clusters.append(rest[close])
        rest = rest[~close]
    root = np.arange(len(pivots))
    heads = np.array(pivots, np.uint64)
    for i in range(len(pivots)):
        may = np.flatnonzero(np.bitwise_count(heads[i + 1 :] ^ heads[i]) <= 3 * REACH) + i + 1
        for j in may[root[may] != root[i]]:
            if root[j] == root[i]:
                continue
            a, b = clusters[i], clusters[j]
            step = max(1, BLOCK // len(b))
            for k in range(0, len(a), step):
                hit = np.argwhere(near(a[k : k + step, None], b[None, :]))
                if len(hit):
                    links.append((int(a[k + hit[0][0]]), int(b[hit[0][1]])))
                    root[root == root[j]] = root[i]
                    break
    return links


def links_of_keys(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole groups; keys are sorted and fingerprints distinct in a group."""
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    few = np.repeat(sizes <= FEW, sizes)
    k, f = keys[few], fps[few]
    left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for o in range(1, FEW):
        same = np.flatnonzero(k[:-o] == k[o:])
        if not len(same):
            break
        hit = same[near(f[same], f[same + o])]
        left.append(f[hit])
        right.append(f[hit + o])
    for g in np.flatnonzero(sizes > FEW):
        found = np.array(forest(fps[bounds[g] : bounds[g + 1]]), np.uint64).reshape(-1, 2)
        left.append(found[:, 0])
        right.append(found[:, 1])
    return np.concatenate(left), np.concatenate(right)


def linked(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that keep every component whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]

        def emit(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = links_of_keys(k, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            if k[-1] == (keys[-1][-1] if len(keys[-1]) else k[0]):  # the open key goes on
                keys.append(k)
                fps.append(f)
                continue
            cut = int(np.searchsorted(k, k[-1]))
            yield emit(np.concatenate([*keys, k[:cut]]), np.concatenate([*fps, f[:cut]]))
            keys, fps = [k[cut:]], [f[cut:]]
        last = np.concatenate(keys)
        if len(last):
            yield emit(last, np.concatenate(fps))

    keyed = distinct.select(variant_keys(F.col("fp")).alias("key"), "fp")
    keyed = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return keyed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: a row per row; groups of documents within reach of each other.

    Null, empty and blank texts have fingerprint 0 and link like any other.  Copies meet as one
    fingerprint before anything else, so a group of copies of any size costs one row.  Rows that
    repeat an id have a row each.  Rows without id get the id of their group, if it has one, and
    give none.  An empty table gives no rows.  Other columns do not matter.
    """
    rows = settle(fingerprints(docs))
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(linked(distinct))
    named = distinct.join(joined.withColumnRenamed("id", "fp"), "fp", "left")
    named = named.select("fp", F.coalesce("component_id", "fp").alias("part"), "rep")
    smallest = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = settle(named.join(smallest, "part").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest id; the columns of ``docs`` as they are.

    Every row is a document.  Of rows that share their group's smallest id, one stays; groups
    whose rows all lack an id keep one as well.
    """
    key = free_name(docs, "__key")
    docs_keyed = with_row_key(docs, "doc_id", key)
    groups = near_duplicates(docs_keyed.select(F.col(key).alias("doc_id"), "text"))
    ident = free_name(docs_keyed, "__id")
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias(ident))
    return docs_keyed.join(keep, docs_keyed[key] == keep[ident], "left_semi").select(docs.columns)
