"""Substring dedup on a De Bruijn graph of token k-mers.

An edge is a window of k consecutive words, leading from its first k - 1 words to its last; an
edge repeats if it starts in more than one document.  Only repeated edges are worth a row:

1. Every window has a smallest short k-mer (its anchor).  Equal windows have equal anchors, so a
   window repeats only if its anchor occurs in several documents.  Anchors are few, and are
   counted first.
2. Windows with a repeated anchor become edges (96-bit hash, document, position).  Grouping gives
   each edge its source: the smallest document, and the position in it.
3. A join gives each later occurrence its source coordinates.  Successive edges whose source
   coordinates advance together form a nonbranching path and compact into one span of words; a
   branch, where the source changes, starts another.
4. The words under the spans are removed from the text.

Whole copies of a text are settled by the hash of all their words and take no part in 1 to 3.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.llm.common import WORD_BYTES, free_name, with_row_key
from loadgauge.plans.joining import settle

WINDOW = 50
ANCHOR = 20

_WORD = re.compile(WORD_BYTES)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1, 2**63, (2, 256), np.uint64)
# Odd factors have inverses modulo 2**64, so a hash of any stretch is a difference of prefix sums.
_FACTORS = [int(x) | 1 for x in _RNG.integers(1, 2**63, 4, np.uint64)]
_STEP = 1 << 12


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = factor
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of each factor and of its inverse, kept as long as the longest text so far."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, _STEP)
            self.up = [_powers(f, self.n) for f in _FACTORS]
            self.down = [_powers(pow(f, -1, 2**64), self.n) for f in _FACTORS]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int, powers: Powers) -> np.ndarray:
    """A hash of values[start:end] for each pair, independent of the place."""
    powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.up[which][: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers.down[which][starts])


def word_hashes(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word of a text."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    length = (ends - starts).astype(np.uint64)
    return tuple(
        mixed(stretches(_BYTES[k][raw], starts, ends, k, powers) + length) for k in (0, 1)
    )


def grams(hashes: np.ndarray, k: int, which: int, powers: Powers) -> np.ndarray:
    starts = np.arange(max(0, len(hashes) - k + 1))
    return stretches(hashes, starts, starts + k, which, powers)


def anchors(hashes: np.ndarray, powers: Powers, window: int = WINDOW, k: int = ANCHOR) -> np.ndarray:
    """For each window the smallest hash of a k-mer in it, found by doubling."""
    low = grams(hashes, k, 2, powers)
    width, have = window - k + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        have += step
    return low


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode()


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, t1 and t2 (hash of all words), kept_sha256 of the whole, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            n, t, sha, hs = [], [[], []], [], []
            for text in batch.column(1):
                data = encoded(text.as_py())
                both = word_hashes(data, powers)
                n.append(len(both[0]))
                for k in (0, 1):
                    whole = stretches(both[k], np.array([0]), np.array([n[-1]]), k, powers)
                    t[k].append(int(whole.view(np.int64)[0]))
                sha.append(digest(_WORD.findall(data)))
                hs.append(np.unique(anchors(both[0], powers)).view(np.int64) if n[-1] >= WINDOW else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.int64()) for x in t], pa.array(sha), pa.array(hs, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "t1", "t2", "kept_sha256", "anchors"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, t1 long, t2 long, kept_sha256 string, anchors array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def edges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, anchors that repeat) -> h1, h2, doc_id, pos: the windows above those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i in range(batch.num_rows):
                both = word_hashes(encoded(batch.column(1)[i].as_py()), powers)
                known = batch.column(2)[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                pos = np.flatnonzero(np.isin(anchors(both[0], powers), known))
                if not len(pos):
                    continue
                h = [stretches(both[k], pos, pos + WINDOW, k, powers) for k in (0, 1)]
                h1, h2 = pa.array(h[0].view(np.int64)), pa.array((h[1] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                ids = pa.repeat(batch.column(0)[i], len(pos))
                yield pa.RecordBatch.from_arrays([h1, h2, ids, pa.array(pos.astype(np.int32))], ["h1", "h2", "doc_id", "pos"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"h1 long, h2 int, doc_id {kind}, pos int")


def paths(found: DataFrame) -> DataFrame:
    """Edges -> doc_id, start, stop, src_doc, src_start: compacted repeats, in words [start, stop).

    Only occurrences after an edge's smallest document are repeats.  The join has unique edges on
    one side, so its output is no larger than its input; stored, they let AQE split hot edges.
    An edge that its source holds twice has one of its places there.
    """
    source = found.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("src_doc"), F.min_by("pos", "doc_id").alias("src_pos"), F.max("doc_id").alias("last")
    )
    source = settle(source.filter("last > src_doc").drop("last"))
    later = found.join(source, ["h1", "h2"]).filter("doc_id > src_doc").select("doc_id", "pos", "src_doc", "src_pos")
    order = Window.partitionBy("doc_id").orderBy("pos")
    goes_on = (
        (F.col("pos") == F.lag("pos").over(order) + 1)
        & (F.col("src_doc") == F.lag("src_doc").over(order))
        & (F.col("src_pos") == F.lag("src_pos").over(order) + 1)
    )
    branch = F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    numbered = later.withColumn("branch", branch).withColumn("path", F.sum("branch").over(order))
    return numbered.groupBy("doc_id", "path").agg(
        F.min("pos").alias("start"), (F.max("pos") + WINDOW).alias("stop"),
        F.first("src_doc").alias("src_doc"), F.min("src_pos").alias("src_start"),
    ).drop("path")


def _cut(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) -> doc_id, n_removed, kept_sha256, kept_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts, shas = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = _WORD.findall(encoded(text.as_py()))
                at = spans.values
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at.field("start").to_numpy(), 1)
                np.add.at(change, at.field("stop").to_numpy(), -1)
                keep = np.cumsum(change)[:-1] == 0
                kept = [words[i] for i in np.flatnonzero(keep)]
                removed.append(len(words) - len(kept))
                joined = b" ".join(kept)
                texts.append(joined.decode())
                shas.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_removed", "kept_sha256", "kept_text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_removed long, kept_sha256 string, kept_text string")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile of each document, ids of whole copies, paths of the others), all stored; ids are unique."""
    profile = settle(profiles(docs))
    same = ["t1", "t2", "n_words"]
    groups = profile.filter(F.col("n_words") >= WINDOW).groupBy(*same).agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")
    )
    groups = groups.filter("last > rep").select(*same, "rep")
    copies = settle(profile.select("doc_id", *same).join(groups, same).filter("doc_id > rep").select("doc_id"))
    first = profile.join(copies, "doc_id", "left_anti")
    spread = first.select("doc_id", F.explode("anchors").alias("anchor"))
    twice = spread.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    of_doc = spread.join(twice, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("known"))
    texts = docs.select(F.col("doc_id"), F.col("text")).join(of_doc, "doc_id")
    return profile, copies, settle(paths(settle(edges(texts.select("doc_id", "text", "known")))))


def _spans(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row per row of ``docs``.

    A word goes if a window of 50 words around it starts in a document with a smaller id.  Every
    row is a document; those that share an id, or have none, come in the order of ``with_row_key``,
    those without an id last.  Null and blank texts have no words and the digest of the empty
    string; texts under 50 words stay.  An empty table gives no rows.
    """
    named = with_row_key(docs.select("doc_id", "text"), "doc_id", "key")
    docs = named.select(F.col("key").alias("doc_id"), "text")
    profile, copies, found = repeats(docs)
    cut = _cut(docs.join(_spans(found), "doc_id")).select("doc_id", "n_removed", F.col("kept_sha256").alias("cut_sha"))
    gone = copies.select("doc_id", F.lit(digest([])).alias("empty_sha"))
    whole = profile.select("doc_id", "n_words", "kept_sha256")
    joined = whole.join(cut, "doc_id", "left").join(gone, "doc_id", "left")
    report = joined.select(
        "doc_id", "n_words",
        F.when(F.col("empty_sha").isNotNull(), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.coalesce("empty_sha", "cut_sha", "kept_sha256").alias("kept_sha256"),
    )
    report = report.withColumnRenamed("doc_id", "key")
    return named.select("key", "doc_id").join(report, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")


def cut_documents(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages; those left without a word go.

    A text that loses nothing keeps its form; else its words are joined by single spaces.  Every
    row is a document, as in ``repeat_report``; blank and null texts stay.
    """
    columns, key = docs.columns, free_name(docs, "__key")
    docs = with_row_key(docs, "doc_id", key)
    texts = docs.select(F.col(key).alias("doc_id"), "text")
    _, copies, found = repeats(texts)
    ident, text = free_name(docs, "__id"), free_name(docs, "__text")
    copies = copies.select(F.col("doc_id").alias(ident))
    left = docs.join(copies, docs[key] == copies[ident], "left_anti")
    cut = settle(_cut(texts.join(_spans(found), "doc_id")))
    cut = cut.select(F.col("doc_id").alias(ident), F.col("kept_text").alias(text))
    joined = left.join(cut, left[key] == cut[ident], "left").filter(F.col(text).isNull() | (F.col(text) != ""))
    return joined.withColumn("text", F.coalesce(text, "text")).select(columns)
