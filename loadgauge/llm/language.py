"""Language identification: known words by log frequency, others by backoff to n-grams.

Training counts words on a bounded, hash-chosen sample of the labelled documents of each language
and keeps the most frequent of each; their n-grams are counted with the words' weight.  The model is then a
table of log frequencies with a row per word and per n-gram.  A text adds up one row per word: the
word's own if it is known, else the mean over its longest n-grams that are known, shorter ones
only if too few of the longer are.
"""

from __future__ import annotations

import heapq
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.plans.joining import settle

SAMPLE_DOCS = 1500  # of each language
MOST_WORDS = 60_000
MOST_GRAMS = 120_000
LONGEST = 5
SMOOTH = 0.5
UNKNOWN = "und"


def _ranges(major: str) -> str:
    """The characters of a Unicode category, as ranges of a pattern."""
    inside = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == major]
    parts, begin = [], inside[0]
    for c, following in zip(inside, [*inside[1:], -1], strict=True):
        if following != c + 1:
            parts.append(rf"\U{begin:08x}-\U{c:08x}")
            begin = following
    return "".join(parts)


# A letter, then letters and the marks that belong to them.
_LETTERS = re.compile(f"[{_ranges('L')}][{_ranges('L')}{_ranges('M')}]*")


@dataclass(frozen=True)
class Model:
    """Rows of log frequencies; its size is bounded by MOST_WORDS, MOST_GRAMS and the languages."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_words(text: str | None) -> list[str]:
    """Runs of letters with their marks, in lower case; signs, digits and fractions are no letters."""
    return [] if text is None else _LETTERS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _logs(counts: dict[str, dict[str, int]], langs: list[str]) -> tuple[dict[str, int], np.ndarray]:
    rows = {key: i for i, key in enumerate(counts)}
    table = np.zeros((len(rows), len(langs)))
    for key, i in rows.items():
        for lang, n in counts[key].items():
            table[i, langs.index(lang)] = n
    total = table.sum(axis=0) + SMOOTH * max(1, len(rows))
    return rows, np.log((table + SMOOTH) / total)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model:
    """Fit on labelled rows (doc_id, text, lang) outside the held-out fold.

    About ``sample_docs`` documents of each language take part, chosen by a hash of their id (of
    their text if they have none), or all if there are fewer.  ``most_words`` and ``most_grams``
    are shared evenly by the languages: each keeps its own most frequent, and only the counts of
    these words reach the driver.  Without labelled rows the model has no language.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = settle(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("__size")))
    draw = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    drawn = labelled.select("text", "lang", F.shiftrightunsigned(draw, 1).alias("__draw")).join(sizes, "lang")
    chosen = drawn.filter(F.col("__draw") / F.lit(2.0**63) * F.col("__size") < sample_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((lang, w) for w in letter_words(text))
            langs, words = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"]
            )

    counted = chosen.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    per_word = counted.groupBy("word", "lang").agg(F.sum("n").alias("n"))
    per_word = settle(per_word.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")))
    quota = -(-most_words // max(1, sizes.count()))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    ranked = per_word.select("word", "by", F.explode("by").alias("lang", "n")).withColumn("place", place)
    words = {r.word: r.by for r in ranked.filter(F.col("place") <= quota).select("word", "by").collect()}
    langs = sorted({lang for by in words.values() for lang in by})
    grams: dict[str, Counter] = {}
    for word, by in words.items():
        for n in range(1, LONGEST + 1):
            for gram in grams_of(word, n):
                grams.setdefault(gram, Counter()).update(by)
    if len(grams) > most_grams:
        of_lang: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for gram, by in grams.items():
            for lang, n in by.items():
                of_lang[lang].append((-n, gram))
        most = -(-most_grams // len(langs))
        kept = {gram for found in of_lang.values() for _, gram in heapq.nsmallest(most, found)}
        grams = {g: by for g, by in grams.items() if g in kept}
    # A word seen once says little; it is left to its n-grams.
    known = {w: by for w, by in words.items() if sum(by.values()) > 1}
    word_rows, word_logs = _logs(known, langs)
    gram_rows, gram_logs = _logs(grams, langs)
    return Model(langs, word_rows, gram_rows, word_logs, gram_logs)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model

    def backed_off(self, word: str) -> list[int]:
        """Rows of the longest n-grams of which at least half are known; none if no length has."""
        get, framed = self.model.grams.get, f" {word} "
        for n in range(min(LONGEST, len(framed)), 0, -1):
            found = list(map(get, [framed[i : i + n] for i in range(len(framed) - n + 1)]))
            missing = found.count(None)
            if 2 * missing <= len(found):
                return [r for r in found if r is not None] if missing else found
        return []

    def score(self, words: list[str]) -> np.ndarray:
        """The sum of the words' rows; an unknown word's is the mean over its n-grams."""
        rows = np.fromiter(map(self.model.words.get, words, repeat(-1)), np.int64, len(words))
        seen = rows >= 0
        total = self.model.word_logs[rows[seen]].sum(axis=0)
        grams, shares = [], []
        for word, n in Counter(words[i] for i in np.flatnonzero(~seen).tolist()).items():
            if found := self.backed_off(word):
                grams += found
                shares += [n / len(found)] * len(found)
        if grams:
            total += np.array(shares) @ self.model.gram_logs[grams]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letter_words(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        # Words of a text are not independent: the square root of their number tempers the odds.
        mean = self.score(words) / np.sqrt(len(words))
        best = int(mean.argmax())
        return self.model.langs[best], float(1 / np.exp(mean - mean[best]).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1): a row per row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if the model
    has no language.  Ties between languages go to the first by name.  Rows that repeat a text
    have the same result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                lang, score = scorer.predict(text.as_py())
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
