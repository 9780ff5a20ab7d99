"""Collocations against a plain count over all texts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadgauge.llm import collocations as co

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string"


def brute(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in PIECE.split((text or "").translate(UPPER)):
            ws = WORD.findall(piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = []
        for p, a in found.items():
            if 100 * inside[p] >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        kept.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(kept[:top], 1)]
    return sorted(out)


def texts(seed, n, words=30):
    r = random.Random(seed)
    vocabulary = ["A", "the", "ünit", "Ünit", "x\x1cy", "\x00", "日本", "it's", "N"] + [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    seams = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "!?"]
    out = []
    for _ in range(n):
        said = r.choices(vocabulary, weights, k=r.randint(0, 60))
        if r.random() < 0.4:
            said[len(said) // 2 : len(said) // 2] = ["new", "york", "stock", "exchange", "rose", "again"]
        out.append("".join(w + r.choice(seams) for w in said))
    return out


@pytest.fixture(scope="module")
def rows():
    langs = ["en", "en", "en", "de", None, "a b\n", ""]
    found = [(i, t, langs[i % 7]) for i, t in enumerate(texts(1, 400))]
    return [*found, (1, None, "en"), (1, "", "en"), (None, found[0][1], "und"), (None, found[0][1], None), (9, "t " * 300 + "end", "de")]


def result(df, *args, **kwargs):
    return sorted(tuple(r) for r in co.collocations(df, *args, **kwargs).collect())


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.lit(1) for n in ("phrase", "word", "n", "f", "a", "id", "rank")})
    assert result(docs, min_count=12) == brute(rows, 12)
    assert len(brute(rows, 12)) > 50


def test_shards_and_cut_texts_change_nothing(spark, rows, monkeypatch):
    """Vocabulary, hashes and tries in several shards; every text cut into blocks of a few words."""
    for name, value in {"WORDS": 9, "HASHES": 20, "SEQUENCES": 16, "BLOCK_BYTES": 40, "HELD_BYTES": 60, "HELD_COUNTS": 50, "HELD_HASHES": 64}.items():
        monkeypatch.setattr(co, name, value)
    few = [row for row in rows if row[2] == "en"]
    assert result(spark.createDataFrame(few, DOCS).repartition(2), min_count=20, longest=4, top=40) == brute(few, 20, 4, 40)


def test_false_hits_of_hashes_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(co, "_in_bitmap", lambda bits, hashes: np.ones(len(hashes), bool))
    monkeypatch.setattr(co, "_mix", lambda x: x & np.uint64(7))
    few = rows[:60]
    assert result(spark.createDataFrame(few, DOCS), min_count=8, longest=3) == brute(few, 8, 3)


def test_nothing(spark):
    for rows in ([], [(1, None, None)], [(1, "a b a b", "en")]):
        assert result(spark.createDataFrame(rows, DOCS)) == []


def test_double_array():
    r = np.random.default_rng(3)
    for width, top, n in ((3, 5, 80), (4, 3000, 2000), (1, 50, 20), (6, 2, 60), (3, 100_000, 500)):
        rows = np.unique(r.integers(1, top + 1, (n, width)).astype(np.int32), axis=0)
        trie, ends = co.double_array(rows)
        assert len(set(ends.tolist())) == len(rows)
        asked = np.concatenate([rows, r.integers(1, top + 1, (500, width)).astype(np.int32)])
        states = np.ones(len(asked), np.int64)
        for column in asked.T:
            states = trie.step(states, column.astype(np.int64))
        known = {tuple(row): end for row, end in zip(rows.tolist(), ends.tolist(), strict=True)}
        assert states.tolist() == [known.get(tuple(row), 0) for row in asked.tolist()]


def test_trie_grows_with_its_sequences_not_with_the_numbers():
    r = np.random.default_rng(5)
    for top in (4000, 1 << 20, (1 << 31) - 1):
        # Many first numbers with several others behind them, all spread over the vocabulary.
        first, last = r.integers(1, top, 600), r.integers(1, top, 6000)
        rows = np.unique(np.column_stack([np.ones(6000, np.int64), r.choice(first, 6000), last]), axis=0).astype(np.int32)
        trie, ends = co.double_array(rows)
        assert len(trie.check) == len(trie.base) < 60_000
        asked = np.concatenate([rows, rows + 1, np.full((1, 3), top, np.int32), np.zeros((1, 3), np.int32), rows * np.array([1, 1, 0], np.int32)])
        states = np.ones(len(asked), np.int64)
        for column in asked.T:
            states = trie.step(states, column.astype(np.int64))
        known = {tuple(row): end for row, end in zip(rows.tolist(), ends.tolist(), strict=True)}
        assert states.tolist() == [known.get(tuple(row), 0) for row in asked.tolist()]
