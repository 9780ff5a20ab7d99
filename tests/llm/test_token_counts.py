"""Token counts by overlapping chunks against the library on whole texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loadgauge.llm import queries, token_counts
from loadgauge.llm.token_counts import GUARD, TokenCounter, count_tokens

ODD = [
    "a", "B", "the", "'s", "'", "s", "'ll", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", " ", "　", "1", "23", "½", "é",
    "é", "́", "İ", "Σ", "ΑΣ", "ß", "。", "か", "゙", "漢字", "!", "..", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
    "endoftext", "😀", "한", "ᄒ", "ᅡ", "ᆫ", "̸", "=", "-", "़", "क", "‍", "﻿",
]


@pytest.fixture(scope="module")
def counter():
    return TokenCounter()


def by_library(counter, text):
    return len(counter.tokenizer.encode(text or "", add_special_tokens=False))


def odd_text(r, n):
    return "".join(r.choices(ODD, k=n))


def test_short_texts_equal_the_library(counter):
    r = random.Random(1)
    texts = [odd_text(r, r.randint(0, 40)) for _ in range(4000)]
    assert counter.sizes(texts) == [by_library(counter, t) for t in texts]


class Recorded:
    """A tokenizer that remembers the texts given to the library."""

    def __init__(self, tokenizer):
        self.inner, self.texts = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch(self, texts, **options):
        self.texts += texts
        return self.inner.encode_batch(texts, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.inner.encode_batch_fast(texts, **options)


def test_runs_of_known_words_are_not_encoded_again(counter):
    recorded = TokenCounter(_tokenizer=Recorded(counter.tokenizer))
    texts = ["One, TWO: straße!! don't 42%", "Ошибка... (über) x1y2 ''s", "<|endoftext|>one two", "two漢字 İx"]
    assert recorded.sizes(texts) == [by_library(counter, t) for t in texts]
    assert set(recorded._tokenizer.texts) == {"<|endoftext|>one", "two漢字", "İx"}


def test_offsets_are_worked_out_only_about_the_overlaps(counter):
    """The same places and sums as with offsets of the whole chunk."""
    r = random.Random(5)
    plain = TokenCounter(spaced=False)
    recorded = TokenCounter(_tokenizer=Recorded(counter.tokenizer))
    piece = " ".join("".join(r.choices("abcdeé,'", k=r.randint(1, 9))) for _ in range(3000))
    ranges = [(GUARD, 128 - GUARD + 1), (len(piece) - 128 + GUARD, len(piece) - GUARD + 1)]
    listed = lambda found: (found[0], [(a.tolist(), n.tolist()) for a, n in found[1]])
    assert listed(recorded.places(piece, ranges)) == listed(plain.places(piece, ranges))
    assert sum(map(len, recorded._tokenizer.texts)) < 400 < len(piece)
    for _ in range(300):  # ranges that meet, or hold no space, or lie at the ends
        text = odd_text(r, r.randint(0, 80))
        ends = sorted(r.randint(0, len(text)) for _ in range(4))
        ranges = [(ends[0], ends[1]), (ends[r.choice((0, 1, 2))], ends[3])]
        assert listed(counter.places(text, ranges)) == listed(plain.places(text, ranges))


def test_plain_signs_are_lowered_and_split_as_by_the_library(counter):
    normalize, split = counter.tokenizer.normalizer.normalize_str, counter.tokenizer.pre_tokenizer.pre_tokenize_str
    plain = [chr(i) for i in range(0x21, 0x10000) if not 0xD800 <= i < 0xE000 and token_counts._is_plain(chr(i))]
    assert len(plain) > 300
    for sign in plain:
        assert normalize(sign) == sign.lower() and len(sign.lower()) == 1
        for word in (sign.lower() + other for other in "x1!'é"):
            assert len(token_counts._matches(word)) == len(split(word))
            assert len(token_counts._matches(word[::-1])) == len(split(word[::-1]))


def test_what_a_task_remembers_is_bounded(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_RUNS", 50)
    r = random.Random(6)
    texts = ["".join(r.choices("abc ,1é", k=200)) + "x" * 3000 for _ in range(20)]
    bounded = TokenCounter()
    assert bounded.sizes(texts) == [by_library(counter, t) for t in texts]
    assert len(bounded._known) <= 50 and max(map(len, bounded._known)) <= token_counts.KNOWN_LENGTH


def test_every_place_reported_splits_a_text_as_the_whole(counter):
    """Whatever stands around a place: the tokens before it are those of the text before it."""
    r = random.Random(2)
    for _ in range(400):
        text = odd_text(r, 60)
        size, ((at, before),) = counter.places(text, [(GUARD, len(text) - GUARD)])
        assert size == by_library(counter, text)
        for place, n in zip(at.tolist(), before.tolist(), strict=True):
            assert n == by_library(counter, text[:place]) and size - n == by_library(counter, text[place:])


def test_operator_equals_the_library(spark, counter):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh'é", k=r.randint(1, 9))) for _ in range(n))
    long = prose(2500)
    rows = [
        (1, long), (2, long), (2, "other"), (None, None), (None, "null id"), (3, ""), (4, " \n "), (5, "x" * 5000), (6, "漢字。" * 3000),
        (7, odd_text(r, 4000)), (8, prose(100) + "y" * 3000 + prose(400)), (9, "<|endoftext|>" * 900), (10, "1" * 1100), (11, "漢" * 4000),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(7) for n in ("__digest", "__pieced", "size", "N_Tokens")})
    found = count_tokens(docs, chunk=1024, overlap=128).collect()
    assert set(found[0].asDict()) == {"doc_id", "__digest", "__pieced", "size", "n_bytes", "n_tokens", "over_limit"}
    want = [(i, len((t or "").encode()), by_library(counter, t)) for i, t in rows]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(x.doc_id, x.n_bytes, x.n_tokens) for x in found], key=key) == sorted(want, key=key)
    assert all(x.over_limit == (x.n_tokens > 2048) for x in found)


def test_overlaps_without_a_place_are_widened(spark, counter, monkeypatch):
    tried = []
    inner = token_counts._pieces
    monkeypatch.setattr(token_counts, "_pieces", lambda texts, chunk, overlap: tried.append(overlap) or inner(texts, chunk, overlap))
    text = "ab " * 300 + "x" * 900 + " cd" * 300
    found = count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), chunk=512, overlap=96).collect()
    assert found[0].n_tokens == by_library(counter, text) and len(tried) > 1


def test_no_rows(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_the_library(spark, sf_dir, counter):
    found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in queries.op11_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found == {d.doc_id: (len((d.text or "").encode()), by_library(counter, d.text)) for d in docs}
