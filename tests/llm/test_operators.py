"""The training-data operators against brute force and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from checks.compare import _rows, connect
from loadgauge.llm import chat, components, html_blocks, html_extract, language, mixing, neighbours, oracles, pieces, quality, queries
from loadgauge.llm import simhash, substrings, warc
from loadgauge.llm.common import n_words_of, one_row_per_id, with_row_key, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def doc_table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty, blank and very long texts, copies, repeated rows, a null id and a null source."""
    passage = prose(1, 70)
    rows = [
        (1, prose(2, 120) + " " + passage, "a"), (2, passage + " " + prose(3, 90), "a"), (3, None, "b"), (4, "", None),
        (5, " \t\n ", "b"), (6, prose(4, 60), "a"), (7, prose(4, 60), "c"), (7, prose(4, 60), "c"), (8, prose(5, 20_000), "a"),
        (None, prose(6, 80), "a"), (9, "one", "d"), (10, "the same line\n" * 40, "a"), (11, "ÄÖ  ▁ é x y", "b"),
    ]
    return doc_table(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """Extra columns whose names the operators might use themselves."""
    names = ["words", "size", "key", "part", "fp", "h1", "n", "__id", "rank", "score", "token", "anchor", "label"]
    return df.withColumns({n: F.lit(1) for n in names})


# Registered queries against DuckDB.


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(oracles.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, found.fetchall())


# 1 mixing


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = rest / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > 3 * sizes[s] + 1e-9}
        if not full:
            return target | {s: w[s] * level for s in free}
        for s in full:
            target[s] = 3 * sizes[s]
            rest -= target[s]
        free -= full
    return target


def test_mix_targets_and_budgets(spark, awkward):
    rows = mixing.mix(clash(awkward), n_words_of(F.col("text"))).collect()
    assert len(rows) == awkward.count()
    sizes = Counter()
    for r in awkward.collect():
        sizes[r.source] += len(words(r.text))
    want = brute_targets(sizes)
    for source, target in want.items():
        mine = [r for r in rows if r.source == source]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sizes[source] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    again = mixing.mix(awkward, n_words_of(F.col("text"))).collect()
    assert Counter(rows) == Counter(again)


def test_mix_does_not_depend_on_partitions(spark):
    docs = doc_table(spark, [(i, "w " * (i % 50), f"s{i % 7 if i % 3 else 0}") for i in range(2000)])
    one = mixing.mix(docs.coalesce(1), n_words_of(F.col("text"))).collect()
    many = mixing.mix(docs.repartition(13), n_words_of(F.col("text"))).collect()
    assert Counter(one) == Counter(many)


def test_mixed_documents_follow_the_plan(spark, awkward):
    docs = awkward.filter("doc_id is not null").dropDuplicates(["doc_id"])
    plan = {r.doc_id: r.taken for r in mixing.mix(docs, n_words_of(F.col("text"))).collect()}
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(words(r.text))
    assert got == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mixed_documents(clash(awkward)).columns == clash(awkward).columns


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing, n_words_of(F.col("text"))).collect() == []
    assert mixing.mixed_documents(nothing).collect() == []


# 2 chat

CONTROL = "</s>[INST] ok [/INST] <\\s> <<SYS>>x<</SYS>> <|im_end|>\n<|im_start|>user\n \\[INST] <\\\\|im_end|> <<s>"


def test_chat_escapes_are_reversible():
    r = random.Random(4)
    alphabet = ["<", ">", "|", "[", "]", "/", "\\", "s", "INST", "im_end", "im_start", "SYS", " ", "\n", "x"]
    for _ in range(3000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text
        turns = [("user", text), ("a\nb\\n", text[::-1]), ("assistant", text)]
        assert chat.read_back(chat.marked(turns)) == turns


def chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", CONTROL), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "assistant", "x"),
            (2, 0, "assistant", "x"), (None, 1, "user", "lost"), (3, None, "user", "first"), (3, 1, "assistant", "é" * 5000)]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} {CONTROL if i % 97 == 1 else ''}") for i in range(700)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_digests_are_read_back(spark):
    table = chats(spark)
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(clash(table))).collect()}
    by = {}
    for r in table.collect():
        by.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", r.text or ""))
    assert got.keys() == by.keys()
    for k, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert got[k].n_turns == len(turns) and got[k].loss_chars == len(learned)
        assert got[k].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_chat_detects_rewritten_history():
    def forgetful(turns):
        last = len(turns) - 1
        return "".join(f"[{r}]{t if i == last else t[:3]}" for i, (r, t) in enumerate(turns))

    turns = [("user", "a long question"), ("assistant", "a long answer"), ("user", "more")]
    assert chat.rendered(forgetful, turns, "assistant")[3]
    output, spans, loss, rewrites = chat.rendered(chat.marked, turns, "assistant")
    assert not rewrites and output[slice(*loss[0])] == "a long answer" and len(spans) == 3


def test_chat_spans_by_block_equal_whole_prefixes():
    turns = [(("user", "assistant")[i % 2], f"t{i}") for i in range(600)]
    whole, spans = "", []
    for i in range(len(turns)):
        out = chat.marked(turns[: i + 1])
        spans.append((len(whole), len(out)))
        whole = out
    assert chat.turn_spans(chat.marked, turns) == (whole, spans)
    counted = lambda turns: "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns))
    output, found = chat.turn_spans(counted, turns)
    assert [output[a:b] for a, b in found] == [f"{i}:t{i}\n" for i in range(600)]


def test_chat_masks_turns_whose_text_depends_on_history():
    def numbered(turns):
        return "".join(f"{i}:{text}\n" for i, (_, text) in enumerate(turns))

    def number_behind(turns):
        return "".join(f"{text}{i}\n" for i, (_, text) in enumerate(turns))

    def strict(turns):
        if any(role != ("user", "assistant")[i % 2] for i, (role, _) in enumerate(turns)):
            raise ValueError("roles must alternate")
        return chat.marked(turns)

    for n in (400, 600):
        turns = [(("user", "assistant")[i % 2], f"says {i}") for i in range(n)]
        for template in (numbered, number_behind, strict):
            output, spans, loss, rewrites = chat.rendered(template, turns, "assistant")
            assert not rewrites and len(spans) == n
            assert [output[a:b] for a, b in loss] == [text for role, text in turns if role == "assistant"]
    with pytest.raises(ValueError, match="turn 1 "):
        chat.rendered(lambda turns: "".join(f"{text[::-1]}!{len(text)}\n" for _, text in turns), [("user", "ab"), ("assistant", "cd")], "assistant")


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(empty)).collect() == []


# 3 WARC


def test_warc_round_trip(spark):
    big = "".join(f"<p>é{i}</p>\r\n\r\n" for i in range(9000))
    rows = [(3, "http://a b/\r\nX: y", "x" * 100), (1, None, "x" * 100), (2, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None),
            (6, "u", ""), (7, "u", big), (8, "u", big), (9, "u", "é" * 50), (10, "u", "é" * 50), (10, "u", "é" * 50), (None, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archived(clash(pages)).collect()}
    assert got.keys() == {r[0] for r in rows}
    first = {3: 1, 8: 7, 10: 9}
    for page, _, html in rows:
        if page is not None:
            payload = (html or "").encode()
            r = got[page]
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.record_type, r.refers_to) == (("revisit", first[page]) if page in first else ("response", None))
            assert r.damage is None
    assert warc.archived(pages.limit(0)).collect() == []


def test_warc_damage_is_told(spark):
    block = warc._HTTP + warc.chunked(b"y" * 50)
    whole = [(1, block[:80]), (2, block[80:])]
    cases = {"ok": (whole, len(block)), "gap": ([whole[0]], len(block)), "long": (whole, len(block) + 1), "none": (whole, None)}
    rows = [(k, 1, n, b, t if n == 2 or len(parts) == 1 else None) for k, (parts, t) in cases.items() for n, b in parts]
    table = spark.createDataFrame(rows, "origin string, page_id long, segment int, block binary, total long")
    got = {r.record_id: r for r in warc.reassembled(table).collect()}
    assert got["ok"].damage is None and got["ok"].payload_bytes == 50
    assert all(got[k].damage for k in ("gap", "long", "none"))
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# 4 neighbours


def test_nearest_with_copies_and_ties(spark):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(900, 24)).astype(np.float32)
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] + [1.0] * 23), (2060, [1.0]), (2080, []), (None, [1.0] * 24),
             (2100, [None] + [1.0] * 23), (840, vectors[840].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in neighbours.nearest(clash(table)).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    assert got.keys() == set(range(0, 900, 20))
    exact = vectors.astype(np.float64)
    hits = 0
    for q, found in got.items():
        score = exact @ exact[q]
        order = [i for i in np.lexsort((np.arange(900), -score)) if i != q][:20]
        assert sorted(found) == list(range(1, 21))
        assert all(abs(s - score[i]) < 1e-9 for i, s in found.values())
        hits += len({i for i, _ in found.values()} & set(order))
    assert hits >= 0.95 * 20 * len(got)
    few = {x.vec_id for x in neighbours.nearest(table.filter("vec_id < 5")).collect()}
    assert few == {1, 2, 3, 4}
    assert neighbours.nearest(table.limit(0)).collect() == []


# 5 quality


def brute_quality(text):
    w = words(text)
    n = len(w)
    where = {}
    for i in range(n - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {k for at in where.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_counts(spark, awkward):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.quality_report(clash(awkward)).collect())
    assert got == Counter((r.doc_id, *brute_quality(r.text)) for r in awkward.collect())


def test_quality_verdict_does_not_depend_on_the_order(spark, awkward):
    rows = awkward.withColumn("w", words_of(F.col("text")))
    rules = quality.content_rules(F.col("text"), F.col("w"), F.size("w"))
    passed = [rows.filter(quality.first_failure(r).isNull()).count() for r in (rules, rules[::-1])]
    assert passed[0] == passed[1]
    kept = {r.doc_id for r in quality.good_documents(clash(awkward)).collect()}
    assert 6 in kept and 8 in kept and not kept & {3, 4, 5, 9, 10}


def test_quality_order_is_rejection_per_cost(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id as string) as text")
    cheap = quality.Rule("cheap", F.col("id") < 900)
    same = quality.Rule("same", F.col("id") < 899)
    other = quality.Rule("other", F.col("id") >= 950)
    assert [r.name for r in quality.order_rules(rows, [other, same, cheap])][1:2] != ["same"]
    assert [r.name for r in quality.order_rules(rows.limit(0), [other, same])] == ["other", "same"]


def test_quality_keeps_clean_texts_of_any_script(spark):
    def many(alphabet, shortest, longest, seed=1, n=60):
        r = random.Random(seed)
        return " ".join("".join(r.choices(alphabet, k=r.randint(shortest, longest))) for _ in range(n))

    good = [
        "GPS NATO " + many("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", 3, 8), "GPS NATO " + many("कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह", 3, 8),
        "GPS NATO " + many("가나다라마바사아자차카타파하", 2, 4), "GPS " + many("的一是不了人我在有他这中大来上国", 16, 30),
        many("あいうえおかきくけこアイウエオカ日本語ー", 16, 30), many("กขคงจฉชซญดตถทธนบปผพภมยรลวสห", 16, 40),
    ]
    bad = [many("ABCDEFGH", 3, 8), many("abcdefgh", 16, 30), many("abcdefgh", 1, 1), "的 " + many("abcdefgh", 16, 30)]
    docs = doc_table(spark, [(i, t, "web") for i, t in enumerate(good + bad)])
    assert {r.doc_id for r in quality.good_documents(docs).collect()} == set(range(len(good)))
    assert {r.doc_id for r in quality.quality_report(docs).filter("kept").collect()} == set(range(len(good)))


def test_quality_of_nothing(nothing):
    assert quality.quality_report(nothing).collect() == [] and quality.good_documents(nothing).collect() == []


# 6 substrings


def brute_substrings(rows, k=50):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        w = words(text)
        keep = [True] * len(w)
        for i in range(len(w) - k + 1):
            if seen.setdefault(tuple(w[i : i + k]), doc) < doc:
                keep[i : i + k] = [False] * k
        kept = [x for x, stay in zip(w, keep, strict=True) if stay]
        out[doc] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substrings_equal_brute_force(spark, awkward):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeat_report(clash(awkward)).collect()}
    rows = {r.doc_id: r.text for r in awkward.collect()}
    none = rows.pop(None)
    assert got.pop(None) == (len(words(none)), 0, hashlib.sha256(none.encode()).hexdigest())
    assert got == brute_substrings(rows.items())
    assert got[2][1] == 70 and got[7][1] == 60


def test_substrings_of_overlapping_copies(spark):
    r, base = random.Random(8), prose(9, 400).split()
    rows = []
    for i in range(120):
        a = r.randrange(300)
        cut = base[a : a + r.randint(40, 100)]
        if r.random() < 0.5:
            cut[r.randrange(len(cut))] = "changed"
        rows.append((i, " ".join(prose(100 + i, r.randint(0, 60)).split() + cut + prose(500 + i, 30).split()), "s"))
    rows.append((500, "again " * 300, "s"))
    rows.append((501, "again " * 120, "s"))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.repeat_report(doc_table(spark, rows)).collect()}
    assert got == brute_substrings([(i, t) for i, t, _ in rows])


def test_substring_stage_keeps_what_is_new(spark, awkward, nothing):
    kept = {r.doc_id: r.text for r in substrings.cut_documents(clash(awkward)).collect()}
    assert 7 not in kept and len(words(kept[2])) == 90 and len(words(kept[8])) == 20_000
    assert substrings.cut_documents(nothing).collect() == [] and substrings.repeat_report(nothing).collect() == []


# 7 language


def labelled(spark):
    parts = {"en": ("the and of ing tion", 1), "de": ("der und sch keit ung", 2), "fr": ("les que eau ment oux", 3)}
    rows = []
    for i in range(300):
        lang = list(parts)[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choices(parts[lang][0].split(), k=r.randint(1, 3))) for _ in range(30)), lang))
    return rows


def test_language_of_held_out_texts(spark):
    rows = labelled(spark)
    odd = [(1000, None, "en"), (1001, "12 34 --", "en"), (1002, "", None), (None, "der und schkeit", None), (1003, "derung " * 30_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.langs == ["de", "en", "fr"]
    got = {r.doc_id: r for r in language.predict(clash(docs), model).collect()}
    held = {r.doc_id for r in docs.filter(language.held_out(F.col("doc_id"))).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows if i in held) >= 0.98 * len([r for r in rows if r[0] in held])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_backs_off_to_shorter_grams(spark):
    docs = spark.createDataFrame(labelled(spark), "doc_id long, text string, lang string")
    scorer = language.Scorer(language.train(docs))
    assert scorer.backed_off("schungtion") and scorer.backed_off("zzzz") == []
    assert scorer.predict("zzzz qqq")[0] in scorer.model.langs


def test_language_knows_rare_languages(spark):
    def text(alphabet, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choices(alphabet, k=r.randint(2, 5))) for _ in range(30))

    common, rare = "abcdefgh", "klmnopqr"
    rows = [(i if i % 2 else None, text(common, i), "aa") for i in range(3000)] + [(None, text(rare, -i), "bb") for i in range(1, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, sample_docs=40, most_words=400, most_grams=400)
    assert model.langs == ["aa", "bb"] and len(model.grams) <= 400
    scorer = language.Scorer(model)
    assert all(scorer.predict(text(rare, 10_000 + i))[0] == "bb" and scorer.predict(text(common, 10_000 + i))[0] == "aa" for i in range(20))
    # About 40 documents of the common language, not none or all of those without id.
    counts = np.exp(language.train(docs, sample_docs=300).word_logs).shape[0]
    assert 0 < counts < np.exp(language.train(docs, sample_docs=10_000).word_logs).shape[0]


def test_language_without_labels(spark, nothing):
    model = language.train(nothing)
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.predict(docs, model).collect()] == [("und", 0.0)]
    assert language.predict(nothing, model).collect() == []


# 8 pieces

MODEL = Path(pieces.MODEL)
needs_model = pytest.mark.skipif(not MODEL.exists(), reason="no vocabulary file")
TEXTS = ["Hello  world", " x", "a\nb\tc", "  ", "", "é́ ﬁ", "日本語 🙂", "a" * 300 + "  bcd " * 20, " " * 130, "   日   x    ", prose(3, 400)]


@needs_model
def test_pieces_without_dropout_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=str(MODEL))
    ids, counts = pieces.Encoder(pieces.load_vocabulary(), 0.0).texts(TEXTS, np.arange(len(TEXTS), dtype=np.uint64))
    ends = np.cumsum(counts)
    for text, end, n in zip(TEXTS, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == library.encode(text)


@needs_model
def test_pieces_decode_whatever_is_dropped(spark):
    texts = [*TEXTS, "a▁b ▁ x", "\u0000\U0001f600", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for dropout in (0.1, 0.9):
        rows = pieces.encode(clash(docs), dropout=dropout)
        back = {r.doc_id: r.text for r in pieces.decode(rows).collect()}
        assert back == dict(enumerate(texts))
        assert all(r.decodes or r.token_ids is None for r in rows.collect())
    assert pieces.encode(docs.limit(0)).collect() == []


@needs_model
def test_pieces_vary_by_key_and_repeat_by_seed():
    encoder = pieces.Encoder(pieces.load_vocabulary(), 0.3, seed=1)
    text = "the nation and the station " * 50
    one = encoder.texts([text], np.array([1], np.uint64))[0]
    assert (one == encoder.texts([text], np.array([1], np.uint64))[0]).all()
    other = encoder.texts([text], np.array([2], np.uint64))[0]
    assert len(one) != len(other) or (one != other).any()
    chunks = [" " + w for w in TEXTS[-1].split()] + [" " * 20 + "abc the"]
    variants = np.arange(len(chunks)) % 4
    flat, starts, counts = encoder.words(chunks, variants)
    for chunk, v, s, n in zip(chunks, variants, starts, counts, strict=True):
        assert flat[s : s + n].tolist() == encoder.long_word(chunk, int(v))


@needs_model
def test_pieces_drop_per_occurrence(spark):
    encoder = pieces.Encoder(pieces.load_vocabulary(), 0.1, seed=1)
    plain = pieces.Encoder(pieces.load_vocabulary(), 0.0)
    salts = np.array([5, 9], np.uint64)
    keys = pieces._mix(salts[:, None] + np.arange(3000, dtype=np.uint64))
    for word in (" of", " the", " station", " " + "ab" * 30):
        n = 3000 if len(word) < pieces.LONG else 5
        ids, counts = encoder.texts([(word * n)[1:]] * 2, salts)
        want = [encoder.long_word(word, int(k)) for k in keys[:, :n].ravel()]
        assert ids.tolist() == [i for x in want for i in x] and counts.sum() == len(ids)
        if n == 3000:
            whole = plain.long_word(word, 0)
            share = sum(x == whole for x in want) / len(want)
            least = 0.9 ** (len(word) - len(whole))
            assert least - 0.03 < share < 0.98  # other merges may lead to the same pieces
    docs = spark.createDataFrame([(None, "of " * 200), (None, "of " * 200 + "x")], "doc_id long, text string")
    a, b = [r.token_ids for r in pieces.encode(docs).collect()]
    assert a[:200] != b[:200]


# 9 SimHash


def brute_fingerprint(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups_equal_brute_force(spark):
    r, rows = random.Random(5), [(0, None, "s"), (1, "", "s"), (2, "ÄB Cd", "s"), (3, "ÄB cD", "s"), (4, " \t", "s")]
    for k in range(30):
        base = prose(k, 150).split()
        for j in range(r.randint(1, 9)):
            text = list(base)
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = "other"
            rows.append((10 + 20 * k + j, " ".join(text).upper() if j == 3 else " ".join(text), "s"))
    got = {x.doc_id: x for x in simhash.near_duplicates(clash(doc_table(spark, rows))).collect()}
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {i: x.fp % 2**64 for i, x in got.items()} == fps
    assert {i: x.component_id for i, x in got.items()} == brute_components(fps)


def test_dense_groups_leave_few_links():
    r = np.random.default_rng(3)
    centre = r.integers(0, 2**63, dtype=np.uint64)
    flips = (np.uint64(1) << r.integers(0, 40, (3000, 2)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    fps = np.unique(centre ^ flips)
    links = simhash.forest(fps)
    assert len(links) < len(fps)
    a, b = simhash.links_of_keys(np.zeros(len(fps), np.int64), fps)
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(set(a) | set(b)) == len(fps)


@pytest.mark.parametrize("flipped", [(0, 1, 2, 3), (0, 21, 42, 63), (20, 21, 41, 42), (5,), ()])
def test_variant_keys_meet(spark, flipped):
    fp = 0x0123456789ABCDEF
    other = fp ^ sum(1 << b for b in flipped)
    rows = spark.createDataFrame([(0, fp), (1, other - 2**64 if other >= 2**63 else other)], "i int, fp long")
    keys = [{x.k for x in rows.filter(f"i = {i}").select(simhash.variant_keys(F.col("fp")).alias("k")).collect()} for i in (0, 1)]
    assert len(keys[0]) == 64 and keys[0] & keys[1]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 100 + i) for i in range(50)]
    links = spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")
    got = {r.id: r.component_id for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [1000, *range(100, 150)]}
    assert components.components(links.limit(0)).collect() == []


def test_one_of_each_group(spark, awkward, nothing):
    kept = [r.doc_id for r in simhash.one_of_each_group(clash(awkward)).collect()]
    assert sorted(kept, key=str) == [1, 10, 11, 2, 3, 6, 8, 9, None]
    assert simhash.near_duplicates(nothing).collect() == []


# 10 HTML

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>x";</script></head><body>'
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>'
    "<article><h1>A title &amp; more</h1><p><b>First\n  words.<br>Then more<p>Second &eacute; one, and so on.</p>"
    '<aside class="related"><a href="/c">Read this</a></aside><p>Third paragraph of the text, long enough.</p></article>'
    '<section class="comments"><h3>Comments</h3><p>I do not agree.</p></section><form><label>Mail</label><button>Send</button></form>'
    "<footer>&copy; someone</footer></body></html>"
)


@pytest.fixture(scope="module")
def weights():
    words_seen = sorted(set(prose(11, 900).split()))
    return html_extract.fit(*html_extract.training_set(words_seen, 500))


def test_leaves_of_broken_pages():
    texts = lambda page: [x.text for x in html_blocks.leaves_of(page)]
    assert texts("") == [] and texts("a < b <3 &lt;c") == ["a < b <3 <c"]
    assert texts("<p>a<b>b</p><p>c <!-- x <p>") == ["ab", "c"]
    assert texts('<a href="x>y</a> tail <p>z') == ["y tail", "z"]
    assert texts("<li>a<li>b<div>c<script>never") == ["a", "b", "c"]
    assert len(texts("<div>" * 3000 + "x" + "</div>" * 10)) == 1
    assert texts("<p " * 20_000) == []


def test_leaves_keep_text_behind_faults():
    def texts(page):
        return [x.text for x in html_blocks.leaves_of(page)]

    assert texts("<p title=John's>Main text. I don't know.</p><p>b</p>") == ["Main text. I don't know.", "b"]
    assert texts("<p title = 'a>b' x=\"c>d\">Text</p><a href=x?y=\"z>more</a>") == ["Text", "more"]
    for tag in ("svg", "math", "video", "audio", "object", "canvas"):
        assert texts(f"<p>a</p><{tag} x=1><p>b</p>") == ["a", "b"]
        assert texts(f"<p>a</p><{tag}></{tag}><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><script>if (a < b) <p>b</p>") == ["a"]
    assert texts("<p>As <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><xmp><b>&amp;</b></xmp><p>c</p>") == ["As x=1 holds", "<b>&amp;</b>", "c"]


def test_main_text_of_a_page(spark, weights):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p></p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(clash(pages), weights).collect()
    want = "A title & more\n\nFirst words. Then more\n\nSecond é one, and so on.\n\nThird paragraph of the text, long enough."
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter(
        {(1, want, len(want)): 2, (2, "", 0): 1, (3, "", 0): 1, (None, "", 0): 1}
    )
    assert html_extract.extract(pages.limit(0), weights).collect() == []


def test_labeller_on_unseen_layouts(weights):
    pages, labels = html_extract.training_set(sorted(set(prose(12, 900).split())), 150, seed=91)
    x, mask = html_extract.padded(pages)
    p = html_extract.chances(weights, x, mask)
    right = [((p[: len(y), i] > 0.5) == (y > 0.5)) for i, y in enumerate(labels)]
    assert np.concatenate(right).mean() > 0.95


def test_labeller_gradients_are_those_of_the_loss():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in html_extract.new_weights(1, hidden=3, dim=4).items()}
    x, mask = html_extract.padded([r.normal(size=(n, 4)) for n in (5, 3)])
    y = (r.random(mask.shape) > 0.5).astype(np.float64)
    _, g = html_extract.gradients(w, x, mask, y)
    for name in w:
        at = tuple(0 for _ in w[name].shape)
        for sign in (1, -1):
            w[name][at] += sign * 1e-2
            g[name + str(sign)] = html_extract.gradients(w, x, mask, y)[0]
            w[name][at] -= sign * 1e-2
        slope = (g[name + "1"] - g[name + "-1"]) / 2e-2
        assert abs(slope - g[name][at]) < 5e-4 + 0.03 * abs(slope)


def test_real_pages_are_learned(spark, sf_dir):
    got = queries.op10_main_text(spark, sf_dir).collect()
    for r, page in zip(sorted(got), sorted(spark.read.parquet(f"{sf_dir}/pages.parquet").collect()), strict=True):
        inside = [x.text for x in html_blocks.leaves_of(page.html) if "article" in x.tags]
        assert r.text == "\n\n".join(inside)


# Shared helpers


def test_one_row_per_id(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, None, 3), (2, "x", 4), (None, "n", 5), (None, "n", 5)], "i long, t string, k int")
    got = Counter((r.i, r.t, r.k) for r in one_row_per_id(rows, "i", "t").collect())
    assert got == Counter({(1, None, 3): 1, (2, "x", 4): 1, (None, "n", 5): 2})


@pytest.fixture(scope="module")
def doubtful(spark):
    """Different texts without an id and under one id, beside copies of each kind."""
    texts = [(None, 1), (None, 2), (None, 2), (5, 3), (5, 4), (5, 4), (6, 5), (7, 5), (7, 6), (None, 5)]
    return doc_table(spark, [(i, prose(40 + t, 90), "a") for i, t in texts])


def test_row_keys(spark, doubtful, awkward):
    rows = with_row_key(doubtful, "doc_id", "k").orderBy("k").collect()
    assert len({r.k for r in rows}) == 10 and [r.doc_id for r in rows] == [5, 5, 5, 6, 7, 7, None, None, None, None]
    assert Counter(r[:-1] for r in rows) == Counter(tuple(r) for r in doubtful.collect())
    other = with_row_key(doubtful.repartition(7), "doc_id", "k").orderBy("k").drop("k").collect()
    assert [tuple(r) for r in other] == [tuple(r)[:-1] for r in rows]
    plain = doubtful.filter("doc_id = 6")
    assert with_row_key(plain, "doc_id", "k").collect()[0].k == 6


def test_no_row_is_lost_by_its_id(spark, doubtful):
    kept = simhash.one_of_each_group(clash(doubtful)).collect()
    assert Counter(r.text for r in kept) == Counter({prose(40 + t, 90): 1 for t in range(1, 7)})
    assert {r.doc_id for r in kept if r.text == prose(45, 90)} == {6}
    cut = substrings.cut_documents(clash(doubtful)).collect()
    assert Counter(r.text for r in cut) == Counter(r.text for r in kept)
    report = substrings.repeat_report(clash(doubtful)).collect()
    assert len(report) == 10 and sum(r.n_removed for r in report) == 4 * 90
    mixed = Counter()
    for r in mixing.mixed_documents(clash(doubtful)).collect():
        mixed[r.text] += 1
    assert mixed == Counter(r.text for r in doubtful.collect())  # one source, all of it once


def test_warc_has_a_record_for_every_row(spark, doubtful):
    pages = doubtful.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    found = con.execute(oracles.ORACLES["op3_warc"])
    names = [d[0] for d in found.description]
    got = warc.archived(clash(pages)).drop("damage")
    assert _rows(got.columns, got.collect()) == _rows(names, found.fetchall())
    assert warc.archived(pages).filter("damage is not null").count() == 0


def test_pages_lose_and_leak_no_text():
    texts = lambda page: [x.text for x in html_blocks.leaves_of(page)]
    assert texts("<p>One İ.</p><SCRIPT>bad()</SCRIPT><p>Two</p>") == ["One İ.", "Two"]
    assert texts("<p>a</p><script src=x />var secret=1;</script><p>b</p>") == ["a", "b"]
    assert texts("<title/>never</title><p>b") == ["b"]
    assert texts("<p>a</p><object><object>a</object>leak</object><p>b</p>") == ["a", "b"]
    assert texts("<p>a <svg/> b <svg><svg/><text>no</text></svg> c</p>") == ["a b c"]
    assert texts("<p>a</p><object><p>b <object>no</object> c") == ["a", "b c"]
    assert texts("<script>x</scripts>y</script>z") == ["z"]


def test_deep_pages_take_linear_time():
    begin = time.perf_counter()
    leaves = html_blocks.leaves_of("<div><font>x" * 50_000)
    assert len(leaves) == 50_000 and time.perf_counter() - begin < 4
    leaves = html_blocks.leaves_of("<object>x" * 50_000 + "<ul><li>a<li>b</ul>" + "</div>" * 1000)
    assert [x.text for x in leaves[-2:]] == ["a", "b"] and time.perf_counter() - begin < 8


def test_letters_are_letters():
    assert language.letter_words("½ ² ① 12 _ ٣") == []
    assert language.letter_words("हिन्दी Été cafe\u0301 x2y") == ["हिन्दी", "été", "cafe\u0301", "x", "y"]
