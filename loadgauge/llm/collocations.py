"""Phrases of two to five words that occur together more often than their parts let expect.

Texts become blocks of word numbers once; only words that are frequent in some language have one.
Phrases are then counted length by length.  A phrase is a candidate if the two phrases one word
shorter inside it are frequent (Apriori) and if the occurrences that share its hash are many enough;
neither test ever misses a frequent phrase.  Candidates go to all tasks as a double-array trie over the
digits of the word numbers, so its size follows from the candidates, not from the vocabulary: numpy
takes all text positions one level down at a time, drops those that fall out, and counts the states that
the rest end in; the tasks' counts are summed.

What is sent to all tasks is bounded by parameters, whatever the corpus: words, hashes and
candidates beyond a bound go out in further shards, each with a pass of its own over the blocks, and the
frequent phrases that Apriori asks for are a bitmap of fixed size, whose false hits only
add candidates.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.plans.joining import settle

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
NO_LANG = "und"

WORDS = 1 << 20  # words of a shard of the vocabulary
HASHES = 1 << 22  # hashes of a shard of frequent ones
SEQUENCES = 1 << 18  # candidates of one trie
DIGIT_BITS = 9  # a trie takes numbers digit by digit, of at most so many bits
SLICE = 1 << 12  # states whose counts travel together
BITS = 24  # the bitmaps of frequent phrases have 2^24 bits
BLOCK_BYTES = 1 << 17
HELD_BYTES = 1 << 22  # texts of all languages that a task holds back to fill blocks
HELD_COUNTS = 1 << 16  # distinct words or phrases that a task adds up before it sends them
HELD_HASHES = 1 << 19

# Bytes that UTF-8 never has: a break between pieces, and the mark of a language's entry.
_BREAK, _LANG = b"\xff", b"\xfe"
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else c for c in range(256))


# Blocks of words.


def _normal(text: str) -> bytes:
    """Lower case for A-Z, breaks as words of their own, words apart by spaces."""
    return text.encode().lower().translate(_TABLE).replace(_BREAK, b" \xff ")


def word_blocks(rows: Iterator[tuple[str, str]], carry: int) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words and breaks, how many of them an earlier block has counted) of (lang, text) rows.

    Short texts of a language share a block.  A long one is cut between words, and each further block
    begins with the last ``carry`` words of the one before.
    """
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()

    def flush(lang: str) -> tuple[str, list[bytes], int]:
        sizes.pop(lang)
        return lang, b" \xff ".join(held.pop(lang)).split(), 0

    for lang, text in rows:
        data = _normal(text)
        if len(data) <= BLOCK_BYTES:
            held.setdefault(lang, []).append(data)
            sizes[lang] += len(data) + 3
            if sizes[lang] > BLOCK_BYTES:
                yield flush(lang)
            elif sizes.total() > HELD_BYTES:
                yield from [flush(every) for every in list(held)]
            continue
        begin, last = 0, []
        while begin < len(data):
            end = data.find(b" ", begin + BLOCK_BYTES)
            end = len(data) if end < 0 else end
            words = last + data[begin:end].split()
            yield lang, words, len(last)
            begin, last = end, words[-carry:] if carry else []
    yield from [flush(lang) for lang in list(held)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            yield lang.as_py(), text.as_py()


def _summed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the sum of the tasks' counts.

    Each task has added up its own already; dealt out before they are grouped, the rows
    are not held in a second table before the shuffle.  The parts are no fewer than Spark's own and small.
    """
    spark = counts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return counts.repartition(parts, *keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def _lang_word(lang: str) -> bytes:
    return _LANG + lang.encode().hex().encode()


def word_counts(texts: DataFrame, min_count: int) -> DataFrame:
    """lang, word (bytes), n of the frequent words; word is null for the sum over all words of a lang."""

    def rows_of(by_lang: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        while by_lang:
            lang, counts = by_lang.popitem()
            del counts[_BREAK]
            counts[None] = counts.total()
            columns = [pa.repeat(pa.scalar(lang), len(counts)), pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, Counter] = {}
        for lang, words, seen in word_blocks(_texts(batches), 0):
            by_lang.setdefault(lang, Counter()).update(words[seen:])
            if sum(map(len, by_lang.values())) > HELD_COUNTS:
                yield from rows_of(by_lang)
        yield from rows_of(by_lang)

    found = _summed(texts.mapInArrow(count, "lang string, word binary, n long"), ["lang", "word"])
    return settle(found.filter(F.col("word").isNull() | (F.col("n") >= min_count)))


def _shards(keyed: DataFrame, key: str, size: int) -> Iterator[pa.Table]:
    """A table's distinct rows in parts of about ``size``, one after the other."""
    parts = max(1, math.ceil(keyed.count() / size))
    for part in range(parts):
        # XXH64 again would follow the hashes that some keys are themselves.
        yield keyed.filter(F.pmod(F.hash(key), F.lit(parts)) == part).toArrow()


def encode(texts: DataFrame, words: DataFrame, carry: int, shard: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(seen, ids) per block, and word -> id: ids are int32 bytes, the language's number first,
    0 for breaks and for words that are not in ``words``."""
    spark = texts.sparkSession
    blocks, numbered, known = None, None, 0
    shards = max(1, math.ceil(words.count() / shard))
    for place, part in enumerate(_shards(words, "word", shard)):
        listed = sorted(part.column("word").to_pylist())
        sent = spark.sparkContext.broadcast(b" ".join(listed))
        fill = _filler(sent, known, carry, place == 0, place == shards - 1)
        blocks = settle((texts if place == 0 else blocks).mapInArrow(fill, "seen int, ids binary, words binary"))
        rows = pa.table({"word": pa.array(listed, pa.binary()), "id": pa.array(range(known + 1, known + 1 + len(listed)), pa.int32())})
        rows = settle(spark.createDataFrame(rows, "word binary, id int"))
        numbered = rows if numbered is None else numbered.unionByName(rows)
        known += len(listed)
        sent.unpersist()
    return blocks.select("seen", "ids"), numbered


def _filler(sent: Broadcast, known: int, carry: int, first: bool, last: bool):
    """Numbers of a shard's words, in blocks new from texts or filled by shards before."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], bytes | None]]:
        if first:
            for lang, words, seen in word_blocks(_texts(batches), carry):
                yield seen, [_lang_word(lang), *words], None
            return
        for batch in batches:
            for seen, ids, words in zip(*batch.columns, strict=True):
                yield seen.as_py(), words.as_py().split(b" "), ids.as_py()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = sent.value.split(b" ") if sent.value else []
        number = dict(zip(listed, range(known + 1, known + 1 + len(listed)), strict=True)).get
        for seen, words, before in blocks(batches):
            ids = np.array([number(w, 0) for w in words], "<i4")
            if before is not None:
                ids = np.maximum(ids, np.frombuffer(before, "<i4"))
            kept = None if last else b" ".join(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([kept], pa.binary())], ["seen", "ids", "words"]
            )

    return fill


def _id_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for seen, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield seen, np.frombuffer(ids.as_buffer(), "<i4")


# Hashes of phrases, and the positions that may be frequent phrases.


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words.astype(np.uint64) + np.uint64(1))


def phrase_hashes(phrases: np.ndarray) -> np.ndarray:
    """Hashes of rows (lang, word, ..., word)."""
    hashes = np.zeros(len(phrases), np.uint64)
    for column in phrases.T:
        hashes = _longer(hashes, column)
    return hashes


def _in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def safe_positions(ids: np.ndarray, seen: int, bitmaps: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the phrases with one word more than there are bitmaps whose two parts
    are frequent, as far as the bitmaps know.  Position 0 is the first word behind the language."""
    words = ids[1:]
    at = np.flatnonzero(words)
    lang = _longer(np.zeros(1, np.uint64), ids[:1])
    hashes = _longer(np.broadcast_to(lang, at.shape), words[at])
    for length, bits in enumerate(bitmaps, 1):
        ok = _in_bitmap(bits, hashes)
        at, hashes = at[ok], hashes[ok]
        next_too = np.flatnonzero(at[1:] == at[:-1] + 1)
        at = at[next_too]
        hashes = _longer(hashes[next_too], words[at + length])
    new = at + len(bitmaps) >= seen
    return at[new], hashes[new]


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.int64)


def frequent_hashes(blocks: DataFrame, bitmaps: Broadcast, min_count: int) -> DataFrame:
    """h: hashes whose phrases occur often enough, taken together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if keys:
                found, n = _sums(keys, counts)
                for i in range(0, len(found), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(found[part].view(np.int64)), pa.array(n[part])], ["h", "n"])

        keys, counts, held = [], [], 0
        for seen, ids in _id_arrays(batches):
            found, n = np.unique(safe_positions(ids, seen, bitmaps.value)[1], return_counts=True)
            keys.append(found)
            counts.append(n)
            held += len(found)
            if held > HELD_HASHES:
                found, n = _sums(keys, counts)
                keys, counts, held = [found], [n], len(found)
                if held > HELD_HASHES // 2:
                    yield from rows_of(keys, counts)
                    keys, counts, held = [], [], 0
        yield from rows_of(keys, counts)

    sums = _summed(blocks.mapInArrow(count, "h long, n long"), ["h"])
    return settle(sums.filter(F.col("n") >= min_count).select("h"))


def candidates(blocks: DataFrame, bitmaps: Broadcast, hashes: DataFrame, length: int) -> DataFrame:
    """phrase: the different phrases (lang, word, ...) of ``length`` words with a frequent hash."""
    spark = blocks.sparkSession
    found = None
    for part in _shards(hashes, "h", HASHES):
        sent = spark.sparkContext.broadcast(np.sort(part.column("h").to_numpy().view(np.uint64)))

        def read(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            wanted, held, size = sent.value, [], 0

            def batch_of() -> pa.RecordBatch:
                rows = np.unique(np.concatenate(held)) if held else np.empty(0, f"V{4 * length + 4}")
                return _phrase_batch(rows.view("<i4").reshape(-1, length + 1))

            for seen, ids in _id_arrays(batches):
                at, h = safe_positions(ids, seen, bitmaps.value)
                at = at[wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h] if len(wanted) else at[:0]
                phrases = np.empty((len(at), length + 1), "<i4")
                phrases[:, 0] = ids[0]
                for i in range(length):
                    phrases[:, i + 1] = ids[at + i + 1]
                held.append(np.unique(phrases.view(f"V{4 * length + 4}")))
                size += len(held[-1])
                if size > HELD_HASHES:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if size > HELD_HASHES // 2:
                        yield batch_of()
                        held, size = [], 0
            yield batch_of()

        # No more tasks than cores: each names a candidate once, however often it meets it.
        few = blocks.coalesce(max(1, spark.sparkContext.defaultParallelism))
        rows = settle(few.mapInArrow(read, "phrase array<int>").distinct())
        found = rows if found is None else found.unionByName(rows)
    return found


def _phrase_column(phrases: np.ndarray) -> pa.Array:
    ends = np.arange(len(phrases) + 1, dtype=np.int32) * phrases.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(phrases).reshape(-1), pa.int32()))


def _phrase_batch(phrases: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_phrase_column(phrases)], ["phrase"])


def _phrase_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, width)


def bitmap_of(counted: DataFrame, width: int) -> np.ndarray:
    """The bitmap of a table's phrases, put together from its 2^18 words of 64 bits."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(phrase_hashes(_phrase_matrix(batch.column(0), width)) >> np.uint64(64 - BITS))
            mask = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(mask.view(np.int64))], ["place", "mask"]
            )

    rows = counted.select("phrase").mapInArrow(bits, "place int, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    found = np.zeros(1 << (BITS - 6), np.uint64)
    found[rows.column("place").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return found


# The trie.


@dataclass
class DoubleArray:
    """A trie of number sequences in two arrays, each number in ``digits`` digits of ``bits`` bits, the highest
    first: the child of state s by digit d is t = base[s] + d, if check[t] == s.  State 1 is the
    root, 0 is none; both arrays hold base[s] + d of every state and digit."""

    base: np.ndarray
    check: np.ndarray
    bits: int
    digits: int

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states one number down, 0 for those that have no such child."""
        states = np.where(symbols >> (self.bits * self.digits) == 0, states, 0)  # larger ones are in no sequence
        for place in reversed(range(self.digits)):
            at = self.base[states] + (symbols >> (self.bits * place) & ((1 << self.bits) - 1))
            states = np.where(self.check[at] == states, at, 0)
        return states


def double_array(sequences: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """(trie, end state of each row) of different rows of positive numbers, in lexical order.

    Digit by digit, nodes with most children first.  Only children need any free cell; a node
    with several tries free cells in turn, for at most a few windows, from where the last such node
    gave up, and else goes to the end.  The children of a node lie within 2^bits cells, however large the
    numbers are, so the cells grow with the nodes; whole numbers as symbols would spread each
    node over the vocabulary.
    """
    rows, length = sequences.shape
    top = int(sequences.max(initial=0)).bit_length()
    digits = max(1, math.ceil(top / DIGIT_BITS))
    bits = math.ceil(top / digits)
    radix = 1 << bits
    check = np.zeros(2 * rows * max(1, length) + 2 * radix + 64, np.int32)
    base = np.zeros(len(check), np.int32)
    # Cells from ``used`` on are free; several children are tried from ``lowest`` on.
    used = lowest = radix + 2
    check[:used] = -1
    state = np.ones(rows, np.int64)

    def room(size: int) -> None:
        nonlocal check, base
        if size > len(check):
            more = max(size, 2 * len(check)) - len(check)
            check, base = np.pad(check, (0, more)), np.pad(base, (0, more))

    for level in range(length * digits):
        place = digits - 1 - level % digits
        symbol = sequences[:, level // digits].astype(np.int64) >> (bits * place) & (radix - 1)
        first = np.ones(rows, bool)  # of a child
        first[1:] = (state[1:] != state[:-1]) | (symbol[1:] != symbol[:-1])
        begins = np.flatnonzero(first)
        parents, symbols = state[begins], symbol[begins]
        starts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(starts, append=len(parents))
        for node in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())]:
            parent, children = int(parents[starts[node]]), symbols[starts[node] : starts[node] + sizes[node]]
            span = int(children[-1] - children[0]) + 1
            at = None
            for _ in range(4):
                room(lowest + 4096 + span)
                free = lowest + np.flatnonzero(check[lowest : lowest + 4096] == 0)[:64]
                if not len(free):
                    lowest += 4096
                    continue
                fits = (check[free[:, None] - children[0] + children[None, :]] == 0).all(axis=1)
                if fits.any():
                    at = int(free[fits.argmax()])
                    break
                lowest = int(free[-1]) + 1
            if at is None:
                at = max(used, lowest)
                room(at + span)
            base[parent] = at - children[0]
            check[base[parent] + children] = parent
            used = max(used, at + span)
        alone = starts[sizes == 1]
        room(used + len(alone))
        free = np.flatnonzero(check[: used + len(alone)] == 0)[: len(alone)]
        base[parents[alone]] = free - symbols[alone]
        check[free] = parents[alone]
        used = max(used, int(free[-1]) + 1) if len(free) else used
        ends = base[parents] + symbols
        state = ends[np.cumsum(first) - 1]
    room(used + radix)
    check[check == 0] = -1  # state 0 has no children
    return DoubleArray(base[: used + radix].copy(), check[: used + radix].copy(), bits, digits), state


def end_states(trie: DoubleArray, ids: np.ndarray, seen: int, length: int) -> np.ndarray:
    """The end states of all phrases of ``length`` words in a block that the trie holds."""
    words = ids[1:]
    (state,) = trie.step(np.ones(1, np.int64), ids[:1].astype(np.int64))
    at = np.flatnonzero(words[: max(0, len(words) - length + 1)]) if state else np.zeros(0, np.int64)
    states = np.full(len(at), state)
    for level in range(length):
        states = trie.step(states, words[at + level].astype(np.int64))
        alive = states > 0
        at, states = at[alive], states[alive]
    return states[at + length - 1 >= seen]


def _slice_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """state, f: the tasks' slices added up, however many tasks there were."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(counts.as_buffer(), "<i8")
            sums[place] = sums[place] + part if place in sums else part
    for place, part in sums.items():
        states = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array((states + place * SLICE).astype(np.int32)), pa.array(part[states])], ["state", "f"])


def counted_phrases(blocks: DataFrame, found: DataFrame, length: int, min_count: int, shard: int = SEQUENCES) -> DataFrame | None:
    """phrase, f of the candidates that are frequent; None without candidates."""
    spark = blocks.sparkSession
    counted = None
    for part in _shards(found, "phrase", shard):
        phrases = _phrase_matrix(part.column("phrase"), length + 1)
        if not len(phrases):
            continue
        phrases = phrases[np.lexsort(phrases.T[::-1])]
        trie, ends = double_array(phrases)
        sent = spark.sparkContext.broadcast(trie)

        def count(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            trie = sent.value
            total = np.zeros(len(trie.check), np.int64)
            held: list[np.ndarray] = []
            for seen, ids in _id_arrays(batches):
                held.append(end_states(trie, ids, seen, length))
                if sum(map(len, held)) > len(total):
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held = []
            if held:
                total += np.bincount(np.concatenate(held), minlength=len(total))
            for place in range(0, len(total), SLICE):
                part = total[place : place + SLICE]
                if part.any():
                    columns = [pa.array([place // SLICE], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["slice", "counts"])

        slices = blocks.mapInArrow(count, "slice int, counts binary")
        sums = slices.repartition(spark.sparkContext.defaultParallelism, "slice").mapInArrow(_slice_sums, "state int, f long")
        # At most a row per candidate of the shard.
        rows = sums.filter(F.col("f") >= min_count).toArrow()
        f_of = np.zeros(len(trie.check), np.int64)
        f_of[rows.column("state").to_numpy()] = rows.column("f").to_numpy()
        frequent = f_of[ends] > 0
        columns = {"phrase": _phrase_column(phrases[frequent]), "f": pa.array(f_of[ends][frequent])}
        kept = settle(spark.createDataFrame(pa.table(columns), "phrase array<int>, f long"))
        counted = kept if counted is None else counted.unionByName(kept)
        sent.unpersist()
    return counted


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, top: int | None = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language (None: all).

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and these at spaces and
    tabs into words; a phrase lies in one piece.  Null texts count as empty, a null language is
    ``und``; every row counts, also repeated ones and those without id, and other
    columns are not read.  A candidate occurs ``min_count`` times or more (a); its cut with the lowest
    score floor(1000 * a * n / (l * r)) counts, of equal ones the first.  A candidate inside a longer one
    that occurs as often is left out.  Ranks go by score, a, and the phrase's bytes.  Without
    candidates there are no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    counts = word_counts(texts, min_count)
    frequent = counts.filter(F.col("word").isNotNull())
    lang_word = F.concat(F.lit(bytearray(_LANG)), F.lower(F.hex(F.col("lang").cast("binary"))).cast("binary"))
    entries = frequent.select("word").union(frequent.select(lang_word.alias("word"))).distinct()
    blocks, numbered = encode(texts, settle(entries), longest - 1, WORDS)
    lang_ids = counts.filter(F.col("word").isNull()).select("lang", "n", lang_word.alias("word")).join(numbered, "word")
    lang_ids = settle(lang_ids.select("lang", "n", F.col("id").alias("lang_id")))
    singles = frequent.join(numbered, "word").join(lang_ids.select("lang", "lang_id"), "lang")
    level = settle(singles.select(F.array("lang_id", "id").alias("phrase"), F.col("n").alias("f")))
    levels, maps = [level], []
    for length in range(2, longest + 1):
        maps.append(bitmap_of(level, length))
        sent = spark.sparkContext.broadcast(list(maps))
        hashes = frequent_hashes(blocks, sent, min_count)
        level = counted_phrases(blocks, candidates(blocks, sent, hashes, length), length, min_count, SEQUENCES)
        sent.unpersist()
        if level is None or not level.take(1):
            break
        levels.append(level)
    return _ranked(_scored(levels, lang_ids), numbered, lang_ids, top)


def _scored(levels: list[DataFrame], lang_ids: DataFrame) -> DataFrame:
    """phrase, a, l, r, n, score of the candidates that no longer one of equal count holds."""
    counted = levels[0]
    for level in levels[1:]:
        counted = counted.unionByName(level)
    found = counted.filter(F.size("phrase") > 2).withColumnRenamed("f", "a")
    lang, size = F.get("phrase", F.lit(0)), F.size("phrase")
    rest = lambda k: F.concat(F.array(lang), F.slice("phrase", k + 2, size - k - 1))
    cuts = found.select("phrase", "a", lang.alias("lang_id"), F.explode(F.sequence(F.lit(1), size - 2)).alias("k"))
    cuts = cuts.select("*", F.slice("phrase", 1, F.col("k") + 1).alias("left"), rest(F.col("k")).alias("right"))
    cuts = cuts.join(counted.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counted.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.join(lang_ids.select("lang_id", "n"), "lang_id")
    # Whole decimals of up to 38 digits; the quotient is at most 1000 * n / min_count.
    exact = "cast(1000 AS decimal(4,0)) * cast(a AS decimal(15,0)) * cast(n AS decimal(17,0)) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))"
    cuts = cuts.withColumn("score", F.expr(exact).cast("long"))
    best = cuts.groupBy("phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b"))
    longer = found.filter(size > 3).select("phrase", "a", F.explode(F.sequence(F.lit(2), size - 2)).alias("m"))
    longer = longer.select("phrase", "a", "m", F.explode(F.sequence(F.lit(1), size - F.col("m"))).alias("begin"))
    inner = F.concat(F.array(lang), F.slice("phrase", F.col("begin") + 1, F.col("m")))
    inside = longer.select(inner.alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("most"))
    kept = best.join(inside, "phrase", "left").filter(F.coalesce(F.col("most") < F.col("b.a"), F.lit(True)))
    return settle(kept.select("phrase", "b.*"))


def _ranked(scored: DataFrame, numbered: DataFrame, lang_ids: DataFrame, top: int | None) -> DataFrame:
    size = F.size("phrase")
    words = scored.select("phrase", F.posexplode(F.slice("phrase", 2, size - 1)).alias("place", "id")).join(numbered, "id")
    spelled = words.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("place", F.col("word").cast("string").alias("w")))).alias("ws"))
    spelled = spelled.select("phrase", F.array_join("ws.w", " ").alias("said"))
    rows = scored.join(spelled, "phrase").withColumn("lang_id", F.get("phrase", F.lit(0))).join(lang_ids.select("lang_id", "lang"), "lang_id")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "said")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows if top is None else rows.filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long"), F.col("said").alias("phrase"), "a", "l", "r", "n", "score")
