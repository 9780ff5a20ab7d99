"""SentencePiece BPE encoding with keyed merge-dropout, and lossless decoding.

The agenda of BPE always merges the adjacent pair with the best score, leftmost first.  With
dropout, a hash keyed by seed, document, place of the word, pair and place in the word says of
every candidate whether it is skipped; the same key gives the same segmentation on every run and
machine.  Each distinct word is first segmented without dropout, once per slice of documents.
An occurrence for which none of those merges is skipped shares that result; every other one is
worked out on its own.

No piece of the vocabulary continues past a word into the next space, so words (with the spaces
before them) are encoded apart.  Short words of a slice merge together, one pair of each word per
numpy pass; long ones run through a heap.  Both follow the same agenda.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.llm.common import free_name

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
SPACE = "▁"
LONG = 48  # characters; longer words use the heap
SLICE_CHARS = 1 << 23
BLOCK_CHARS = 1 << 19  # characters of short words that merge together

_CHUNK = re.compile(" *[^ ]+| +")
_OLD = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their ranks and the pairs that merge; as large as the vocabulary alone."""

    bytes_of: list[bytes]
    first_byte: int
    chars: dict[str, int]
    keys: np.ndarray
    merged: np.ndarray
    ranks: np.ndarray

    @property
    def size(self) -> int:
        return len(self.bytes_of)


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a BPE model whose pieces hold the word mark only in front, with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    first_byte = model.piece_to_id("<0x00>")
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
    if any(SPACE in p.lstrip(SPACE) for p, s in zip(names, special, strict=True) if not s):
        raise ValueError("a piece crosses from a word into the next")
    ids = {p: i for i, p in enumerate(names) if not special[i]}
    scores = np.array([model.get_score(i) for i in range(n)])
    ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    pairs = {}
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                pairs[left << 32 | right] = i
    keys = np.array(sorted(pairs), np.int64)
    raw = [
        bytes([i - first_byte]) if model.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode()
        for i, p in enumerate(names)
    ]
    merged = np.array([pairs[k] for k in keys.tolist()], np.int64)
    # A space is the word mark; the mark itself, found in a text, is no piece.
    chars = {(" " if p == SPACE else p): i for p, i in ids.items() if len(p) == 1}
    return Vocabulary(raw, first_byte, chars, keys, merged, ranks)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED) -> None:
        self.v, self.seed = vocabulary, seed
        self.limit = np.uint64(min(int(dropout * 2**64), 2**64 - 1))
        self.drops = dropout > 0
        self.table = np.arange(vocabulary.size, vocabulary.size + 0x110000, dtype=np.int32)
        for char, i in vocabulary.chars.items():
            self.table[ord(char)] = i

    def symbols(self, chunks: list[str]) -> np.ndarray:
        """One id per character; characters outside the vocabulary lie above it."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.table[points]

    def skipped(self, pair: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether the words of these keys leave out the pair at a place."""
        salt = np.uint64(self.seed * 0x9E3779B97F4A7C15 % 2**64)
        turn = key + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return _mix(_mix(pair.astype(np.uint64) ^ salt) + turn * np.uint64(0xD6E8FEB86659FD93)) < self.limit

    def candidates(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, word_key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; rank _OLD if it does not merge or is skipped.

        Without keys nothing is skipped.
        """
        key = left.astype(np.int64) << 32 | right
        place = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        known = self.v.keys[place] == key
        if self.drops and word_key is not None:
            where = np.flatnonzero(known)
            known[where[self.skipped(key[where], at[where], word_key[where])]] = False
        merged = self.v.merged[place]
        return np.where(known, self.v.ranks[merged], _OLD), merged

    def long_word(self, chunk: str, key: int | None) -> list[int]:
        """The agenda of one word as a heap of (rank, place)."""
        ids = self.symbols([chunk]).tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            lefts = [i for i in lefts if i >= 0 and nxt[i] < n]
            if not lefts:
                return
            a = np.array([ids[i] for i in lefts], np.int64)
            b = np.array([ids[nxt[i]] for i in lefts], np.int64)
            rank, merged = self.candidates(a, b, np.array(lefts), None if key is None else np.full(len(lefts), key, np.uint64))
            for i, r, m, x, y in zip(lefts, rank.tolist(), merged.tolist(), a.tolist(), b.tolist(), strict=True):
                if r != _OLD:
                    heapq.heappush(heap, (r, i, m, x, y))

        offer(list(range(n - 1)))
        while heap:
            _, i, m, x, y = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j], nxt[i] = m, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer([prv[i], i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = nxt[i]
        return out

    def short_words(
        self, chunks: list[str], keys: np.ndarray | None, merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of one length: every pass merges the best pair of each that has one.

        Returns the tokens, where each word's begin, and their numbers.  ``merges`` receives the
        merges of every pass: words, pairs and places.
        """
        n, every = len(chunks[0]), np.arange(len(chunks))
        ids = self.symbols(chunks).reshape(-1, n).copy()
        at = np.tile(np.arange(n, dtype=np.int32), (len(chunks), 1))
        rank = np.full(ids.shape, _OLD, np.int32)
        made = np.zeros(ids.shape, np.int32)
        length = np.full(len(chunks), n)
        if n > 1:
            r, m = self.candidates(ids[:, :-1].ravel(), ids[:, 1:].ravel(), at[:, :-1].ravel(), None if keys is None else np.repeat(keys, n - 1))
            rank[:, :-1], made[:, :-1] = r.reshape(-1, n - 1), m.reshape(-1, n - 1)
        tables, live, full = [ids, at, rank, made], every, []
        while len(live):
            ids, at, rank, made = tables
            rows = np.arange(len(live))
            best = rank.argmin(axis=1)
            has = rank[rows, best] != _OLD
            if not has.all():  # words without a pair left are done
                full.append((live[~has], ids[~has], length[~has]))
                tables = [t[has] for t in tables]
                live, best, length = live[has], best[has], length[has]
                ids, at, rank, made = tables
                rows = np.arange(len(live))
                if not len(live):
                    break
            if merges is not None:
                merges.append((live, ids[rows, best].astype(np.int64) << 32 | ids[rows, best + 1], at[rows, best]))
            ids[rows, best] = made[rows, best]
            # Take the right part out of each row.
            width = ids.shape[1] - 1
            take = np.arange(width)[None, :] + (np.arange(width)[None, :] > best[:, None])
            tables = [np.take_along_axis(t, take, axis=1) for t in tables]
            ids, at, rank, made = tables
            length = length - 1
            if width:
                inside = best < width
                rank[rows[inside], best[inside]] = _OLD
            for left in (best - 1, best):
                ok = np.flatnonzero((left >= 0) & (left + 1 < length))
                cols = left[ok]
                r, m = self.candidates(ids[ok, cols], ids[ok, cols + 1], at[ok, cols], None if keys is None else keys[live[ok]])
                rank[ok, cols], made[ok, cols] = r, m
        counts, starts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        flat, begin = [], 0
        for which, part, n in full:
            counts[which] = n
            starts[which] = begin + np.cumsum(n) - n
            flat.append(part[np.arange(part.shape[1])[None, :] < n[:, None]])
            begin += int(n.sum())
        return np.concatenate(flat), starts, counts

    def words(
        self, chunks: list[str], keys: np.ndarray | None, merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token ids, where each word's begin, their number); a key for each word, or no dropout.

        ``merges`` receives those of short words, each word's in order.
        """
        keys = None if keys is None else keys.astype(np.uint64)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts, counts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        parts, begin = [np.empty(0, np.int32)], 0
        by_size = np.argsort(sizes, kind="stable")
        by_size = by_size[: np.searchsorted(sizes[by_size], LONG, "right")]
        for same in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1) if len(by_size) else []:
            step = max(1, BLOCK_CHARS // int(sizes[same[0]]))
            for which in (same[i : i + step] for i in range(0, len(same), step)):
                made = None if merges is None else []
                ids, at, k = self.short_words([chunks[i] for i in which.tolist()], None if keys is None else keys[which], made)
                starts[which], counts[which] = begin + at, k
                parts.append(ids)
                begin += len(ids)
                if made:
                    merges.extend((which[w], pair, place) for w, pair, place in made)
        for i in np.flatnonzero(sizes > LONG):
            ids = np.array(self.long_word(chunks[i], None if keys is None else int(keys[i])), np.int32)
            starts[i], counts[i] = begin, len(ids)
            parts.append(ids)
            begin += len(ids)
        flat = np.concatenate(parts)
        odd = np.flatnonzero(flat >= self.v.size)
        if not len(odd):
            return flat, starts, counts
        utf8 = [chr(int(flat[i]) - self.v.size).encode("utf-8", "surrogatepass") for i in odd]
        widths = np.ones(len(flat), np.int64)
        widths[odd] = [len(x) for x in utf8]
        ends = np.concatenate(([0], np.cumsum(widths)))
        out = np.empty(ends[-1], np.int32)
        out[ends[:-1]] = flat
        for i, raw in zip(odd, utf8, strict=True):
            out[ends[i] : ends[i + 1]] = np.frombuffer(raw, np.uint8).astype(np.int32) + self.v.first_byte
        return out, ends[starts], ends[starts + counts] - ends[starts]

    def changed(self, word: np.ndarray, keys: np.ndarray, merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_words: int) -> np.ndarray:
        """Whether an occurrence of a word skips one of the merges it has without dropout."""
        found = np.zeros(len(word), bool)
        if not merges:
            return found
        of, pair, at = (np.concatenate(x) for x in zip(*merges, strict=True))
        order = np.argsort(of, kind="stable")
        pair, at = pair[order], at[order]
        steps = np.bincount(of, minlength=n_words)
        begin = np.cumsum(steps) - steps
        left = np.arange(len(word))
        for k in range(int(steps.max())):
            left = left[steps[word[left]] > k]
            step = begin[word[left]] + k
            gone = self.skipped(pair[step], at[step], keys[left])
            found[left[gone]] = True
            left = left[~gone]
        return found

    def texts(self, texts: list[str], salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts on end, number of tokens of each)."""
        known: dict[str, int] = defaultdict(itertools.count().__next__)
        place, per_text = [], []
        for text in texts:
            chunks = _CHUNK.findall(" " + text) if text else []
            place.extend(map(known.__getitem__, chunks))
            per_text.append(len(chunks))
        per_text = np.array(per_text, np.int64)
        if not place:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        word, names = np.array(place), list(known)
        if not self.drops:
            flat, begins, counts = self.words(names, None)
            begins, n = begins[word], counts[word]
        else:
            start = np.repeat(np.cumsum(per_text) - per_text, per_text)
            keys = _mix(np.repeat(salts, per_text) + (np.arange(len(place)) - start).astype(np.uint64))
            # Long words have so many merges that hardly an occurrence skips none.
            short = np.flatnonzero(np.fromiter(map(len, names), np.int64, len(names)) <= LONG)
            row = np.full(len(names), -1)
            row[short] = np.arange(len(short))
            merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            plain, plain_begins, plain_counts = self.words([names[i] for i in short.tolist()], None, merges)
            own = row[word] < 0
            shared = np.flatnonzero(~own)
            own[shared] = self.changed(row[word[shared]], keys[shared], merges, len(short))
            begins, n = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
            at = row[word[~own]]
            begins[~own], n[~own] = plain_begins[at], plain_counts[at]
            flat, own_begins, n[own] = self.words([names[i] for i in word[own].tolist()], keys[own])
            begins[own] = len(plain) + own_begins
            flat = np.concatenate([plain, flat])
        out = flat[np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        text_of = np.repeat(np.arange(len(texts)), per_text)
        return out, np.bincount(text_of, n, len(texts)).astype(np.int64)


def decoded(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    """The text of token ids; the space that encoding puts in front goes."""
    return b"".join(map(bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def slices(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[slice]:
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
    dropout: float = DROPOUT, seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) and ``decodes``: the ids give back the text.

    A null text has null ids and decodes; an empty one has no ids.  Rows that repeat an id and
    text have the same ids.  Characters outside the vocabulary, the word mark itself among them,
    become their UTF-8 bytes, so that every text decodes to itself.
    """
    vocabulary = load_vocabulary(model)
    names = [c for c in docs.columns if c not in ("token_ids", "decodes")]
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, dropout, seed)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            salts = batch.column(len(names)).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in slices([len(t or "") + 1 for t in texts]):
                ids, counts = encoder.texts([t or "" for t in texts[part]], salts[part])
                ends = np.concatenate(([0], np.cumsum(counts)))
                back = [
                    None if t is None else decoded(ids[a:b], vocabulary.bytes_of) == t
                    for t, a, b in zip(texts[part], ends[:-1], ends[1:], strict=True)
                ]
                null = np.array([t is None for t in texts[part]] + [False])
                offsets = pa.array(ends.astype(np.int32), mask=null)
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                rest = [batch.column(i).slice(part.start, len(back)) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(back, pa.bool_())], [*names, "token_ids", "decodes"])

    # Documents without id are told apart by their text.
    salt = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    schema = docs.select(names).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("decodes", T.BooleanType())
    return docs.select(*names, salt.alias(free_name(docs, "__salt"))).mapInArrow(run, schema)


def decode(rows: DataFrame, ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """``rows`` with ``text`` decoded from ``ids_col``; null ids give null."""
    bytes_of = load_vocabulary(model).bytes_of
    names = [c for c in rows.columns if c != "text"]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if not x.is_valid else decoded(x.values.to_numpy(zero_copy_only=False), bytes_of) for x in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    return rows.select(names).mapInArrow(run, rows.select(names).schema.add("text", T.StringType()))
