"""Token counts of documents of any length, by chunks that overlap and resynchronise.

A long text is cut into chunks that overlap.  Every chunk is encoded alone, with offsets, and
reports the places of its overlaps where a token ends and the tokenizer is known to start anew.
Where both neighbours report the same place, they are spliced: tokens before it are the left
chunk's, those behind it the right one's.  A text with an overlap that holds no such place is cut
again, with wider overlaps, in the end as one piece.

Why such a place proves that both chunks go on as the whole text does: the normaliser (NFC, lower
case) joins nothing across it, since what follows is ASCII or CJK and never composes with what
precedes; the split pattern has no match that spans it, whatever stands before; and a special string
that could span it lies inside both chunks as a whole, since it is longer than no ``GUARD``.

Offsets are asked for only where a place is looked for.  All other text is counted run by run between
spaces: a task counts each distinct run once, from the matches of the split in it, and gives each
distinct match once to the library's model.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgauge.llm.common import SPACES, free_name
from loadgauge.plans.joining import settle

CHUNK = 1 << 15  # characters; longer texts are cut
OVERLAP = 256
GUARD = 32  # a place so close to the end of a chunk says nothing
LIMIT = 2048  # tokens of a document that is not over the limit
KNOWN_RUNS = 1 << 19  # runs between spaces whose counts a task remembers, and matches of the split
KNOWN_LENGTH = 256  # longer ones are counted whenever they come
BATCH_CHARS = 1 << 18

# CJK signs, punctuation and digits that NFC and lower case leave alone.
_LETTER = "A-Za-zぁ-んァ-ン一-龥"
_MARK = "!-&(-/:-@\\[-`{-~、。！（），：；？"
# Places where the split of word_bpe_49k starts anew: before white space; on either side of a
# digit, which is a match of its own; between letters and marks.  A quote before letters may
# begin a contraction, so it is no mark here; combining signs are in no class.
WORD_BPE_STARTS = (
    rf"(?=[ \t\n\r])|(?<=[{_LETTER}{_MARK}0-9])(?=[0-9])|(?<=[0-9])(?=[{_LETTER}{_MARK}'])|(?<=[{_LETTER}])(?=[{_MARK}'])|(?<=[{_MARK}])(?=[{_LETTER}])"
)

# Runs in which the normaliser changes nothing but capitals, each by itself, and \p{L} and \p{N} are
# these letters and 0-9: printable ASCII, Latin and Cyrillic letters; not İ, which becomes two signs.
_LOWER = "a-zß-öø-ÿĀ-įı-ſа-џ"
WORD_BPE_PLAIN = "[!-~À-ÖØ-öø-ÿĀ-įı-ſЀ-џ]*"
# The split's matches in such a run in lower case.
WORD_BPE_MATCHES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^{_LOWER}0-9]+"
_is_plain = re.compile(WORD_BPE_PLAIN).fullmatch
_matches = re.compile(WORD_BPE_MATCHES).findall
_space = re.compile(f"[{SPACES}]")


def word_bpe_path() -> str:
    """Where the vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in turn, in lists of bounded size."""
    part, chars = [], 0
    for text in texts:
        if part and chars + len(text) > BATCH_CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text)
    if part:
        yield part


class _Sizes(dict):
    """Tokens by run or match, worked out when first asked for; the memory is bounded."""

    def __init__(self, size_of: Callable[[bytes | str], int]):
        super().__init__()
        self.size_of = size_of

    def __missing__(self, name: bytes | str) -> int:
        size = self.size_of(name)
        if len(name) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_RUNS:
                self.clear()
            self[name] = size
        return size


@dataclass
class TokenCounter:
    """A tokenizer file and what is known about it.

    ``path`` None stands for word_bpe_49k.json, looked up where the counting runs.  ``starts`` is a
    pattern of places where its split starts anew; ``spaced`` says that no token depends on
    anything across ASCII white space, so that runs between spaces can be counted one by one.
    Both hold for the default file; another one needs its own.  Only runs of the default file are
    split further.
    """

    path: str | None = None
    starts: str = WORD_BPE_STARTS
    spaced: bool = True
    _known: _Sizes | None = field(default=None, repr=False)
    _tokenizer: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"path": self.path, "starts": self.starts, "spaced": self.spaced, "_known": None, "_tokenizer": None}

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path or word_bpe_path())
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return self._tokenizer

    def encoded_sizes(self, texts: list[str]) -> list[int]:
        """Tokens of each text as the library gives them."""
        found = (self.tokenizer.encode_batch_fast(part, add_special_tokens=False) for part in _parts(texts))
        return [len(one) for part in found for one in part]

    def sizes(self, texts: list[str]) -> list[int]:
        """Tokens of each text; with ``spaced``, each distinct run between spaces is counted once."""
        if not self.spaced:
            return self.encoded_sizes(texts)
        if self._known is None:
            self._known = _Sizes(self._run_size())
        size_of = self._known.__getitem__
        return [sum(map(size_of, text.encode().split())) for text in texts]

    def _run_size(self) -> Callable[[bytes], int]:
        """Tokens of a run: as the library gives them, or the sum over the split's matches in it."""
        tokenizer = self.tokenizer
        model, pre_tokenizer = tokenizer.model, tokenizer.pre_tokenizer
        special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        may_split = self.path is None

        def match_size(match: str) -> int:
            # Byte-level names of ASCII are the signs themselves.
            names = [match] if match.isascii() else [name for name, _ in pre_tokenizer.pre_tokenize_str(match)]
            return sum(len(model.tokenize(name)) for name in names)

        size_of = _Sizes(match_size).__getitem__

        def run_size(raw: bytes) -> int:
            run = raw.decode()
            if may_split and _is_plain(run) and not any(s in run for s in special):
                return sum(map(size_of, _matches(run.lower())))
            return len(tokenizer.encode_batch_fast([run], add_special_tokens=False)[0])

        return run_size

    def places(self, piece: str, ranges: list[tuple[int, int]]) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        """(tokens of the piece, and for each range the places where it may be spliced with the
        number of tokens before each).

        ``ranges`` rise.  With ``spaced``, only the runs that they touch are encoded with offsets;
        the tokens of a stretch between them are counted and all stand for the whole stretch.
        """
        begins, ends = [], []
        for begin, end, touched in self._stretches(piece, ranges):
            if touched:
                (found,) = self.tokenizer.encode_batch([piece[begin:end]], add_special_tokens=False)
                spans = np.array(found.offsets, np.int64).reshape(-1, 2) + begin
                begins.append(spans[:, 0])
                ends.append(spans[:, 1])
            else:
                (size,) = self.sizes([piece[begin:end]])
                begins.append(np.full(size, begin, np.int64))
                ends.append(np.full(size, end, np.int64))
        begins, ends = np.sort(np.concatenate(begins)), np.sort(np.concatenate(ends))
        out = []
        for low, high in ranges:
            at = np.array([m.start() for m in re.compile(self.starts).finditer(piece, max(low, 0), min(high, len(piece)))], np.int64)
            before = np.searchsorted(ends, at, "right")
            whole = before == np.searchsorted(begins, at, "left")  # no token spans the place
            out.append((at[whole], before[whole]))
        return len(ends), out

    def _stretches(self, piece: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
        """(begin, end, whether a range touches it) of what the piece is cut into at spaces."""
        if not self.spaced:
            return [(0, len(piece), True)]
        cuts, done = [], 0
        for low, high in ranges:
            if low >= high:
                continue
            begin = max(done, *(piece.rfind(space, done, max(low, 0)) for space in SPACES))
            behind = _space.search(piece, max(high, begin))
            end = behind.start() if behind else len(piece)
            cuts += [(done, begin, False), (begin, end, True)]
            done = end
        return [*cuts, (done, len(piece), False)]


def _cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the chunks of a text; each begins ``overlap`` before the end of the last."""
    cuts, begin = [], 0
    while True:
        end = min(length, begin + chunk)
        cuts.append((begin, end))
        if end == length:
            return cuts
        begin = end - overlap


_EDGE = "digest binary, edge int, at array<int>, n array<int>, last boolean, size long"


def _spliced(pieces: DataFrame, counter: TokenCounter) -> DataFrame:
    """pieces(digest, no, begin, last, overlap, piece) -> digest, n_tokens (null if an overlap
    holds no place to splice at).

    Each chunk gives a row per overlap it has a share in; the two rows of an overlap meet in one
    group, so no document is gathered anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, no, begin, last, overlap, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                left = (GUARD, overlap - GUARD + 1) if no else (0, 0)
                right = (0, 0) if last else (len(piece) - overlap + GUARD, len(piece) - GUARD + 1)
                size, ((a, na), (b, nb)) = counter.places(piece, [left, right])
                if no:
                    rows.append((digest, no - 1, (a + begin).tolist(), (-na).tolist(), False, 0))
                if not last:
                    rows.append((digest, no, (b + begin).tolist(), nb.tolist(), False, 0))
                rows.append((digest, -1, [], [], last, size if last else 0))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.int64()]
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "edge", "at", "n", "last", "size"])

    ends = settle(pieces.select("digest", "no", "begin", "last", "overlap", "piece").mapInArrow(run, _EDGE))
    # The left chunk's rows count tokens up to a place, the right one's take them away.
    place = F.explode(F.arrays_zip("at", "n")).alias("p")
    shared = ends.filter("edge >= 0").select("digest", "edge", place).groupBy("digest", "edge", "p.at").agg(
        F.sum("p.n").alias("gain"), F.count(F.lit(1)).alias("sides")
    )
    best = shared.groupBy("digest", "edge").agg(F.min_by("gain", F.struct(F.col("sides") != 2, "at")).alias("gain"), F.max("sides").alias("sides"))
    edges = best.groupBy("digest").agg(F.sum("gain").alias("gain"), F.count_if(F.col("sides") == 2).alias("spliced"))
    wholes = ends.filter("edge < 0").groupBy("digest").agg(F.sum("size").alias("size"), (F.count(F.lit(1)) - 1).alias("wanted"))
    both = wholes.join(edges, "digest", "left")
    done = F.coalesce("spliced", F.lit(0)) == F.col("wanted")
    return both.select("digest", F.when(done, F.col("size") + F.coalesce("gain", F.lit(0))).alias("n_tokens"))


def count_long(texts: DataFrame, counter: TokenCounter, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """texts(digest, text), a row per digest -> digest, n_tokens, settled.

    Texts that cannot be spliced are cut again with overlaps four times as wide, in chunks at least
    four times the overlap, until one chunk holds them.
    """
    if overlap <= 2 * GUARD or chunk < 2 * overlap:
        raise ValueError("an overlap must exceed two guards, a chunk two overlaps")
    found = None
    while True:
        pieces = _pieces(texts, chunk, overlap)
        tried = settle(_spliced(pieces, counter))
        done = tried.filter("n_tokens is not null")
        found = done if found is None else found.unionByName(done)
        failed = tried.filter("n_tokens is null").select("digest")
        if not failed.take(1):
            return found
        texts = settle(texts.join(failed, "digest", "left_semi"))
        overlap *= 4
        chunk = max(chunk, 4 * overlap)


def _pieces(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk, dealt over all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                for no, (begin, end) in enumerate(_cuts(len(text), chunk, overlap)):
                    row = [[digest], [no], [begin], [end == len(text)], [overlap], [text[begin:end]]]
                    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["digest", "no", "begin", "last", "overlap", "piece"]
                    )

    schema = "digest binary, no int, begin int, last boolean, overlap int, piece string"
    pieces = texts.select("digest", "text").mapInArrow(cut, schema)
    return settle(pieces.repartition(texts.sparkSession.sparkContext.defaultParallelism * 4, "digest", "no"))


def count_tokens(
    docs: DataFrame, text_col: str = "text", counter: TokenCounter | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit) in place of the text.

    One row per row, also without id or with a repeated one; other columns stay as they are (one
    that is called like a result gives way to it).  A null text counts as empty: no bytes, no tokens.
    Texts of up to ``chunk`` characters are counted whole in one pass; longer ones, told apart by
    their SHA-256, once each by chunks in all tasks, so a document of any length and any number
    of copies of it stay spread.  Special strings inside a text count as the special tokens they
    name, as the library does by default; begin and end tokens are not added.
    """
    counter = counter or TokenCounter()
    results = {"n_bytes", "n_tokens", "over_limit"}
    kept = [c for c in docs.columns if c != text_col and c.lower() not in results]
    digest = free_name(docs, "__digest")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*kept, text.alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            values = batch.column(batch.num_columns - 1).to_pylist()
            encoded = [v.encode() for v in values]
            short = [i for i, v in enumerate(values) if len(v) <= chunk]
            sizes: list[int | None] = [None] * len(values)
            for i, size in zip(short, counter.sizes([values[i] for i in short]), strict=True):
                sizes[i] = size
            digests = [None if sizes[i] is not None else hashlib.sha256(raw).digest() for i, raw in enumerate(encoded)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(map(len, encoded), pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                [*kept, "n_bytes", "n_tokens", digest],
            )

    schema = rows.drop(text_col).schema.add("n_bytes", "long").add("n_tokens", "long").add(digest, "binary")
    counted = settle(rows.mapInArrow(run, schema))
    size_of = F.length(text)
    long_texts = docs.filter(size_of > chunk).select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    long_texts = settle(long_texts.groupBy("digest").agg(F.min("text").alias("text")))
    pieced = free_name(docs, "__pieced")
    sizes = count_long(long_texts, counter, chunk, overlap).select(F.col("digest").alias(digest), F.col("n_tokens").alias(pieced))
    whole = counted.join(sizes, digest, "left").withColumn("n_tokens", F.coalesce("n_tokens", pieced))
    return whole.withColumn("over_limit", F.col("n_tokens") > limit).select(*kept, "n_bytes", "n_tokens", "over_limit")
