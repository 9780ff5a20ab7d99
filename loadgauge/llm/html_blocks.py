"""HTML as a sequence of leaf blocks with the features a labeller reads."""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

# Elements of running text; every other element bounds a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never text of the page; a noscript speaks to readers without
# scripts, and a template is shown only by one.
SKIPPED = frozenset("script style noscript template title svg iframe object textarea canvas audio video annotation annotation-xml".split())
# Elements that run to the end of the page if nothing closes them; without an end the others hide nothing.
TO_THE_END = frozenset("script style noscript template title iframe textarea xmp".split())
# Elements of which one may lie in another of its kind, and those that ``/>`` closes.
NESTED = frozenset("template svg object canvas audio video annotation annotation-xml".split())
FOREIGN = frozenset("svg annotation annotation-xml".split())
# A start of the key ends an open element of the value, unless a bound lies between.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"),
}
BOUNDS = frozenset("ul ol dl table select body html".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPES = frozenset("table td th button object html".split())

PATH_DIM, WORD_DIM = 256, 32
NUMBERS = 7
DIM = PATH_DIM + WORD_DIM + NUMBERS

_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
# A quote opens a value only directly behind the equals sign.
_TAG_END = re.compile(r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)|=)*+>""")
_PARTS = re.compile(r"[a-z]+")
_WORDS = re.compile(r"\w+")


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_DIM


@dataclass
class Leaf:
    text: str
    path: frozenset[int]
    tags: tuple[str, ...]
    linked: int


@dataclass
class _Open:
    tag: str
    path: frozenset[int]
    tags: frozenset[str]


@dataclass
class _Blocks:
    """Leaves so far and the open elements; ``places`` has the places in the stack of each tag, ``bounds``
    those of the elements that bound blocks, so no step walks over a deep stack."""

    leaves: list[Leaf] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", frozenset(), frozenset([""]))])
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    bounds: list[int] = field(default_factory=lambda: [0])
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.leaves.append(Leaf(text, self.stack[-1].path, tuple(self.stack[-1].tags), self.linked))
        self.pieces, self.linked = [], 0

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of ``tags``; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        for x in self.stack[place:]:
            self.places[x.tag].pop()
        del self.stack[place:]
        while self.bounds[-1] >= place:
            self.bounds.pop()

    def pop_to(self, tags: tuple[str, ...], bounds: frozenset[str]) -> None:
        place = self.last(tags)
        if place and place >= self.last(bounds):
            self.close(place)

    def start(self, tag: str, attrs: str) -> None:
        if tag not in INLINE:
            self.flush()
            self.pop_to(("p",), SCOPES)
            if tag in CLOSES:
                for _ in CLOSES[tag]:
                    self.pop_to(CLOSES[tag], BOUNDS - {tag})
        elif tag in ("br", "img", "wbr"):
            self.pieces.append("" if tag == "wbr" else " ")
        if tag in VOID:
            return
        own = {bucket(tag)}
        if attrs:
            for name, *values in _ATTR.findall(attrs):
                for part in _PARTS.findall("".join(values).lower()):
                    own.add(bucket(f"{name.lower() == 'role'}.{part.removesuffix('s')}"))
        above, place = self.stack[-1], len(self.stack)
        tags = above.tags if tag in above.tags else above.tags | {tag}
        self.stack.append(_Open(tag, above.path if own <= above.path else above.path | own, tags))
        self.places[tag].append(place)
        if tag not in INLINE:
            self.bounds.append(place)

    def end(self, tag: str) -> None:
        if tag in SKIPPED:  # never opened, and no bound of a block
            return
        if tag not in INLINE:
            self.flush()
        place = self.last(HEADINGS if tag in HEADINGS else (tag,))
        if place and (tag not in INLINE or place > self.bounds[-1]):
            self.close(place)

    def text(self, raw: str) -> None:
        shown = html.unescape(raw) if "&" in raw else raw
        self.pieces.append(shown)
        if self.last("a") > self.bounds[-1]:
            self.linked += len(shown)


def _raw_end(page: str, tag: str, at: int) -> int:
    """Where the end tag of a raw-text element begins; -1 if there is none."""
    found = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE | re.ASCII).search(page, at)
    return found.start() if found else -1


def _nested_ends(page: str, tag: str) -> dict[int, int]:
    """Start of each element of a kind -> start of the end tag that closes it, for those closed."""
    ends, opened = {}, []
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*", re.IGNORECASE | re.ASCII).finditer(page):
        if not m[1]:
            if tag not in FOREIGN or m[0][-1] != "/":
                opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.start()
    return ends


def leaves_of(page: str) -> list[Leaf]:
    """The leaf blocks of a page in order: decoded, white space collapsed, empty ones left out.

    One pass over the page, whatever its faults: unclosed quotes end at the next ``>``, unclosed
    elements where HTML lets them end, comments and raw text at the end of the page.
    """
    out = _Blocks()
    at, quoted = 0, True
    nested: dict[str, dict[int, int]] = {}
    while True:
        tag_at = page.find("<", at)
        if tag_at < 0:
            out.text(page[at:])
            break
        if tag_at > at:
            out.text(page[at:tag_at])
        if page.startswith("<!--", tag_at):
            end = page.find("-->", tag_at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        name = _NAME.match(page, tag_at + 1)
        if not name:
            if page.startswith(("<!", "<?", "</"), tag_at):
                end = page.find(">", tag_at)
                at = len(page) if end < 0 else end + 1
            else:
                out.text("<")
                at = tag_at + 1
            continue
        end = _TAG_END.match(page, name.end()) if quoted else None
        if end:
            stop = end.end()
        else:
            quoted = False  # no tag further on can be closed outside quotes
            stop = page.find(">", name.end()) + 1 or len(page)
        tag, closing = name[1].lower(), page[tag_at + 1] == "/"
        at = stop
        if closing:
            out.end(tag)
        elif tag in SKIPPED or tag == "xmp":
            if tag in FOREIGN and page[stop - 2 : stop] == "/>":
                continue
            if tag in NESTED:
                if tag not in nested:
                    nested[tag] = _nested_ends(page, tag)
                end_at = nested[tag].get(tag_at, -1)
            else:
                end_at = _raw_end(page, tag, stop)
            if end_at >= 0 or tag in TO_THE_END:
                at = len(page) if end_at < 0 else end_at
            if tag == "xmp":  # shown as it stands
                out.start(tag, page[name.end() : stop - 1])
                out.text(page[stop:at].replace("&", "&amp;"))
        else:
            out.start(tag, page[name.end() : stop - 1])
    out.flush()
    return out.leaves


def features(leaves: list[Leaf]) -> np.ndarray:
    """A row per leaf: tag path, hashed words, and numbers about length, links and place."""
    out = np.zeros((len(leaves), DIM), np.float32)
    n = max(1, len(leaves))
    for i, leaf in enumerate(leaves):
        out[i, list(leaf.path)] = 1
        words = _WORDS.findall(leaf.text.lower())
        if words:
            hashed = np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % WORD_DIM
            out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(hashed, minlength=WORD_DIM) / len(words)
        chars = len(leaf.text)
        out[i, PATH_DIM + WORD_DIM :] = (
            np.log1p(len(words)) / 5, min(1.0, leaf.linked / chars), leaf.text[-1] in ".!?…:;\"”", i / n, 1 - i / n,
            min(len(words), 20) / 20, sum(map(leaf.text.count, ".,;!?")) / max(1, len(words)),
        )
    return out
