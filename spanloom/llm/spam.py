"""Keyword-stuffed and link-list pages by a hidden Markov model over lines.

A page is cut into segments: its lines, and long lines at ends of sentences and then at list marks or blanks, so that no
segment is longer than ``LONG_LINE`` and each has a vote of about its size. Each segment becomes one of
a few symbols (see ``SYMBOLS``) from what it holds: links, prices, separators, code, function words, and the share of
its words that the page overuses. A hidden Markov model with the states prose, link list, tag list and menu labels the
segments by Viterbi, so that a short or odd line takes the label of its surroundings. A page is flagged if the
segments that aren't prose hold more than half of its words; the words of link addresses count, and so does each ideograph.

The symbols' odds and the transitions are the parameters of the model, the same for all pages.

Defined results
* Null, empty and blank texts aren't flagged; repeated rows are judged each; the columns source and lang aren't read.
* Code, tool output and lists of sentences are symbols of prose.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PROSE, LINKS, TAGS, MENU = range(4)
STATES = ("prose", "link list", "tag list", "menu")
#: Symbols and the chance that a state emits each, in the order of STATES.
SYMBOLS = {
    "sentence": (0.42, 0.02, 0.02, 0.02),
    "code": (0.32, 0.02, 0.02, 0.02),
    "short": (0.22, 0.10, 0.14, 0.16),
    "stuffed": (0.04, 0.03, 0.30, 0.05),
    "links": (0.015, 0.75, 0.02, 0.10),
    "keywords": (0.02, 0.05, 0.35, 0.15),
    "product": (0.005, 0.01, 0.13, 0.05),
    "menu": (0.01, 0.02, 0.02, 0.45),
}
STAY = 0.9
FLAG_SHARE = 0.5
#: A word is overused if it makes up this share of a page's content words, and occurs so often.
OVERUSED_SHARE, OVERUSED_TIMES = 1 / 45, 4
LONG_LINE = 160

FUNCTION_WORDS = frozenset(
    """the a an is are was were be been to of in on at by for with and or not it its so which that this these those when if should can will i we you he they my our
    than then there has have had do does why how before after into from as but without because mostly until
    der die das den dem des ein eine einen einem ist sind und oder nicht mit von zu auf bei wenn weil wie ich wir nur noch aber im am für über jetzt früher waren es alle
    le la les un une des du de est sont et ou ne pas que qui dans sur avec pour par il je on tant si
    el los las una del es son y o no en con por para se lo al hasta cuando
    um uma os as com não e di che gli per non и в не на что с для
    的 了 在 是 我 把 到 这 有 个 为 会 而 不 请 先 再 应 该 如 果 后 没 其 么 从 就 都 和 与 被 让 能 很 过 还 吗""".split()
)
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_URL = re.compile(
    r"(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w./@-])[a-z0-9-]+(?:\.[a-z0-9-]+)+/[^\s<>\"')\]]*"
    r"|(?<![\w./@-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|org|net|info|biz|io|dev|co|eu|de|fr|es|it|uk|cn|jp|ru|local|example|test|invalid)(?![\w.(/-])",
    re.IGNORECASE,
)
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_BREAK = re.compile(r"</?(?:br|p|li|ul|ol|div|h\d|tr|td|table|body|html|section|nav|dd|dt)\b[^<>]*>", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_PRICE = re.compile(r"[$€£¥]\s?\d+(?:[.,]\d+)*|\b\d+[.,]\d{2}\b(?:\s?(?:[$€£¥]|EUR|USD))?")
_CODE = re.compile(
    r"[{}]|\(\)|\w\(\w|->|=>|::|==|\+=|^\s*(?:def|fn|let|const|return|if|for|import|class|self\.|use|pub|async|test)\b.*[:;({]?|;\s*$|^@@|^[+\-] {2,}\S|\w\.\w+\(|^\s*[A-Z_]{3,}=|^[MADR] \S+\.\w+|^-[rwx-]{9}|\[\d{4}-"
    r"|^\s*\w+: \d+$|\b[\w/]+\.(?:rs|py|ts|md|go|sql|toml|yaml)\b|\b\w+_\w+_?\d*\b|\b[0-9a-f]{7,}\b|(?<![#\w])[A-Za-z][a-z]+[A-Z]\w+\b|\bx[0-9]|^\$ |^>>> \S+\(|^\s*\|?[-:|\s]+\|?$|\.\.\. (?:ok|FAILED|ignored)"
)
_MENU_SEP = re.compile(r"\s(?:[|›»>•·]|::|/)\s")
_ASCII_WORD, _ASCII_HUMP, _ASCII_CAMEL = re.compile(r"[a-z]+(?:'[a-z]+)?"), re.compile("[a-z][A-Z]"), re.compile("(?<=[a-z])(?=[A-Z])")
_CAMEL = re.compile(r"(?<=[^\W\dA-Z_])(?=[A-Z])")
_COUNTED = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+")
_HREF = re.compile(r"href=[\"']([^\"']*)")
_HASHTAG = re.compile(r"#[^\W\d_]\w*")
_LINK_SIGN = re.compile(r"://|www\.|\.[a-z]+/|\.(?:com|org|net|info|biz|io|dev|co|eu|de|fr|es|it|uk|cn|jp|ru|local|example|test|invalid)\b", re.IGNORECASE)
_LISTED = re.compile(r"\s*(?:[-*•]\s*)?(?:tags?|keywords?|stichwörter|schlagwörter|etiquetas?|étiquettes?|mots[- ]clés|palabras clave|标签|关键词)\s*[:：]", re.IGNORECASE)
_LINE_END = re.compile("[\r\n\x0b\x0c\x85\u2028\u2029]+")
#: Pieces of a long stretch: up to a list mark, else to a blank, else of full length.
_PIECE = re.compile(rf".{{1,{LONG_LINE - 1}}}[,;|•·、，；\t]\s*|.{{1,{LONG_LINE}}}(?:\s+|$)|.{{1,{LONG_LINE}}}", re.DOTALL)
_MARKS = " \t,;|•·、，；"
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")


def segments(text: str) -> list[tuple[str, bool]]:
    """Lines, cut at block tags, and the pieces of long ones; true for whole lines."""
    out = []
    for line in _LINE_END.split(_BREAK.sub("\n", text)):
        if len(line) <= LONG_LINE:
            if line.strip():
                out.append((line, True))
            continue
        for part in _SENTENCE_END.split(line):
            out += [(p, False) for p in ([part] if len(part) <= LONG_LINE else _PIECE.findall(part)) if p.strip()]
    return out


def _count(plain: str) -> int:
    return len(_COUNTED.findall(plain))


def words_of(plain: str) -> list[str]:
    """Lower-case words of a text without links and markup; parts of joined names count each, and so does each ideograph."""
    if plain.isascii():
        return _ASCII_WORD.findall((_ASCII_CAMEL.sub(" ", plain) if _ASCII_HUMP.search(plain) else plain).lower())
    out = []
    for w in _WORD.findall(plain):
        if w.islower():
            out.append(w)
        elif not w.isascii() and _CJK.search(w):
            out += w
        elif w.isupper() or w[1:].islower():
            out.append(w.lower())
        else:
            out += _CAMEL.sub(" ", w).lower().split()
    return out


class Segment:
    """What a segment holds: words outside links, words outside anchors, and the length of what is linked."""

    def __init__(self, text: str, whole: bool = True):
        self.text, self.plain, self.linked, self.whole = text, text, 0, whole
        outside = text
        if "<" in text:
            anchors = [m.group(0) for m in _ANCHOR.finditer(text)]
            self.linked = sum(map(len, anchors))
            outside = _TAG.sub(" ", _ANCHOR.sub(" ", text)) if anchors else _TAG.sub(" ", text)
            self.plain = _TAG.sub(" ", text)
        self.outside = outside
        if _LINK_SIGN.search(text):
            self.linked += sum(map(len, _URL.findall(outside)))
            bare = _URL.sub(" ", self.plain)
            self.words = words_of(bare)
            self.rest = self.words if outside is self.plain or outside == self.plain else words_of(_URL.sub(" ", outside))
        else:
            self.words = words_of(self.plain)
            self.rest = self.words if outside == self.plain else words_of(outside)
        self.content = [w for w in self.words if w not in FUNCTION_WORDS]

    def weight(self) -> int:
        """Words as seen on the page, those of links and addresses included."""
        n = len(self.words) if self.plain is self.text and not self.linked else _count(self.plain)
        return n + sum(map(_count, _HREF.findall(self.text))) if "href" in self.text else n

    def is_code(self) -> bool:
        """The signs at the ends of a line hold for whole lines only, not where a long line was cut."""
        return bool(_CODE.search(self.outside if self.whole else "\0" + self.outside.strip(_MARKS)))


def symbol(seg: Segment, overused: set[str]) -> str:
    text, content, rest = seg.text, seg.content, seg.rest
    seen, n = max(1, len(text.strip())), max(1, len(rest))
    functional = len(rest) - len(content) if rest is seg.words else sum(w in FUNCTION_WORDS for w in rest)
    if seg.linked and (seg.linked / seen >= 0.5 and functional < 4 or seg.linked / seen >= 0.25 and functional <= 1):
        return "links"
    size = max(1, len(content))
    over = sum(w in overused for w in content) / size if overused else 0.0
    again = sum(k for k in Counter(content).values() if k > 1) / size if len(set(content)) < len(content) else 0.0
    stuffed = (over >= 0.6 or again >= 0.5) and len(content) >= 2
    listed = _LISTED.match(text)
    if functional / n >= 0.16 and len(rest) >= 4 and not stuffed and not listed:
        return "sentence"
    if listed or "#" in text and len(_HASHTAG.findall(text)) * 2 > len(text.split()):
        return "keywords"
    code = seg.is_code()
    if not code and functional / n < 0.15 and _PRICE.search(text):
        return "product"
    if not code and functional / n < 0.2 and len(_MENU_SEP.findall(text)) >= 2:
        return "menu"
    if stuffed and not code:
        return "stuffed"
    if code:
        return "code"
    if over >= 0.6 and content:
        return "stuffed"
    if len(content) >= 4 and functional / n < 0.12:
        return "keywords"
    return "short"


_EMIT = {s: [math.log(p) for p in ps] for s, ps in SYMBOLS.items()}
_STAY, _LEAVE = math.log(STAY), math.log((1 - STAY) / 3)
_START = [math.log(x) for x in (0.55, 0.15, 0.15, 0.15)]


def viterbi(symbols: list[str]) -> list[int]:
    """The likeliest states of a page's segments."""
    score, back = [a + b for a, b in zip(_START, _EMIT[symbols[0]], strict=True)], []
    for s in symbols[1:]:
        best = max(range(4), key=score.__getitem__)
        jump = score[best] + _LEAVE
        step = [k if score[k] + _STAY >= jump else best for k in range(4)]
        score = [max(score[k] + _STAY, jump) + e for k, e in enumerate(_EMIT[s])]
        back.append(step)
    k = max(range(4), key=score.__getitem__)
    out = [k]
    for step in reversed(back):
        k = step[k]
        out.append(k)
    return out[::-1]


def label(text: str) -> list[tuple[str, int, int]]:
    """(segment, state, weight) of a page."""
    parts = [Segment(*p) for p in segments(html.unescape(text) if "&" in text else text)]
    if not parts:
        return []
    counts = Counter(w for p in parts for w in p.content)
    total = sum(counts.values())
    overused = {w for w, n in counts.items() if n >= OVERUSED_TIMES and n >= OVERUSED_SHARE * total}
    states = viterbi([symbol(p, overused) for p in parts])
    return [(p.text, s, p.weight()) for p, s in zip(parts, states, strict=True)]


def spam_share(text: str | None) -> float:
    """Share of a page's text that isn't prose."""
    if not text or not text.strip():
        return 0.0
    rows = label(text)
    total = sum(w for _, _, w in rows)
    return sum(w for _, s, w in rows if s != PROSE) / total if total else 0.0


def shares(documents: DataFrame) -> DataFrame:
    """(doc_id, share) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([spam_share(t) for t in b.column("text").to_pylist()], pa.float64())], names=["doc_id", "share"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, share DOUBLE")


def found(documents: DataFrame) -> DataFrame:
    return shares(documents).where(f"share > {FLAG_SHARE}").select("doc_id")
