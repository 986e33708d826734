"""Credentials in tool traffic: find and mask them without touching the text around.

Candidates are the values of assignment contexts: names of credentials with a value (configuration, code, JSON, XML,
environment, command-line flags), authorization headers, user info and query parameters of URLs, login lines, key blocks, and
a few published token formats. Each candidate is segmented into dictionary words by Viterbi; what no word
explains is the residual. A value is a secret if it is literal (no reference, placeholder or mask) and, by the
strength of its context, has a residual, digits or symbols; bare hashes and ids count in strong contexts only. Values
with blanks and short ones count where they are quoted in a strong context.

Every pattern reads a text in linear time: names are found by their last word, never by a prefix that could begin
anywhere; words that open a context (commands, BEGIN lines) are kept as a state of one pass.

Defined results
* Null and empty texts hold no secret. Spans of a text don't overlap; the one of the most exact context, then the first and longest, stays.
* Key blocks count with both their BEGIN and END line and some body; public keys and certificates don't.
* Rows are scanned each, repeated ones too; whole texts are scanned whatever their length.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import tokenizer_path

WORDS = "word_bpe_49k.json"
MASK = "[REDACTED]"
#: Least residual characters of a value in a weak context.
WEAK_RESIDUAL = 6
#: A shorter value counts only quoted in a strong context and with both letters and digits or symbols.
LEAST_LENGTH = 6

_Q = r"""(?P<q>\\?["'`])"""
_BARE = r"""[^\s"'`\\,;<>(){}\[\]&|]"""
#: A value: quoted to the same quote, or bare.
_VALUE = rf"""(?:{_Q}(?P<v>[^"'`\\\n]*)(?P=q)|(?P<b>{_BARE}+)(?P<call>\(|\[)?)"""

_STRONG = (
    r"pass(?:word|wd|phrase|wort)?|pwd|secret|credentials?|passcode"
    r"|(?:api|access|auth|refresh|deploy|private|session|bearer|client|signing|encryption|master|secret|account|admin)[_\-]?(?:token|key|secret|pass(?:word|wd)?)"
)
_WEAK = r"token|key|sig(?:nature)?|auth"
#: The end of a name; whatever stands before it belongs to the name.
_NAME = rf"(?:(?P<strong>{_STRONG})|(?P<weak>{_WEAK}))"
_SEP = r"""(?:\s*:\s*(?:&\s*(?:'\w+\s+)?)?(?:str|String|string)\s*=\s*|\s*:\s*String::from\(\s*|\\?["'`]?\s*(?::=|=>|=|:)[ \t]*)"""

_ASSIGN = re.compile(_NAME + _SEP + _VALUE, re.IGNORECASE)
_FLAG = re.compile(r"(?<![\w-])--?(?P<name>[a-z\-]*(?:(?P<strong>pass(?:word|wd|phrase)?|pwd|secret|(?:api|access|auth|private)-?(?:token|key))|(?P<weak>token|key)))[ \t]+" + _VALUE, re.IGNORECASE)
_ENV = re.compile(r"\bENV[ \t]+\w*?(?:(?P<strong>" + _STRONG + r")|(?P<weak>" + _WEAK + r"))[ \t]+" + _VALUE, re.IGNORECASE)
_XML = re.compile(r"<(?P<tag>[\w\-]*?(?:(?P<strong>" + _STRONG + r")|(?P<weak>" + _WEAK + r")))>(?P<v>[^<>\n]*)</(?P=tag)>", re.IGNORECASE)
_OTHERS = [  # contexts that are strong whatever the name
    re.compile(r"authorization\\?[\"']?\s*+[:=]\s*+\\?[\"']?(?:bearer|basic|token|apikey|digest)\s+(?P<v>[^\s\"'`\\,;<>]+)", re.IGNORECASE),
    re.compile(r"(?<=[a-z0-9+.\-])://[^\s/:@\"'\\<>]*:(?P<v>[^\s/@\"'\\<>]+)@", re.IGNORECASE),
    re.compile(r"\blogin\s+\S+\s+(?:password|passwd)\s+(?P<v>[^\s\"'\\]+)", re.IGNORECASE),
    re.compile(r"\b(?:login|credentials?|account) (?:for|to|at) (?:\S++(?:(?<=:)|\s*+:)\s*+\S++|[^\s:]++:\S++) / (?P<v>[^\s\"'\\]+)", re.IGNORECASE),
    re.compile(r"(?:pass(?:wort|word|phrase|e)|contraseña|clave|parola|senha|密码|口令)\s*+(?:(?<=\s)(?:für|for|of|to|de|para|pour|di|von|zu)\s++)?(?:(?<=\s)|(?<=[码令]))[a-z0-9_.\-]+\.[a-z0-9_\-]+(?::\d+)?\s*+[:：]\s*+(?P<v>[^\s\"'\\，。]+)", re.IGNORECASE),
]
#: Commands with a credential among their options; a line end or a quote ends the command.
_COMMAND = re.compile(
    r"(?P<end>[\n\"'])|\b(?P<web>curl|wget|http)\b|(?i:\b(?P<sql>mysql|mysqldump|mariadb|mysqladmin)\b)|\s(?:-u|--user)[ =]\\?[\"']?[\w.\-@]+:(?P<user>[^\s\"'\\]+)|\s-p(?P<p>[^\s\"'\\]+)"
)
_PGPASS = re.compile(r"(?<![\w/@.:\-])[\w\-]+(?:\.[\w\-]+)+:\d{2,5}:[\w*\-]+:[\w.\-]+:(?P<v>[^\s:\"'\\]+)(?=[\s\"'\\]|$)")
_FORMATS = re.compile(
    r"(?<![\w\-+/=.])(?P<v>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[\w\-]{18,}|xox[abprs]-[\w\-]{10,}|npm_[A-Za-z0-9]{30,}|AIza[\w\-]{30,}"
    r"|sk-(?:live-|proj-|test-)?[A-Za-z0-9]{20,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,})(?![\w\-+/=])"
)
_BLOCK = re.compile(r"-----(?P<side>BEGIN|END) (?P<kind>(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")

_TRIGGER = r"(?iuU)pass|pwd|secret|token|key|auth|credential|login|account (?:for|to|at) |http\b|sig|contrase|clave|parola|senha|密码|口令|://[^\s/]*@|mysql|maria|curl|wget|AKIA|gh[pousr]_|glpat|xox|npm_|AIza|sk-|eyJ|\d:[\w*-]+:[\w.-]+:"

_REFERENCE = re.compile(
    r"^(?:\$\{|\$\(|\$[A-Za-z_]\w*$|%\(|%[A-Z_]+%$|\{\{|\{|!(?:secret|vault|ref|env|sub)\b|<|\[|os\.|env[.(\[]|process\.|vault[.:/(]|getenv|config[.\[]|settings\.|self\.|secrets?[.:/\[]|ssm:|arn:|kms:|ref\+|file:"
    r"|/(?:run|etc|var|home|opt|usr|tmp|secrets?|mnt|work)/)",
    re.IGNORECASE,
)
_PLACEHOLDER = re.compile(
    r"redacted|placeholder|change[_\-]?me|example|dummy|your[_\-]|my[_\-]?(?:secret|password|token|key)$|insert|replace|to[_\-]?do|\.\.\.|masked|hidden|removed|omitted"
    r"|^(?:null|none|nil|undefined|true|false|empty|test|foobar|unset|n/a)$",
    re.IGNORECASE,
)
_MASKED = re.compile(r"^[^A-Za-z0-9]*$|^(.)\1*$|\*{3,}|•|x{6,}|X{6,}|#{3,}|_{4,}")
_IDENTIFIER = re.compile(r"^&?(?:[a-z_]\w*)(?:(?:::|\.)[a-z_]\w*)*$", re.IGNORECASE)
_HASH = re.compile(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$", re.IGNORECASE)


class Dictionary:
    """Words with the cost of their rank, and Viterbi segmentation over them."""

    def __init__(self, words: dict[str, int]):
        self.cost = {w: math.log(r + 2) for w, r in words.items()}
        self.longest = max(map(len, words), default=0)
        self.single = math.log(len(words) + 2) + 2.0  # an unexplained character costs more than any word

    @classmethod
    def load(cls, path: str) -> Dictionary:
        """Whole words of a public vocabulary, in the order of its ids (its merges were learnt by frequency)."""
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        return cls({w[:-4]: i for w, i in vocab.items() if w.endswith("</w>") and len(w) >= 7 and w[:-4].isalpha()})

    def residual(self, value: str) -> int:
        """Letters and digits of the cheapest segmentation that no word covers; runs of up to four digits count as explained."""
        text = re.sub(r"(?<!\d)\d{1,4}(?!\d)", " ", value) if not re.search(r"[A-Za-z]\d+[A-Za-z]", value) else value
        return sum(self._run(x) for x in re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).lower()))

    def _run(self, run: str) -> int:
        best, left = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
        for i in range(1, len(run) + 1):
            best[i], left[i] = best[i - 1] + self.single, left[i - 1] + 1
            for n in range(3, min(self.longest, i) + 1):
                c = self.cost.get(run[i - n : i])
                if c is not None and best[i - n] + c < best[i]:
                    best[i], left[i] = best[i - n] + c, left[i - n]
        return left[-1]


@lru_cache(2)
def dictionary(path: str) -> Dictionary:
    return Dictionary.load(path)


def is_secret(value: str, strong: bool, quoted: bool, words: Dictionary, hashes: bool = False) -> bool:
    """Whether the value of a context is a literal secret. ``hashes``: bare hashes and ids count although the name is weak."""
    if not value or _REFERENCE.search(value) or _MASKED.search(value) or _PLACEHOLDER.search(value):
        return False
    if re.fullmatch(r"[\d.,:\-+eE%]+", value) or not (strong or hashes) and _HASH.match(value):
        return False
    if len(value) < LEAST_LENGTH:
        return strong and quoted and bool(re.search(r"[A-Za-z]", value)) and bool(re.search(r"[^A-Za-z_\-./: ]", value))
    residual = words.residual(value)
    if " " in value:
        return strong and quoted and residual >= WEAK_RESIDUAL and residual * 2 >= sum(map(str.isalnum, value))
    if not strong:
        return residual >= WEAK_RESIDUAL and bool(re.search(r"\d", value)) and not (_IDENTIFIER.match(value) and residual < len(value) // 2)
    if quoted:
        return bool(re.search(r"[^A-Za-z_\-./:]", value)) or residual >= 4
    return bool(re.search(r"[^A-Za-z_\-./:]", value)) and not re.fullmatch(r"[a-z]+(?:_[a-z]+)*_\d{1,5}", value) or residual >= 8


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Key blocks from a BEGIN line to the first END line of the same kind."""
    begun: dict[str, re.Match] = {}
    for m in _BLOCK.finditer(text):
        if m["side"] == "BEGIN":
            begun.setdefault(m["kind"], m)
        elif b := begun.pop(m["kind"], None):
            body = text[b.end() : m.start()]
            if len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 16 and not re.search(r"redacted|\*{3}|<", body, re.IGNORECASE):
                yield b.start(), m.end()


def _commands(text: str) -> Iterator[tuple[re.Match, str]]:
    """(match, group) of credentials among the options of a command."""
    web = sql = False
    for m in _COMMAND.finditer(text):
        kind = m.lastgroup
        if kind == "end":
            web = sql = False
        elif kind == "web":
            web = True
        elif kind == "sql":
            sql = True
        elif kind == "user" and web or kind == "p" and sql:
            yield m, kind


def _in_query(text: str, at: int) -> bool:
    """Whether the name before ``at`` is one of a query's parameters: what signs or opens an address is no checksum."""
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.-"):
        at -= 1
    return at > 0 and text[at - 1] in "?&"


def find(text: str | None, words: Dictionary) -> list[tuple[int, int]]:
    """Spans of the secrets of a text."""
    if not text:
        return []
    spans = dict.fromkeys(_blocks(text), 0)  # span -> how exact its context is: key blocks, forms of their own, names

    def add(m: re.Match, group: str, strong: bool, quoted: bool, rank: int = 2) -> None:
        if is_secret(m[group], strong, quoted, words, not strong and _in_query(text, m.start())):
            spans[m.span(group)] = min(rank, spans.get(m.span(group), rank))

    for pattern in (_ASSIGN, _FLAG, _ENV):
        for m in pattern.finditer(text):
            strong = pattern is _FLAG or m["strong"] is not None
            if m["v"] is not None:
                add(m, "v", strong, True)
            elif not m["call"]:
                add(m, "b", strong, False)
    for m in _XML.finditer(text):
        add(m, "v", m["strong"] is not None, True)
    for pattern in _OTHERS:
        for m in pattern.finditer(text):
            add(m, "v", True, True, 1)
    for m, group in _commands(text):
        add(m, group, True, True, 1)
    for m in _PGPASS.finditer(text):
        add(m, "v", True, True, 1)
    for m in _FORMATS.finditer(text):
        add(m, "v", False, True)
    out: list[tuple[int, int]] = []  # sorted, apart from one another
    for s, e in sorted(spans, key=lambda x: (spans[x], x[0], -x[1])):
        i = bisect_left(out, (s, e))
        if (i == 0 or out[i - 1][1] <= s) and (i == len(out) or e <= out[i][0]):
            out.insert(i, (s, e))
    return out


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def fields(paths: DataFrame, claw: DataFrame) -> DataFrame:
    """(src, row_id, field, text) of the tool traffic."""
    parts = [
        paths.select(F.lit("supported_paths").alias("src"), "row_id", F.lit("arguments").alias("field"), F.col("payload.arguments").alias("text")),
        paths.select(F.lit("supported_paths").alias("src"), "row_id", F.lit("output").alias("field"), F.col("payload.output").alias("text")),
        claw.select(F.lit("clawline_sample").alias("src"), "row_id", F.lit("stdout").alias("field"), F.col("stdout").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("text is not null")


def scan(texts: DataFrame, path: str | None = None) -> DataFrame:
    """(src, row_id, field, start_pos, end_pos) of each secret. Texts without any word that begins a context aren't sent to Python."""
    path = path or tokenizer_path(texts.sparkSession, WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(path)
        for b in batches:
            at, start, end = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for s, e in find(t, words):
                    at.append(i), start.append(s), end.append(e)
            rows = b.select(["src", "row_id", "field"]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["src", "row_id", "field", "start_pos", "end_pos"])

    hit = texts.where(F.col("text").rlike(_TRIGGER)).select("src", "row_id", "field", "text")
    return hit.mapInArrow(run, "src STRING, row_id BIGINT, field STRING, start_pos INT, end_pos INT")


def masked(texts: DataFrame, path: str | None = None) -> DataFrame:
    """All texts, with each secret replaced by MASK; ``n_secrets`` counts them."""
    path = path or tokenizer_path(texts.sparkSession, WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(path)
        for b in batches:
            found = [find(t, words) for t in b.column("text").to_pylist()]
            text = [mask(t, f) for t, f in zip(b.column("text").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.select(["src", "row_id", "field"]).columns, pa.array(text, pa.string()), pa.array([len(f) for f in found], pa.int32())], names=["src", "row_id", "field", "text", "n_secrets"])

    return texts.select("src", "row_id", "field", "text").mapInArrow(run, "src STRING, row_id BIGINT, field STRING, text STRING, n_secrets INT")


def found(paths: DataFrame, claw: DataFrame) -> DataFrame:
    return scan(fields(paths, claw))
