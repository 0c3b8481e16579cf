"""Secret scan: fixed patterns, and guess costs of values in a credential context.

The patterns (assignments, access keys, long hexadecimal runs) give the base spans.  The
method then looks at every value that stands in a credential context (the assignments and
a wider set of names, separators and addresses with a password) and prices it: the least
cost over all segmentations into dictionary words, dates and years, repeats, sequences,
keyboard walks and brute-force characters, in decimal digits of guesses.  A value that
would take at least ``MIN_DIGITS`` digits of guesses becomes a span of kind ``guess``;
placeholders such as ``changeme`` or ``password123`` stay below it.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pedigraph.llm.common import at, enter, pick, text_slices

WORDS_PATH = os.environ.get("PEDIGRAPH_TOKENIZERS", "/opt/tokenizers") + "/word_bpe_49k.json"
MIN_DIGITS = 8.0

# Kinds in their order and the base patterns.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

WIDER = re.compile(r"""(?i:pwd|passphrase|passcode|credentials?|private_?key|access_?key|client_?secret|auth_?token|bearer)"""
                   r"""["']?(?:\x20*+(?:=>|:=|[:=])\x20*+|\x20++)["']?([A-Za-z0-9+/_.=!@#$%^&*-]+)""", re.ASCII)
ADDRESS = re.compile(r"://[^\s:/@]++:([^\s:/@]{3,}+)@")
# Every match of a pattern holds one of these lowered strings: a cheap test before the pattern runs.
_ASSIGN_CUES = ("passw", "secret", "token", "api")
_WIDER_CUES = ("pwd", "passphrase", "passcode", "credential", "key", "client", "auth", "bearer", "://")

# Values that people type first, most frequent first.
COMMON = ("password 123456 12345678 qwerty admin letmein welcome changeme secret token example test default root "
          "login guest user pass master dragon monkey iloveyou sunshine princess abc123 placeholder redacted hidden "
          "null none true false your my the key value string here insert replace dummy sample demo xxxx todo").split()
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {a: set() for row in _ROWS for a in row}
for _r, _row in enumerate(_ROWS):
    for _c, _a in enumerate(_row):
        for _r2, _c2 in ((_r, _c - 1), (_r, _c + 1), (_r + 1, _c), (_r + 1, _c - 1), (_r - 1, _c), (_r - 1, _c + 1)):
            if 0 <= _r2 < len(_ROWS) and 0 <= _c2 < len(_ROWS[_r2]):
                _NEAR[_a].add(_ROWS[_r2][_c2])
_LEET = str.maketrans("@4301$57!", "aaeoisstl")
_DATE = re.compile(r"(?=((?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|"
                   r"(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d))")
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")
UNIT = 16  # characters of a repeated unit, at most
_TURN = 0.66
_PART = math.log10(2)


@dataclass(frozen=True)
class Span:
    """A finding: code points, end exclusive; ``value`` is where the secret itself begins."""

    start: int
    kind: str
    end: int
    value: int
    digits: float | None = None


def load_ranks(path: str = WORDS_PATH) -> dict[str, int]:
    """Word -> rank: the common values, then the whole words of a public vocabulary in its order."""
    with open(path, encoding="utf-8") as fh:
        vocabulary = json.load(fh)["model"]["vocab"]
    whole = sorted((i, t[:-4]) for t, i in vocabulary.items() if t.endswith("</w>") and len(t) >= 7 and t[:-4].isalpha())
    ranks: dict[str, int] = {}
    for word in [*COMMON, *(w for _, w in whole)]:
        ranks.setdefault(word, len(ranks) + 1)
    return ranks


def _alphabet(value: str) -> float:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and not value.isdigit() and re.search(r"\d", value):
        return math.log10(16)
    size = 10 * bool(re.search(r"[0-9]", value)) + 26 * bool(re.search(r"[a-z]", value)) + 26 * bool(re.search(r"[A-Z]", value))
    return math.log10(max(10, size + 33 * bool(re.search(r"[^0-9A-Za-z]", value))))


def _word_cost(piece: str, ranks: dict[str, int]) -> float | None:
    lower = piece.lower()
    rank, extra = ranks.get(lower), 0.0
    if rank is None:
        plain = lower.translate(_LEET)
        rank = ranks.get(plain) if plain != lower else None
        if rank is None:
            return None
        extra = _PART * sum(a != b for a, b in zip(plain, lower))
    if piece != lower:  # usual capitals are cheap, a mixture costs its choices
        extra += _PART if piece[1:] == lower[1:] or piece.isupper() else math.log10(max(2, math.comb(len(piece), sum(c.isupper() for c in piece))))
    return math.log10(rank) + extra + _PART


class _Least:
    """The least of f(i) + log10(j - i) over the starts i added so far.

    A start that an earlier one has caught up with never leads again, as the logarithms
    only come closer; so the list stays short.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []

    def add(self, i: int, f: float) -> None:
        self.starts.append((i, f))

    def at(self, j: int) -> float:
        least, kept = math.inf, []
        for i, f in self.starts:
            now = f + math.log10(j - i)
            if now < least:
                least = now
                kept.append((i, f))
        self.starts = kept
        return least


class _Walks:
    """Cheapest ends of keyboard walks or sequences of three or more characters: one list for the walk that is open."""

    def __init__(self, kind: str, value: str):
        self.kind, self.value = kind, value.lower()
        self.price = math.log10(47 if kind == "keys" else 26) + _PART
        self.begin, self.last, self.turns, self.open = 0, None, [0, 0], _Least()

    def _move(self, a: str, b: str) -> object:
        if self.kind == "keys":
            return None if b not in _NEAR.get(a, ()) else ord(b) - ord(a) if a.isdigit() else "letters"
        return ord(b) - ord(a) if a.isalnum() and b.isalnum() and abs(ord(b) - ord(a)) == 1 else None

    def at(self, j: int, best: list[float]) -> float:
        """With the character before j: walks may begin at j - 3 or earlier."""
        if j < 2:
            return math.inf
        move = self._move(self.value[j - 2], self.value[j - 1])
        turned = self.last is not None and move is not None and move != self.last
        if move is None or self.kind == "steps" and turned:
            self.begin, self.open = j - 1 if move is None else j - 2, _Least()
        self.turns.append(self.turns[-1] + turned)
        self.last = move
        if j - self.begin < 3:
            return math.inf
        self.open.add(j - 3, best[j - 3] - _TURN * self.turns[j - 1])
        return self.open.at(j) + _TURN * self.turns[j] + self.price


class _Repeats:
    """Cheapest ends of a unit of one length that stands twice or more; one list for each of its rotations."""

    def __init__(self, size: int, value: str, brute: float, ranks: dict[str, int]):
        self.size, self.value, self.brute, self.ranks = size, value, brute, ranks
        self.alike, self.lists = 0, {}

    def at(self, j: int, best: list[float]) -> float:
        size = self.size
        if j <= size or self.value[j - 1] != self.value[j - 1 - size]:
            self.alike = 0
            if self.lists:
                self.lists = {}
            return math.inf
        self.alike += 1
        if self.alike < size:
            return math.inf
        if j % size not in self.lists:
            unit = self.value[j - size:j]
            word = _word_cost(unit, self.ranks)
            self.lists[j % size] = (_Least(), min(size * self.brute, math.inf if word is None else word) - math.log10(size) + _PART)
        held, price = self.lists[j % size]
        held.add(j - 2 * size, best[j - 2 * size])
        return held.at(j) + price


def guess_digits(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses of the cheapest of all segmentations; 0 for an empty value.

    A span is a word of the list, a date, a year, a walk or sequence of three characters or more, or
    a unit of at most ``UNIT`` characters that stands twice or more, each with any start and end.
    A brute-force character costs the alphabet the value draws on, a separator ten choices.  The
    work grows with the length of the value.
    """
    brute, ending = _alphabet(value), {}
    for pattern, cost in ((_DATE, math.log10(365 * 120 * 4)), (_YEAR, math.log10(120))):
        for m in pattern.finditer(value):
            ending.setdefault(m.end(1), []).append((m.start(1), cost + _PART))
    parts = [_Walks("keys", value), _Walks("steps", value), *(_Repeats(size, value, brute, ranks) for size in range(1, min(UNIT, len(value) // 2) + 1))]
    longest = max(map(len, ranks), default=0)
    best = [0.0]
    for j in range(1, len(value) + 1):
        least = min(best[j - 1] + (1.0 if value[j - 1] in "-_./" else brute), *(part.at(j, best) for part in parts), math.inf)
        for i, cost in ending.get(j, ()):
            least = min(least, best[i] + cost)
        for i in range(max(0, j - longest), j):
            if best[i] < least:
                cost = _word_cost(value[i:j], ranks)
                if cost is not None:
                    least = min(least, best[i] + cost)
        best.append(least)
    return best[-1]


def find(text: str | None, ranks: dict[str, int], min_digits: float = MIN_DIGITS) -> list[Span]:
    """All spans of a text by start, then kind; a null text is empty."""
    text = text or ""
    low = text.lower()
    found, values = [], {}
    if any(cue in low for cue in _ASSIGN_CUES):
        for m in ASSIGN.finditer(text):
            values[m.start(2), m.end(2)] = m.group(2)
            if m.end(2) - m.start(2) >= 6:
                found.append(Span(m.start(), "assign", m.end(), m.start(2)))
    found += [Span(m.start(), "access", m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [Span(m.start(), "hex", m.end(), m.start()) for m in HEX.finditer(text)]
    if any(cue in low for cue in _WIDER_CUES):
        for pattern in (WIDER, ADDRESS):
            for m in pattern.finditer(text):
                values[m.start(1), m.end(1)] = m.group(1)
    for (start, end), value in values.items():
        digits = guess_digits(value, ranks)
        if digits >= min_digits:
            found.append(Span(start, "guess", end, start, digits))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, spans: list[Span], mark: str = "[secret]") -> str | None:
    """The text with every secret replaced; overlapping findings become one mark."""
    if not spans:
        return text
    out, done, inside = [], 0, sorted((s.value, s.end) for s in spans)
    for start, end in inside:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


_SCHEMA = ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_digits double")
_STRUCT = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
                     ("n_guess", pa.int64()), ("max_digits", pa.float64())])


def _shared(spark: SparkSession, words_path: str):
    return spark.sparkContext.broadcast(load_ranks(words_path))


def scan(docs: DataFrame, text_col: str = "text", words_path: str = WORDS_PATH, min_digits: float = MIN_DIGITS):
    """A struct column of findings for a text column: counts, digest and list of spans.

    Texts of any length are scanned whole; null and empty texts have no finding (counts 0,
    the digest of the empty list).  The word list is read on the driver and is as large as
    the vocabulary file, whatever the corpus.
    """
    ranks = _shared(docs.sparkSession, words_path)

    @F.arrow_udf(_SCHEMA)
    def run(texts: pa.Array) -> pa.Array:
        enter("secrets")
        rows = []
        for text in (t for part in text_slices(texts) for t in part):
            spans = find(text, ranks.value, min_digits)
            base = [s for s in spans if s.kind != "guess"]
            kinds = [s.kind for s in spans]
            digits = [s.digits for s in spans if s.digits is not None]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                         hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(digits), max(digits, default=None)))
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_digits"]
        return pa.array([dict(zip(names, row)) for row in rows], _STRUCT)

    return run(F.col(text_col))


def redacted(docs: DataFrame, text_col: str = "text", words_path: str = WORDS_PATH, min_digits: float = MIN_DIGITS) -> DataFrame:
    """The rows with the secrets of the text replaced; every row and column stays, null texts stay null."""
    ranks = _shared(docs.sparkSession, words_path)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        enter("secrets")
        return pa.chunked_array([pa.array([redact(t, find(t, ranks.value, min_digits)) for t in part], pa.string()) for part in text_slices(texts)],
                                pa.string()).combine_chunks()

    names = docs.columns
    i = at(docs, text_col)
    numbered = docs.toDF(*[f"_{k}" for k in range(len(names))])
    return numbered.withColumn(f"_{i}", run(F.col(f"_{i}"))).toDF(*names)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and priced spans of every document."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return docs.select("doc_id", scan(docs).alias("found")).select("doc_id", "found.*")
