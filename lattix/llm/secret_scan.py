"""Operator 1, secret scans: three patterns, and a battery of randomness tests for strings that no pattern names.

Base spans are the pattern matches of every whole text. Besides, every unbroken run of encoding characters is cut at '='
(a name from its value) and at base spans, and each piece of `SHORTEST` or more that is left is tested. Its encoding (hex,
base 32, letters, base 36 or base 64) is inferred from the characters in it, and gives the alphabet of size k:

- the battery asks whether the piece can be random in that alphabet: chi-squared uniformity of the k symbols, the runs of
  one character class (lower, upper, digit, else; vowels and consonants where all are letters of one case), and the
  serial correlation at lag one. A piece that one of the three rejects at `GATE` isn't random and isn't reported;
- the serial test asks whether it can be natural: pairs of neighbouring characters, case folded, under the chances that
  the corpus itself has in its words (runs shorter than `SHORTEST`, so no piece speaks for itself). With L the likelihood
  ratio of random against natural, natural strings reach L with a probability of 1 / L at most, which is the p value.

False discoveries are controlled over the whole corpus by the Benjamini-Hochberg rule, in each length class by itself, as
a test says less of a short string: executors count p values in fixed bins, and the driver sees only the bins.

Nulls and edges: a null text is an empty one, without spans. Rows with a null or repeated id are rows of their own.
Offsets are code points, ends exclusive; bytes that are not UTF-8 count as replacement characters, one for each piece
that a decoder replaces. An empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged_sketch, sketch_rows, slices
from .words import groups

# The patterns and least lengths of the base spans, by kind, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same spans as runs of any length with 32 or more characters
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16}

#: Shortest run that is tested.
SHORTEST = 20
#: Lower ends of the length classes.
CLASSES = (20, 32, 64, 128)
BINS, BIN = 80, 0.25  # of -log10 p
# Letter frequencies of English prose in percent, a to z.
LETTERS = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]) / 100
ALPHABETS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    ("base32", re.compile(r"[A-Z2-7]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("letters", re.compile(r"[a-z]+|[A-Z]+|[A-Z][a-z]+"), "abcdefghijklmnopqrstuvwxyz"),
    ("base36", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Deviation, in standard units, at which the battery rejects randomness.
GATE = 4.0

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
PIECE = re.compile(r"[^=]+(?:=+\Z)?")  # '=' ends a piece, and belongs to it as padding at the end of a run


# Folded characters: letters 0 to 25, a digit 26, other encoding characters 27; all else 28.
FOLDED, DIGIT, MARK, NONE = 28, 26, 27, 28
_FOLD = np.full(256, NONE, np.uint8)
_FOLD[_RUN] = MARK
for _i in range(26):
    _FOLD[[65 + _i, 97 + _i]] = _i
_FOLD[48:58] = DIGIT


def _prior() -> np.ndarray:
    """Chances of the next folded character before any text is seen: letters by frequency, and what follows what by class."""
    letters = LETTERS / LETTERS.sum()
    row = lambda a, b, c: np.concatenate([a * letters, [b, c]])
    return np.stack([row(0.96, 0.01, 0.03)] * 26 + [row(0.1, 0.75, 0.15), row(0.75, 0.2, 0.05)])


#: The prior's part in every chance, so that words of a kind which the corpus lacks stay natural, and its weight in characters before that.
PRIOR, PRIOR_PART, PRIOR_WEIGHT = _prior(), 0.2, 50.0


def natural_pairs(texts: list[bytes | None]) -> np.ndarray:
    """How often each folded character follows each other one within the words of the texts."""
    x = _FOLD[np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)]
    ends = np.flatnonzero(x == NONE)
    long = np.diff(ends, prepend=-1) > SHORTEST
    word = np.ones(len(x), bool)
    for end, before in zip(ends[long].tolist(), np.concatenate([[-1], ends])[:-1][long].tolist()):
        word[before + 1 : end] = False
    both = (x[:-1] != NONE) & (x[1:] != NONE) & word[:-1]
    return np.bincount(x[:-1][both].astype(np.int64) * FOLDED + x[1:][both], minlength=FOLDED * FOLDED).astype(np.int64)


def natural_model(counts: np.ndarray | None = None) -> np.ndarray:
    """Log chances of the next folded character, a row for each; the last row is that of a first character."""
    counts = np.zeros((FOLDED, FOLDED)) if counts is None or not len(counts) else counts.reshape(FOLDED, FOLDED).astype(float)
    rows = counts + PRIOR_WEIGHT * PRIOR
    first = counts.sum(0) + PRIOR_WEIGHT * PRIOR[0]
    rows, prior = np.concatenate([rows, first[None]]), np.concatenate([PRIOR, PRIOR[:1]])
    return np.log((1 - PRIOR_PART) * rows / rows.sum(1, keepdims=True) + PRIOR_PART * prior)


def inferred(s: str) -> tuple[str, str] | None:
    """The encoding and its alphabet."""
    return next(((name, alphabet) for name, pattern, alphabet in ALPHABETS if pattern.fullmatch(s)), None)


def deviations(s: str, name: str, alphabet: str) -> tuple[float, float, float]:
    """How far, in standard units, a piece is from random in its alphabet: uniformity (too uneven), runs and serial correlation (either way)."""
    t = s.translate(_URL) if name == "base64" else s.upper() if name == "base32" else s.lower()
    n, k = len(t), len(alphabet)
    at = np.array([alphabet.index(c) for c in t])
    chi = k / n * float((np.bincount(at, minlength=k).astype(float) ** 2).sum()) - n
    cube = 2 / (9 * (k - 1))
    z_chi = ((chi / (k - 1)) ** (1 / 3) - 1 + cube) / math.sqrt(cube)  # Wilson and Hilferty's normal approximation

    classes = np.array([("aeiouAEIOU".find(c) >= 0) if name == "letters" else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in alphabet])
    share = np.bincount(classes) / k
    change = 1 - float((share**2).sum())
    spread = change * (1 - change) + 2 * (float((share**3).sum()) - (1 - change) ** 2)
    changes = int((np.diff(classes[at]) != 0).sum())
    z_runs = (changes - (n - 1) * change) / math.sqrt(max((n - 1) * spread, 1e-9))

    d = at - at.mean()
    lag = float((d[1:] * d[:-1]).sum() / max((d**2).sum(), 1e-9))
    return z_chi, z_runs, (lag + 1 / n) * math.sqrt(n)


_URL = str.maketrans("-_", "+/")
_NATURAL = natural_model()
_CHANCES: dict[str, np.ndarray] = {}


def _random_chances(name: str, alphabet: str) -> np.ndarray:
    """Log chances of each folded character in an alphabet."""
    if name not in _CHANCES:
        n = np.bincount(_FOLD[np.frombuffer(alphabet.encode(), np.uint8)], minlength=FOLDED)[:FOLDED]
        _CHANCES[name] = np.log(np.maximum(n, 1e-12) / len(alphabet))
    return _CHANCES[name]


def battery(s: str, natural: np.ndarray = _NATURAL) -> float | None:
    """The p value of a piece under natural text, 1 where the battery finds that it isn't random; None where it has no letter or no encoding."""
    s = s.rstrip("=").strip("-_/+")
    if len(s) < SHORTEST or not re.search("[A-Za-z]", s) or (kind := inferred(s)) is None:
        return None
    if kind[0] in ("hex", "base32") and s.isalpha():
        kind = ALPHABETS[2][0], ALPHABETS[2][2]
    if max(abs(z) if i else z for i, z in enumerate(deviations(s, *kind))) > GATE:
        return 1.0
    x = _FOLD[np.frombuffer(s.encode(), np.uint8)]
    drawn = float(_random_chances(*kind)[x].sum())
    meant = float(natural[FOLDED, x[0]] + natural[x[:-1], x[1:]].sum())
    return min(1.0, math.exp(max(meant - drawn, -43.7)))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out


def long_runs(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of runs of encoding characters of SHORTEST or more."""
    if len(raw) < SHORTEST:
        return []
    ends = np.flatnonzero(~_RUN[np.frombuffer(raw, np.uint8)])
    ends = np.concatenate([[-1], ends, [len(raw)]])
    hit = np.flatnonzero(np.diff(ends) > SHORTEST)
    return [(int(ends[i]) + 1, int(ends[i + 1])) for i in hit]


def decoded(raw: bytes | None) -> tuple[str, bytes]:
    """The text and its bytes; those of replacement characters where the bytes are not UTF-8."""
    raw = raw or b""
    try:
        return raw.decode("utf-8", "surrogatepass"), raw
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "replace")
        return text, text.encode()


def without(spans: list[tuple[int, int, int]], start: int, end: int) -> Iterator[tuple[int, int]]:
    """What sorted spans leave of a stretch."""
    for a, _, b in spans:
        if b <= start or a >= end:
            continue
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def scan_text(raw: bytes | None, natural: np.ndarray = _NATURAL) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """The base spans (start, kind, end) and the tested pieces (start, end, length class, bin) of one whole text."""
    text, raw = decoded(raw)
    spans, runs, tested = base_spans(text, raw), long_runs(raw), []
    if runs and len(text) != len(raw):  # bytes before each that begin no character
        inner = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 == 0x80)])
        runs = [(a - int(inner[a]), b - int(inner[b])) for a, b in runs]
    for a, b in runs:
        spans += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(text[a:b])]
    spans.sort()
    for a, b in runs:
        near = [x for x in spans if x[0] < b and x[2] > a] if spans else []
        for m in PIECE.finditer(text[a:b]):
            for start, end in without(near, a + m.start(), a + m.end()):
                if end - start >= SHORTEST and (p := battery(text[start:end], natural)) is not None:
                    tested.append((start, end, sum(end - start >= c for c in CLASSES) - 1, min(BINS - 1, int(-math.log10(p) / BIN))))
    return spans, tested


def _levels(counts: dict[tuple[int, int], int], rate: float) -> list[int]:
    """By length class, the first bin whose runs are reported: the Benjamini-Hochberg rule on binned p values."""
    out = []
    for c in range(len(CLASSES)):
        total = sum(n for (k, _), n in counts.items() if k == c)
        above, level = 0, BINS
        for b in range(BINS - 1, -1, -1):
            above += counts.get((c, b), 0)
            if above and 10 ** (-b * BIN) <= rate * above / total:
                level = b
        out.append(level)
    return out


@dataclass
class Learnt:
    """What all texts say together: the chances of natural pairs, and by length class the first bin that is reported."""

    natural: np.ndarray
    levels: list[int]


def learnt(docs: DataFrame, rate: float, text_col: str = "text") -> Learnt:
    """Two passes over all texts, for the natural pairs and for the p values; only counts of fixed size leave the executors."""
    texts = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some = np.zeros(FOLDED * FOLDED, np.int64), False
        for batch in slices(batches):
            for _, group in groups(batch.column(0).to_pylist()):
                table += natural_pairs(group)
            some = some or batch.num_rows > 0
        if some:
            yield from sketch_rows(table)

    natural = natural_model(merged_sketch(texts.mapInArrow(pairs, "piece int, data binary"), np.int64, np.add))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(t[2:] for t in scan_text(text, natural)[1])
        cls, bins, n = ([k[0] for k in counts], [k[1] for k in counts], list(counts.values()))
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int32()), pa.array(bins, pa.int32()), pa.array(n, pa.int64())], ["cls", "bin", "n"])

    counts = texts.mapInArrow(run, "cls int, bin int, n long").groupBy("cls", "bin").agg(F.sum("n").alias("n")).collect()  # classes x bins rows at most
    return Learnt(natural, _levels({(r.cls, r.bin): r.n for r in counts}, rate))


def reported(raw: bytes | None, about: Learnt) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and all spans (start, kind, end) of one whole text."""
    base, tested = scan_text(raw, about.natural)
    return base, sorted(base + [(a, 3, b) for a, b, c, bin_ in tested if bin_ >= about.levels[c]])


def scan(docs: DataFrame, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of every row; base and spans are arrays of (start, kind, end), kind a position in KINDS."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    about = learnt(docs, rate, text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [dict(zip(("start", "kind", "end"), s)) for s in spans]
        for batch in slices(batches):
            found = [reported(t, about) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([as_rows(f[i]) for f in found], span) for i in (0, 1))], ["doc_id", "base", "spans"])

    kind = "array<struct<start:int,kind:int,end:int>>"
    n = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return own.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}").select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), "base", "spans")


def joined(spans: str):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def redact_text(raw: bytes | None, about: Learnt) -> bytes | None:
    """The text with each span, or each chain of overlapping ones, replaced by the first one's kind in brackets; without spans as it is."""
    spans = reported(raw, about)[1]
    if not spans:
        return raw
    text, out, at = decoded(raw)[0], [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]).encode("utf-8", "surrogatepass")


def redacted(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """docs with every span that the scan reports redacted in text, and n_chars, where there is one, set anew there; all rows and columns stay."""
    about, columns, schema = learnt(docs, rate), docs.columns, docs.schema
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            new = [redact_text(t, about) for t in raw]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.binary()).view(pa.string())
            if "n_chars" in columns:
                i = columns.index("n_chars")
                lengths = [len(decoded(n)[0]) if n != t else c for n, t, c in zip(new, raw, cols[i].to_pylist())]
                cols[i] = pa.array(lengths, cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, columns)

    return docs.mapInArrow(run, schema)
