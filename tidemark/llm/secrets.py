"""Secret scan: fixed patterns, and character Markov models of random strings and identifiers.

The patterns find assignments, access keys and long hexadecimal runs. The models add spans that
no pattern covers: every maximal run of ``[A-Za-z0-9+/_=-]`` of ``min_length`` characters or more
is scored by the log-likelihood ratio of two first-order Markov chains over character, one of
random strings, one of ordinary identifiers. Both chains are trained from labelled samples: random
strings drawn over the usual alphabets (label 1), and the identifiers and words of a bounded,
hash-chosen sample of rows, whole texts (label 0), for which ``sample_rows`` is the bound. A run is reported
when its ratio per character reaches ``threshold`` and it holds a letter (a run of none is a number or a rule); what
a pattern covers of it is left to the pattern, and what then remains, of ``REST`` characters or more, is scored by itself.

Cases: a null or empty text has no spans; offsets count code points, end exclusive; equal texts give
equal spans; null ids stay null; further columns are not read; an empty table gives an empty result,
then with chains of the random label and built-in identifier words alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("assign", "access", "hex", "markov")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_ROWS, THRESHOLD, MIN_LENGTH, REST = 2000, 0.35, 20, 8
#: Common parts of identifiers, so that both chains exist for an empty table.
_PARTS = ("get", "set", "user", "name", "index", "value", "list", "count", "file", "path", "read", "write", "data", "table", "column", "row", "key", "size", "max", "min", "http", "config", "default", "version", "test", "page", "item", "id", "url", "image", "main", "event")

Span = tuple[int, int, str]


def pattern_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping in each kind."""
    spans, low = [], text.lower()
    if any(k in low for k in _KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return spans


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratio tables, random over ordinary: of a first character, and of a next one."""

    first: np.ndarray
    step: np.ndarray

    def ratio(self, run: str) -> float:
        """Mean log-likelihood ratio of a character of the run."""
        codes = _CODE[np.frombuffer(run.encode(), np.uint8)]
        return float(self.first[codes[0]] + self.step[codes[:-1], codes[1:]].sum()) / len(codes)


_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


def _chain(samples: Counter) -> tuple[np.ndarray, np.ndarray]:
    n = len(ALPHABET)
    first, step = np.full(n, 0.5), np.full((n, n), 0.5)
    for s, times in samples.items():
        codes = _CODE[np.frombuffer(s.encode(), np.uint8)]
        first[codes[0]] += times
        np.add.at(step, (codes[:-1], codes[1:]), times)
    return np.log(first / first.sum()), np.log(step / step.sum(1, keepdims=True))


def random_strings(n: int = 4000, seed: int = 9) -> list[str]:
    """Labelled random strings: alternately base64, alphanumeric, url-safe and hexadecimal alphabets."""
    rng, kinds = np.random.default_rng(seed), (ALPHABET[:64], ALPHABET[:62], ALPHABET[:62] + "_-", "0123456789abcdef")
    return ["".join(rng.choice(list(kinds[i % 4]), int(rng.integers(20, 65)))) for i in range(n)]


def train_markov(texts: list[str], seed: int = 9) -> MarkovPair:
    """Both chains; ordinary samples are the words of ``texts``, but for long ones with digits, which may be secrets, and joins of them as identifiers."""
    words: Counter = Counter()
    for t in texts:
        words.update(re.findall(r"[A-Za-z0-9_-]{2,}", t))
    words = Counter({w: n for w, n in sorted(words.items()) if not (len(w) >= 16 and _DIGIT.search(w)) and not any(a <= 0 < b for a, b, _ in pattern_spans(w))})
    rng = np.random.default_rng(seed)
    pool, joined = list((words + Counter(_PARTS)).items()), []
    ends = np.cumsum([n for _, n in pool])
    for i in range(4000):
        parts = [pool[int(j)][0] for j in np.searchsorted(ends, rng.integers(0, ends[-1], 3), "right")] if i % 2 else [_PARTS[int(j)] for j in rng.integers(0, len(_PARTS), 4)]
        joined.append(("_".join(parts), "-".join(parts), "".join(p.capitalize() for p in parts), "/".join(parts))[i // 2 % 4])
    f1, s1 = _chain(Counter(random_strings(seed=seed)))
    f0, s0 = _chain(words + Counter(joined))
    return MarkovPair(f1 - f0, s1 - s0)


@lru_cache(8)
def runs(min_length: int) -> re.Pattern:
    return re.compile(f"[A-Za-z0-9+/_=-]{{{min_length},}}")


def model_spans(text: str, model: MarkovPair, threshold: float = THRESHOLD, min_length: int = MIN_LENGTH) -> list[Span]:
    """Runs that look random and hold a letter."""
    return [(m.start(), m.end(), "markov") for m in runs(min_length).finditer(text) if _LETTER.search(m[0]) and model.ratio(m[0]) >= threshold]


def outside(span: Span, base: list[Span]) -> list[Span]:
    """The parts of a span that no base span covers."""
    out, at = [], span[0]
    for a, b, _ in sorted(s for s in base if s[0] < span[1] and span[0] < s[1]):
        if a > at:
            out.append((at, a, span[2]))
        at = max(at, b)
    return [*out, (at, span[1], span[2])] if at < span[1] else out


def find_secrets(text: str | None, model: MarkovPair, threshold: float = THRESHOLD, min_length: int = MIN_LENGTH) -> list[Span]:
    """All spans by start, then kind; what a pattern covers of a run is left to the pattern."""
    if not text:
        return []
    base = pattern_spans(text)
    added = []
    for s in model_spans(text, model, threshold, min_length):
        added += [p for p in outside(s, base) if p == s or (p[1] - p[0] >= REST and model.ratio(text[p[0] : p[1]]) >= threshold)]
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, spans: list[Span], mark: str = "[secret]") -> str | None:
    """The text with each span, overlapping ones as one, replaced by ``mark``."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end or end < 0:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def sample_texts(docs: DataFrame, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """The texts of about ``rows`` rows at most, chosen by the hash of the id: two narrow passes, no shuffle of texts."""
    n = docs.count()
    share = min(1.0, rows / max(n, 1))
    picked = docs.where(F.col(text_col).isNotNull() & (F.abs(F.xxhash64(F.lit("secrets"), F.col(id_col)) % 1_000_000) < int(share * 1_000_000) + 1))
    return [r[0] for r in picked.select(F.col(text_col).cast("string")).limit(2 * rows).collect()]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> MarkovPair:
    return train_markov(sample_texts(docs, id_col, text_col, sample_rows))


def scan_secrets(docs: DataFrame, model: MarkovPair, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_length: int = MIN_LENGTH, redacted: bool = False) -> DataFrame:
    """id, spans (start, end, kind) and, if asked for, the redacted text of every row: one map, no shuffle."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            spans = [find_secrets(t, model, threshold, min_length) for t in texts]
            made = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans], span)
            clean = [pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())] if redacted else []
            return pa.RecordBatch.from_arrays([batch.column(0), made, *clean], ["id", "spans", "redacted"][: 2 + len(clean)])

        return each

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, make, "id long, spans array<struct<start: long, end: long, kind: string>>" + ", redacted string" * redacted)


def redact_documents(docs: DataFrame, model: MarkovPair, text_col: str = "text", chars_col: str | None = "n_chars", threshold: float = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """All rows and columns of ``docs``, with the secrets of each text redacted and ``chars_col``, if there, brought up to date where they were."""
    names = docs.columns
    place, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, columns = batch.column(place).to_pylist(), list(batch.columns)
            clean = [redact(t, find_secrets(t, model, threshold, min_length)) for t in texts]
            columns[place] = pa.array(clean, batch.schema.field(place).type)
            if chars is not None:
                before = columns[chars].to_pylist()
                columns[chars] = pa.array([n if c == t else len(c) for n, c, t in zip(before, clean, texts, strict=True)], batch.schema.field(chars).type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return each

    return map_batches(docs, make, docs.schema)
