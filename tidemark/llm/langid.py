"""Language identification by error-correcting output codes.

Every language has a codeword of bits, and every bit a binary classifier over hashed byte
n-grams of the lower-cased text: the log-odds of the n-grams of the languages with that bit set against
the others, calibrated by a logistic fit. Decoding is loss-weighted: each bit's logistic loss counts by
its classifier's accuracy, and the codeword of least total loss wins. ``score`` is the winner's share
of the softmax over the codewords' negative losses; a winner whose share is under ``AMBIGUOUS_BELOW``, so
that others together are as near, flags the document as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows: at most about ``sample_rows`` rows,
an equal share for each language, chosen by the hash of the id, whole texts.

Cases: a null text, or one without any letter, is ``und`` with score 0; without any labelled row
every text is ``und``; equal texts get equal predictions; very long texts count whole; null ids stay
null; further columns are not read; an empty table gives an empty result. ``keep_identified`` rejects texts without a letter and
ambiguous ones (without a model only the former). A single learned language
is predicted for every text with a letter, with score 1.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

ORDERS, BITS, SAMPLE_ROWS, AMBIGUOUS_BELOW = (2, 3, 4), 14, 2000, 0.5
#: Distinct languages up to which their shares of the sample are broadcast.
BROADCAST_LANGS = 10_000
_CHUNK = 1 << 20
#: Bytes that n-grams see: ASCII non-letters become spaces.
_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def code_book(n: int, seed: int = 6) -> np.ndarray:
    """Codewords of ±1, a row a class: all distinct two-way splits for up to 5 classes, else the best of some random books."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        return np.array([[1, *s] for s in product((1, -1), repeat=n - 1)][1:], np.float32).T.copy()
    width, rng, best, far = max(15, ceil(10 * log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(64):
        book = np.where(rng.random((n, width)) < 0.5, 1, -1).astype(np.float32)
        book[0, np.abs(book.sum(0)) == n] *= -1
        near = ((width - book @ book.T) / 2 + width * np.eye(n)).min()
        if near > far:
            best, far = book, near
    return best


def document_runs(offsets: np.ndarray):
    """Ranges of whole documents of about a chunk of bytes together; a longer document is alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        yield first, last
        first = last


def buckets(data: np.ndarray, order: int, index: int) -> np.ndarray:
    """Bucket of the n-gram at each position; the last ``order - 1`` positions have none."""
    code = data[: len(data) - order + 1].astype(np.uint32)
    for k in range(1, order):
        code = (code << np.uint32(8)) | data[k : len(data) - order + 1 + k]
    code = code * np.uint32(2654435761)
    return ((code >> np.uint32(32 - BITS)) + np.uint32(index << BITS)).astype(np.int32)


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased, folded bytes of all texts with a space around each, and where each begins (then the end)."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    low = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), low, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(low) else np.empty(0, np.uint8)
    return _FOLD[data], offsets - offsets[0]


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, their codewords, the bits' classifiers (weights of buckets, scale, bias) and loss weights."""

    langs: list[str]
    book: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Mean weight of the n-grams of each text, for each bit; none reaches beyond its text."""
        data, offsets = folded(texts)
        none = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])
        sums, lengths = np.zeros((len(texts), self.weights.shape[1])), np.diff(offsets)
        for first, last in document_runs(offsets):
            end = int(offsets[last])
            for lo in range(int(offsets[first]), end, _CHUNK):  # a text of more than a chunk is alone, and in parts
                for index, order in enumerate(ORDERS):
                    part = data[lo : min(lo + _CHUNK + order - 1, end)]
                    if len(part) < order:
                        continue
                    ids = buckets(part, order, index)
                    for k in range(1, order):  # n-grams over the end of a text
                        over = offsets[first + 1 : last] - k - lo
                        ids[over[(over >= 0) & (over < len(ids))]] = len(self.weights)
                    starts = offsets[first:last]
                    at = starts[starts < lo + len(ids)] - lo if last - first > 1 else np.zeros(1, np.int64)
                    sums[first : first + len(at)] += np.add.reduceat(none[ids], at, axis=0)
        n = sum(np.maximum(lengths - order + 1, 0) for order in ORDERS)
        return sums / np.maximum(n, 1)[:, None]

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, and whether the decision is ambiguous, of each text."""
        if len(self.langs) == 1:
            n = len(texts)
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        margin = self.evidence(texts) * self.scale + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(1) for word in self.book], 1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = loss.argmin(1)
        score = share[np.arange(len(best)), best]
        return best, score, score < AMBIGUOUS_BELOW


def train(texts: list[str], langs: list[str]) -> LanguageModel | None:
    """Fit the classifiers of all bits on labelled texts; None without any."""
    names = sorted(set(langs))
    if not names:
        return None
    book, size = code_book(len(names)), len(ORDERS) << BITS
    counts = np.zeros((len(names), size))
    for k, name in enumerate(names):
        data, offsets = folded(pa.array([t for t, g in zip(texts, langs, strict=True) if g == name], pa.large_string()))
        for lo in range(0, len(data), _CHUNK):
            for index, order in enumerate(ORDERS):
                part = data[lo : lo + _CHUNK]
                if len(part) >= order:
                    counts[k] += np.bincount(buckets(part, order, index), minlength=size)
    rates = counts + 0.5
    for index in range(len(ORDERS)):
        own = slice(index << BITS, (index + 1) << BITS)
        rates[:, own] /= rates[:, own].sum(1, keepdims=True)
    weights = np.empty((size, book.shape[1]), np.float32)
    for b in range(book.shape[1]):
        yes, no = book[:, b] > 0, book[:, b] < 0
        weights[:, b] = np.log(rates[yes].mean(0)) - np.log(rates[no].mean(0)) if yes.any() and no.any() else 0
    ones = np.ones(book.shape[1])
    seen = LanguageModel(names, book, weights, ones, 0 * ones, ones).evidence(pa.array(texts, pa.large_string()))
    bits = book[[names.index(g) for g in langs]]
    scale, bias = calibrate(seen, bits)
    wrong = (((seen * scale + bias) * bits <= 0).sum(0) + 1) / (len(texts) + 2)
    trust = np.maximum(np.log((1 - wrong) / wrong), 0.1)
    return LanguageModel(names, book, weights, scale, bias, trust / trust.mean())


def calibrate(x: np.ndarray, bits: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Scale and bias of each bit by gradient descent on the logistic loss of standardised evidence, with a weak ridge."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    z, a, c = (x - mean) / std, np.ones(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(steps):
        g = -bits / (1 + np.exp(np.clip((z * a + c) * bits, -30, 30)))
        a -= 1.0 * ((g * z).mean(0) + 1e-3 * a)
        c -= 1.0 * g.mean(0)
    return a / std, c - a * mean / std


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """A model from at most about ``sample_rows`` rows with text and language, an equal share for each language."""
    known = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    kinds = counts.count()
    each = max(2, sample_rows // max(kinds, 1))
    shares = counts.select(F.col("lang").alias("of"), (F.least(F.lit(1.0), F.lit(each) / F.col("n")) * 1_000_000 + 1).cast("long").alias("share"))
    shares = F.broadcast(shares) if kinds <= BROADCAST_LANGS else shares
    drawn = known.join(shares, F.col("lang") == F.col("of")).where(F.abs(F.xxhash64(F.lit("langid"), "id") % 1_000_000) < F.col("share"))
    rows = sorted(tuple(r) for r in drawn.select("text", "lang").limit(2 * sample_rows + 2 * kinds).collect())
    return train([r[0] for r in rows], [r[1] for r in rows])


def predictions(texts: pa.Array, model: LanguageModel | None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Language, score and ambiguity of each text of a batch."""
    has = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model is None:
        n = len(texts)
        return pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))
    best, score, unsure = model.decide(texts)
    names = np.array([*model.langs, "und"], object)[np.where(has, best, len(model.langs))]
    return pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(has & unsure)


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, ambiguous of every row: one map, no shuffle."""

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), *predictions(batch.column(1), model)], ["id", "lang_pred", "score", "ambiguous"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, make, "id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows whose language is found and not ambiguous, in all columns of ``docs``. One map, no shuffle."""
    place = docs.columns.index(text_col)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, _, unsure = predictions(batch.column(place).cast(pa.string()), model)
            known = pc.fill_null(pc.match_substring_regex(batch.column(place).cast(pa.string()), r"\p{L}"), False) if model is None else pc.not_equal(found, "und")
            return batch.filter(pc.and_not(known, unsure))

        return each

    return map_batches(docs, make, docs.schema)
