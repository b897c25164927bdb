"""Document log-likelihood by a gated recurrent language model over words.

Tokens are the words of a text, A-Z lower-cased, and one end. Counts of all training tokens are taken
over the whole corpus. The ``VOCAB`` most frequent tokens are the network's own words; every
other word stands for one of ``TAIL`` tail classes, named by its last two bytes. The output is factored:
a softmax over classes (frequency classes of the own words, and the tail classes), then one
over the words of a class; inside a tail class a word has (c + 1) / Z by its count c, with Z the sum of c + 1 over the
class's known words and 1 for unseen ones, so that a text's probability is proper.

Training is truncated backpropagation through time in numpy. A warm start on a bounded sample of
training rows (``WARM_ROWS``) gives all tasks the same network; then every task goes on from it
over every token of all training rows of its partition, and the networks are averaged, weighted by
tokens. Scoring carries the state across windows, so that a document is scored whole.

Cases: a null or empty text is the end token alone; white space parts words only; repeated rows are scored each for itself; a
null id is learned from and keeps its row; without any training row all counts are 0 and the network is
untrained; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, utf8, written

HIDDEN, VOCAB, HEAD, CLASSES, TAIL = 16, 4000, 200_000, 32, 32
WINDOW, STREAMS, CHUNK, RATE, WARM_ROWS, SEED = 32, 512, 500_000, 1e-2, 800, 8
#: Bytes of text that are scored together; a longer text is alone.
BYTES = 48 << 20
#: Bytes of text that are split into words together.
PART = 4 << 20
END = b"\n"  # no word holds white space


def tokens(text: str | None) -> list[bytes]:
    return [*utf8(text).lower().split(), END]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def split(texts: pa.Array) -> pa.ListArray:
    """The words of texts as ``tokens`` has them, without the end; white space at either end of a text leaves an empty word there."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))


def place(texts: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Of the tokens of all texts in order: each one's text, its place in ``known`` (-1: unknown), and the unknown ones as words."""
    parts, ends = split(texts), np.arange(len(texts))
    words = pa.concat_arrays([parts.flatten().cast(pa.binary()), pa.array([END] * len(ends), pa.binary())])
    row = np.concatenate([np.repeat(ends, parts.value_lengths().to_numpy()), ends])
    at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
    order = np.argsort(row, kind="stable")
    order = order[pc.binary_length(words).to_numpy()[order] > 0]
    row, at = row[order], at[order]
    return row, at, words.take(pa.array(order[at < 0])).dictionary_encode()


@dataclass
class Layout:
    """The network's words by falling count, their classes (start of each; the words of one stand together) and tail masses.

    ``places`` has the words of which more than the tail class is known, the network's own first; ``logs`` their log10(count + 1).
    """

    words: list[bytes]
    starts: np.ndarray
    tail_mass: np.ndarray
    places: dict[bytes, int] = field(default_factory=dict)
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def make(cls, words: list[bytes], counts: np.ndarray, tail_mass: np.ndarray, vocab: int = VOCAB) -> Layout:
        """Of words by falling count the first ``vocab`` are the network's own, in classes of about equal shares of the roots of the counts."""
        own = words[:vocab]
        share = np.cumsum(np.sqrt(counts[:vocab].astype(np.float64)))
        cuts = np.searchsorted(share, np.arange(1, CLASSES) * (share[-1] / CLASSES)) if len(own) else []
        starts = np.unique(np.concatenate([[0], np.asarray(cuts, np.int64) + 1, [len(own)]]))
        return cls(own, starts[starts <= len(own)], tail_mass, {w: i for i, w in enumerate(words)}, np.log10(counts + 1.0))

    def __post_init__(self) -> None:
        n = len(self.words)
        self._net = np.array([i if i < n else n + tail_class(w) for i, w in enumerate(self.places)] + [0], np.int32)
        self._classes = np.concatenate([np.repeat(np.arange(self.classes), np.diff(self.starts)), self.classes + np.arange(TAIL)]).astype(np.int32)

    @property
    def classes(self) -> int:
        return len(self.starts) - 1

    def find(self, toks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of tokens (-1: unknown), which are unknown, and the network's ids: own words by place, others as ``len(words)`` and their class."""
        at = np.fromiter(map(self.places.get, toks, repeat(-1)), np.int32, len(toks))
        ids, rest = self._net[at], np.flatnonzero(at < 0)
        if len(rest):
            ids[rest] = [len(self.words) + tail_class(toks[i]) for i in rest.tolist()]
        return at, rest, ids

    def encode(self, toks: list[bytes]) -> np.ndarray:
        return self.find(toks)[2]

    def by_place(self, at: np.ndarray) -> np.ndarray:
        """The network's ids of known places; unknown ones get any."""
        return self._net[at]

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return self._classes[ids]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _safe(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no exponential of an output (a row of weights a class or word) overflows; states are within -1 and 1."""
    return float((np.abs(weights).sum(1) + np.abs(bias)).max(initial=0)) < 80


def _exps(z: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of ``z``, which is used up, and their sum in each row; scaled by the row's greatest unless ``safe``."""
    if not safe:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


class Network:
    """Parameters: embedding E; gates' input W, recurrent U and bias b (reset, update, candidate); class softmax C, c; words V, v."""

    NAMES = ("E", "W", "U", "b", "C", "c", "V", "v")

    def __init__(self, layout: Layout, hidden: int = HIDDEN, seed: int = SEED):
        rng, n, k = np.random.default_rng(seed), len(layout.words) + TAIL, layout.classes + TAIL
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h, self.moments, self.steps = hidden, None, 0
        self.p = {"E": draw(n, hidden) * np.float32(np.sqrt(n) * 0.3), "W": draw(hidden, 3 * hidden), "U": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "C": draw(hidden, k), "c": np.zeros(k, np.float32), "V": draw(max(1, len(layout.words)), hidden), "v": np.zeros(max(1, len(layout.words)), np.float32)}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, x: np.ndarray) -> Network:
        at = 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = x[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self

    def step(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """New state from projected input (with bias) and state; columns are documents, so that gates are contiguous."""
        n = self.h
        u = self.p["U"].T @ h
        gates = u[: 2 * n]
        gates += x[: 2 * n]
        _sigmoid(gates)
        cand = u[2 * n :]
        cand *= gates[:n]
        cand += x[2 * n :]
        np.tanh(cand, out=cand)
        new = h - cand
        new *= gates[n:]
        new += cand
        return new


def by_class(layout: Layout, ids: np.ndarray, classes: np.ndarray):
    """(first word, last word, places) of own words, class by class."""
    own = np.flatnonzero(ids < len(layout.words))
    own = own[np.argsort(classes[own].astype(np.int16), kind="stable")]
    kinds, first = np.unique(classes[own], return_index=True)
    for k, places in zip(kinds, np.split(own, first[1:]), strict=True) if len(own) else ():
        yield int(layout.starts[k]), int(layout.starts[k + 1]), places


def train(net: Network, layout: Layout, ids: np.ndarray, rate: float = RATE, streams: int = STREAMS, window: int = WINDOW) -> int:
    """One pass of truncated backpropagation over a sequence of ids, as parallel streams; the tokens learned from. The network keeps the optimiser's moments."""
    end = layout.places.get(END, 0)
    streams = max(1, min(streams, len(ids) // window))
    n = len(ids) // streams
    if n < 1:
        return 0
    x = ids[: n * streams].reshape(streams, n)
    x = np.concatenate([np.full((streams, 1), end, x.dtype), x], 1)
    state = np.zeros((streams, net.h), np.float32)
    net.moments = net.moments or [{k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(3)]
    m, v, spare = net.moments
    for at in range(0, n, window):
        part = x[:, at : at + window + 1]
        state, grads = backward(net, layout, part[:, :-1], part[:, 1:], state)
        net.steps += 1
        t = net.steps
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        clip = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        step = rate * min(1.0, t / 20) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for k, g in grads.items():
            m[k] *= np.float32(0.9)
            m[k] += np.multiply(g, clip * np.float32(0.1), out=spare[k])
            v[k] *= np.float32(0.999)
            g *= g
            v[k] += np.multiply(g, clip * clip * np.float32(0.001), out=g)
            np.sqrt(v[k], out=g)
            g += np.float32(1e-8)
            net.p[k] -= np.divide(np.multiply(m[k], np.float32(step), out=spare[k]), g, out=spare[k])
    return n * streams


def backward(net: Network, layout: Layout, inputs: np.ndarray, goals: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The state after a window and the gradients of its mean loss; the state before is a constant."""
    p, n = net.p, net.h
    b, steps = inputs.shape
    x = p["E"][inputs.T]  # (steps, streams, n); in the recurrence columns are streams, so that gates are contiguous
    proj = np.matmul(p["W"].T, x.transpose(0, 2, 1))
    proj += p["b"][:, None]
    kind, forth = p["U"].dtype, np.ascontiguousarray(p["U"].T)
    hs, gates, (cands, uns) = np.empty((steps + 1, n, b), kind), np.empty((steps, 2 * n, b), kind), np.empty((2, steps, n, b), kind)
    hs[0] = state.T
    for t in range(steps):
        u = forth @ hs[t]
        _sigmoid(np.add(u[: 2 * n], proj[t, : 2 * n], out=gates[t]))
        uns[t] = u[2 * n :]
        cand = np.multiply(gates[t, :n], uns[t], out=cands[t])
        cand += proj[t, 2 * n :]
        np.tanh(cand, out=cand)
        new = np.subtract(hs[t], cand, out=hs[t + 1])
        new *= gates[t, n:]
        new += cand
    out = hs[1:].transpose(0, 2, 1).reshape(-1, n)
    ids, share = goals.T.reshape(-1), p["C"].dtype.type(1 / goals.size)
    classes = layout.class_of(ids)
    d = out @ p["C"]
    d += p["c"]
    d, sums = _exps(d, _safe(p["C"].T, p["c"]))
    d *= (share / sums)[:, None]
    d[np.arange(len(ids)), classes] -= share
    g = {"C": out.T @ d, "c": np.ones(len(d), d.dtype) @ d, "V": np.zeros_like(p["V"]), "v": np.zeros_like(p["v"])}
    dh = d @ p["C"].T
    safe = _safe(p["V"], p["v"])
    for lo, hi, at in by_class(layout, ids, classes):
        states, words = out[at], p["V"][lo:hi]
        d = states @ words.T
        d += p["v"][lo:hi]
        d, sums = _exps(d, safe)
        d *= (share / sums)[:, None]
        d[np.arange(len(at)), ids[at] - lo] -= share
        g["V"][lo:hi], g["v"][lo:hi] = d.T @ states, np.ones(len(d), d.dtype) @ d
        dh[at] += d @ words
    dh = np.ascontiguousarray(dh.reshape(steps, b, n).transpose(0, 2, 1))
    r, z = gates[:, :n], gates[:, n:]
    by_cand = (1 - z) * (1 - cands * cands)  # the new state by the candidate, the update and the reset
    by_update = (hs[:-1] - cands) * z * (1 - z)
    by_reset = by_cand * uns * r * (1 - r)
    into, carry = np.empty((steps, 3 * n, b), kind), np.zeros((n, b), kind)
    for t in range(steps - 1, -1, -1):
        dn = dh[t]
        dn += carry
        np.multiply(dn, by_reset[t], out=into[t, :n])
        np.multiply(dn, by_update[t], out=into[t, n : 2 * n])
        dcand = np.multiply(dn, by_cand[t], out=by_cand[t])
        np.multiply(dcand, r[t], out=into[t, 2 * n :])  # at the recurrent side
        carry = p["U"] @ into[t]
        carry += np.multiply(dn, z[t], out=dn)
    g["U"] = np.matmul(hs[:-1], into.transpose(0, 2, 1)).sum(0)
    into[:, 2 * n :] = by_cand
    given, by_input = inputs.T.reshape(-1), np.matmul(p["W"], into)
    g |= {"W": np.matmul(x.transpose(0, 2, 1), into.transpose(0, 2, 1)).sum(0), "b": into.sum((0, 2))}
    g["E"] = np.stack([np.bincount(given, by_input[:, k].ravel(), len(p["E"])) for k in range(n)], 1).astype(kind)
    return hs[-1].T.copy(), g


def log_likelihoods(net: Network, layout: Layout, docs: list[np.ndarray], window: int = 16, together: int = 2048) -> np.ndarray:
    """Natural log-probability of each document's ids, a tail word counting by its class alone; documents of like length go together."""
    out, order, end = np.zeros(len(docs)), np.argsort([-len(d) for d in docs], kind="stable"), layout.places.get(END, 0)
    table = np.ascontiguousarray((net.p["E"] @ net.p["W"] + net.p["b"]).T)
    for at in range(0, len(docs), together):
        group = order[at : at + together]
        lengths = np.array([len(docs[i]) for i in group])
        flat, begins = np.concatenate([docs[i] for i in group]), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h, before = np.zeros((net.h, len(group)), np.float32), np.full(len(group), end)
        for lo in range(0, int(lengths[0]), window):
            states, goals, rows = [], [], []
            for t in range(lo, min(lo + window, int(lengths[0]))):
                live = int(np.searchsorted(-lengths, -t, "left"))  # documents longer than t
                h = net.step(table.take(before[:live], 1), h[:, :live])
                before = flat[begins[:live] + t]
                states.append(h)
                goals.append(before)
                rows.append(group[:live])
            ids, row = np.concatenate(goals), np.concatenate(rows)
            out += np.bincount(row, window_scores(net, layout, np.ascontiguousarray(np.concatenate(states, 1).T), ids), len(docs))
    return out


def _log_shares(z: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """Log-softmax of each row of ``z``, which is used up, at one place."""
    if not safe:
        z -= z.max(1, keepdims=True)
    own = z[np.arange(len(z)), at]
    return own - np.log(_exps(z, True)[1])


def window_scores(net: Network, layout: Layout, states: np.ndarray, ids: np.ndarray, rows: int = 2048) -> np.ndarray:
    """Log-probability of each id after its state; by parts that stay in the processor's cache."""
    p, classes, got = net.p, layout.class_of(ids), np.empty(len(ids))
    safe = _safe(p["C"].T, p["c"]) and _safe(p["V"], p["v"])
    for at in range(0, len(ids), rows):
        part = slice(at, at + rows)
        z = states[part] @ p["C"]
        z += p["c"]
        got[part] = _log_shares(z, classes[part], safe)
    for lo, hi, places in by_class(layout, ids, classes):
        for at in range(0, len(places), rows) if hi - lo > 1 else ():
            part = places[at : at + rows]
            z = states[part] @ p["V"][lo:hi].T
            z += p["v"][lo:hi]
            got[part] += _log_shares(z, ids[part] - lo, safe)
    return got


def token_counts(texts: DataFrame, keep: int = 24 << 20) -> DataFrame:
    """word (binary), n over all texts (one column): counted in each task before the shuffle, of so many bytes of words at a time."""

    def run(batches):
        release()
        held, size, ends = [], 0, 0
        for whole in batches:
            for batch in slices(whole, 10_000, PART):
                held.append(split(batch.column(0)).flatten())
                size, ends = size + batch.nbytes, ends + batch.num_rows
                if size > keep:
                    yield from flush(held, ends)
                    held, size, ends = [], 0, 0
        yield from flush(held, ends)

    def flush(held: list[pa.Array], ends: int):
        if held:
            found = pc.value_counts(pa.chunked_array(held))
            word, n = found.field("values").cast(pa.binary()), found.field("counts")
            full = pc.greater(pc.binary_length(word), 0)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([word.filter(full), pa.array([END], pa.binary())]), pa.concat_arrays([n.filter(full), pa.array([ends], pa.int64())])], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The counts of the most frequent words, ``most`` at most: those from the least count on that leaves no more.

    The count is read off a histogram of fixed size (each count under 1024, then 64 bins for each doubling), so
    that no task sends more than belongs to the result. Of a first bin that is too large itself, words are chosen by their hash.
    """
    n = F.col("n")
    step = F.when(n < 1024, n).otherwise(F.floor(F.log2(n) * 64) + 1024 - 640).cast("long")
    cut, seen, share = None, 0, 1.0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("m"), F.min("n").alias("from")).collect(), key=lambda r: -r["step"]):
        if cut is not None and seen + r["m"] > most:
            break
        cut, share, seen = r["from"], min(1.0, 0.99 * most / r["m"]) if r["m"] > most else 1.0, seen + r["m"]
        if share < 1:
            break
    if cut is None:
        return {}
    chosen = counts.where(n >= cut)
    chosen = chosen.where(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else chosen
    return {bytes(r["word"]): int(r["n"]) for r in chosen.collect()}


def averaged(parts: DataFrame, start: np.ndarray) -> tuple[np.ndarray, int]:
    """The mean of the tasks' networks (piece, lot, weight, values) by weight, the start where none learned; and the whole weight."""

    def total(table: pa.Table) -> pa.Table:
        w = np.asarray(table["weight"].combine_chunks(), np.float64)
        values = np.asarray(table["values"].combine_chunks().flatten(), np.float64).reshape(len(w), -1)
        return pa.table({"piece": table["piece"][:1], "lot": table["lot"][:1], "weight": pa.array([w.sum()]), "values": pa.array([(w @ values / max(w.sum(), 1e-9)).astype(np.float32)], pa.list_(pa.float32()))})

    shape = "piece int, lot int, weight double, values array<float>"
    some = parts.groupBy("piece", "lot").applyInArrow(total, shape)  # in two steps, so that no group holds every task
    rows = some.groupBy("piece").applyInArrow(total, shape).collect()
    out = start.copy()
    for r in rows:
        if r["weight"] > 0:
            out[r["piece"] * PIECE : r["piece"] * PIECE + len(r["values"])] = r["values"]
    return out, int(max((r["weight"] for r in rows), default=0))


#: Values of a piece of a network, and tasks whose networks are averaged together first.
PIECE, LOT = 1 << 13, 256


@dataclass
class Counts:
    """Counts over the training tokens, written (word, n), their sum and number; the ``HEAD`` most frequent words by falling count, and their counts."""

    table: DataFrame
    total: int
    distinct: int
    words: list[bytes]
    head: np.ndarray


@dataclass
class Model:
    """Counts over the training tokens; the layout, the network and the tokens that it was refined on."""

    counts: Counts
    layout: Layout
    net: Network
    learned: int

    @property
    def total(self) -> int:
        return self.counts.total


def count(docs: DataFrame, held: Column, text_col: str = "text") -> Counts:
    """The counts over the rows for which ``held`` is false."""
    table = written(token_counts(docs.where(~held).select(F.col(text_col).cast("string").alias("text"))))
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = frequent(table, HEAD)
    words = sorted(head, key=lambda w: (-head[w], w))
    return Counts(table, int(total), int(distinct), words, np.array([head[w] for w in words], np.int64))


def fit(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", warm_rows: int = WARM_ROWS) -> Model:
    """Learn from the rows for which ``held`` is false."""
    spark = docs.sparkSession
    known = docs.where(~held).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = count(docs, held, text_col)
    kind = F.crc32(F.substring("word", -2, 2)) % TAIL
    mass = np.ones(TAIL)
    for r in counts.table.groupBy(kind.alias("kind")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        mass[r["kind"]] += r["n"]
    for w, n in zip(counts.words[:VOCAB], counts.head[:VOCAB].tolist(), strict=True):
        mass[tail_class(w)] -= n + 1
    layout = Layout.make(counts.words, counts.head, mass)
    net = Network(layout)
    drawn = F.pmod(F.xxhash64(F.lit("gru"), "id"), F.lit(1_000_000))
    n_rows = known.count()
    warm = known.where(drawn < int(min(1.0, warm_rows / max(n_rows, 1)) * 1_000_000) + 1).select("text").limit(2 * warm_rows).collect()
    train(net, layout, np.concatenate([np.empty(0, np.int32), *(layout.encode(tokens(r[0])) for r in warm)]), streams=STREAMS // 8)
    start, net.moments = net.flat(), None
    shared = spark.sparkContext.broadcast((layout, start))

    def refine(batches):
        layout, start = shared.value
        net, learned, held, size = Network(layout).load(start), 0, [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(layout.encode(tokens(text.as_py())))
                size += len(held[-1])
                if size > CHUNK:
                    ids = np.concatenate(held)
                    n = train(net, layout, ids, RATE / 2)
                    learned, held, size = learned + n, [ids[n:]], len(ids) - n
        while size:  # what the streams leave over is learned by fewer
            ids = np.concatenate(held)
            n = train(net, layout, ids, RATE / 2)
            learned, held, size = learned + n, [ids[n:]], len(ids) - n
        if learned:
            flat, lot = net.flat(), TaskContext.get().partitionId() // LOT
            pieces = [flat[i : i + PIECE] for i in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([lot] * len(pieces), pa.int32()), pa.array([float(learned)] * len(pieces)), pa.array(pieces, pa.list_(pa.float32()))], ["piece", "lot", "weight", "values"])

    flat, learned = averaged(known.select("text").mapInArrow(refine, "piece int, lot int, weight double, values array<float>"), start)
    net.load(flat)
    return Model(counts, layout, net, learned)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score and score of every row, whole texts."""
    return _scored(docs, model.counts, (model.layout, model.net), id_col, text_col)


def base(docs: DataFrame, counts: Counts, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``score`` that come from counts alone, by the same steps: id, n_tokens, n_known and base_score."""
    return _scored(docs, counts, None, id_col, text_col).drop("score")


def _scored(docs: DataFrame, counts: Counts, model: tuple[Layout, Network] | None, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens, n_known, base_score and score, which is null without a network.

    Counts of the ``HEAD`` most frequent tokens are broadcast; those of the others are joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts.words, np.log10(counts.head + 1.0), model))

    def run(batches):
        release()
        words, logs, model = shared.value
        known, task, row = pa.array(words, pa.binary()), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, 10_000, BYTES):
                ids, made = [], []
                for part in slices(batch, 10_000, PART):
                    made.append(counted(part.column(1), known, logs, model and model[0], ids))
                columns = [pa.concat_arrays(c) for c in zip(*made, strict=True)]
                if model:
                    columns[3] = pa.array(log_likelihoods(model[1], model[0], ids) / np.log(10) + columns[3].to_numpy())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, task), pa.int32()), pa.array(np.arange(row, row + n)), *columns], ["id", "part", "row", "n_tokens", "seen", "base", "own", "words", "times"])
                row += n

    def counted(texts: pa.Array, known: pa.Array, logs: np.ndarray, layout: Layout | None, ids: list[np.ndarray]) -> list[pa.Array]:
        """Of each text: tokens, those broadcast and their logs' sum, the logs of its tail words in their classes, and the other words with their numbers."""
        n = len(texts)
        row, at, rest = place(texts, known)
        here, other = at >= 0, row[at < 0]
        n_tokens, found = np.bincount(row, minlength=n), logs[at[here]]
        distinct, code = rest.dictionary, rest.indices.to_numpy()
        pair, times = np.unique(other * max(1, len(distinct)) + code, return_counts=True)
        text, code_of = np.divmod(pair, max(1, len(distinct)))
        offsets = pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32())
        tail = pa.nulls(n, pa.float64())
        if layout:
            n_own, classes = len(layout.words), np.array([tail_class(w) for w in distinct.to_pylist()] or [0])
            net_ids = layout.by_place(at)
            net_ids[at < 0] = n_own + classes[code]
            ids += np.split(net_ids, np.cumsum(n_tokens)[:-1])
            known_tail, in_tail = at >= n_own, net_ids >= n_own
            tail = pa.array(np.bincount(row[known_tail], logs[at[known_tail]], n) - np.bincount(row[in_tail], np.log10(layout.tail_mass)[net_ids[in_tail] - n_own], n))
        return [
            pa.array(n_tokens), pa.array(np.bincount(row[here], minlength=n)), pa.array(np.bincount(row[here], found, n)), tail,
            pa.ListArray.from_arrays(offsets, distinct.take(pa.array(code_of))), pa.ListArray.from_arrays(offsets, pa.array(times)),
        ]

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = written(picked.mapInArrow(run, "id long, part int, row long, n_tokens long, seen long, base double, own double, words array<binary>, times array<long>"))
    rest = first.select("part", "row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("part", "row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    more = rest.join(counts.table, "word").groupBy("part", "row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return first.join(more, ["part", "row"], "left").select(
        "id", "n_tokens", (F.col("seen") + zero("more")).alias("n_known"),
        (F.col("base") + zero("logs") - F.col("n_tokens") * F.lit(float(np.log10(counts.total + counts.distinct + 1)))).alias("base_score"),
        (F.col("own") + zero("logs")).alias("score"),
    )
