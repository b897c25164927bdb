"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source's documents, in scan order, are packed into blocks of ``block`` words. A
source's share of the mix is a number of slots; multinomial draws, each from what the sources have
left, say how many slots of each source an output shard gets. A source's slot j stands for epoch
j div n of its n blocks, and there for the block that a keyed Feistel permutation of [0, n) puts at
j mod n; slots and blocks are joined by (source, block index). The last slot of a source is cut so that
its words are the target rounded down. An epoch holds every block once and there are two at most, so
no document is taken more than twice.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share ``share`` times all
words; a target stops at ``most`` times its source's size and the excess is shared again by weight.

The driver holds one entry for each source, and the shards' plan: a row for each shard and source, with at
most about ``SHARDS`` shards whatever the input. Documents, blocks and slots stay distributed. No key holds a
whole source: rows are keyed by source and input partition, or by source and block; slots meet blocks by a
sort-merge join, as their number grows with the input. Inside a shard, slots stand at pseudorandom places.

``mix_sizes`` says how much of each document the mix takes, ``mix_blocks`` gives the mix itself, block by
block in shards, and ``mix_documents`` gives it as documents.

Cases: a null or empty text has size 0, takes part in no block and is taken 0 times; a null source is a
source of its own; repeated rows are documents of their own; null ids stay null; the operator names its
own columns by position, so that further columns with any names do no harm; an empty table, or one
without any word, gives targets of 0. The same rows in the same partitions give the same mix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, slices, utf8, written

WEIGHTS, SHARE, MOST, BLOCK, SHARDS, SEED = (5, 2, 1), 1.5, 2, 256, 4096, 7
#: Rows (a source and input partition each) up to which where they start is broadcast.
STARTS_ROWS = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target words of sources (in their order) of these sizes."""
    goal = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), share * sum(sizes)
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        above = [i for i in sorted(open_) if unit * weights[i % len(weights)] > most * sizes[i] or not sizes[i]]
        for i in above:
            goal[i] = float(most * sizes[i])
            left -= goal[i]
        if not above:
            for i in open_:
                goal[i] = unit * weights[i % len(weights)]
            break
        open_ -= set(above)
    return goal


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _halves(n: np.ndarray) -> np.ndarray:
    """Bits of each half of the least even-width domain that holds [0, n)."""
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64)
    return np.maximum(np.uint64(1), (bits + np.uint64(1)) // np.uint64(2))


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False, rounds: int = 4) -> np.ndarray:
    """Place of ``at`` in a pseudorandom permutation of [0, n) named by ``key``, or with ``back`` what has that place.

    A Feistel network over a power of four, walked until inside.
    """
    n, key, x, todo = n.astype(np.uint64), key.astype(np.uint64), at.astype(np.uint64), np.arange(len(at))
    half = _halves(n)
    mask = (np.uint64(1) << half) - np.uint64(1)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(rounds):
            step = _mix64(k * np.uint64(8) + np.uint64(rounds - 1 - r if back else r))
            if back:
                left, right = right ^ (_mix64(left + step) & m), left
            else:
                left, right = right, left ^ (_mix64(right + step) & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


@dataclass(frozen=True)
class Source:
    """A source's name, size, target, number of blocks, slots and words of its last slot."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_words: int


def source_plan(name: str | None, index: int, size: int, target: float, block: int, seed: int) -> Source:
    """How many slots hold ``floor(target)`` words, given where the epochs' permutations put the partial block."""
    n, words = -(-size // block), int(target)
    if not words:
        return Source(name, size, target, n, 0, 0)
    epochs, rest = divmod(words, size)
    slots = epochs * n
    tail = size - (n - 1) * block  # words of the last block
    if not rest:
        last = block if n > 1 else tail
        return Source(name, size, target, n, slots, last)
    k = -(-rest // block)
    place = int(permuted(np.array([n - 1]), np.array([n]), np.array([epoch_key(seed, index, epochs)]), back=True)[0])  # of the last, partial block
    if place >= k - 1:
        given = block * (k - 1) + (tail if place == k - 1 else block)
    else:
        given = block * (k - 1) + tail
    if given < rest:
        return Source(name, size, target, n, slots + k + 1, rest - given)
    own = tail if place == k - 1 else block
    return Source(name, size, target, n, slots + k, rest - (given - own))


def epoch_key(seed: int, index, epoch):
    """Key of a permutation, of numbers or of arrays of them."""
    return ((seed * 1_000_003 + index) * 1_000_003 + epoch) & (1 << 60) - 1


def shard_plan(slots: list[int], shard_slots: int | None = None, seed: int = SEED) -> np.ndarray:
    """Rows (shard, source, first slot, slots, place before, slots of the shard) by multinomial draws from what each source has left.

    A shard has ``shard_slots`` slots; by default 16, or what makes ``SHARDS`` shards if these would be more.
    """
    shard_slots = shard_slots or max(16, -(-sum(slots) // SHARDS))
    left, done, out, rng, shard = np.array(slots, np.int64), np.zeros(len(slots), np.int64), [], np.random.default_rng(seed), 0
    while (total := int(left.sum())) > 0:
        size = min(total, shard_slots)
        drawn = rng.multinomial(size, left / total)
        over = int(np.maximum(drawn - left, 0).sum())
        drawn = np.minimum(drawn, left)
        for i in np.argsort(drawn - left, kind="stable") if over else ():  # what a used-up source can't give, those with most left do
            more = min(over, int(left[i] - drawn[i]))
            drawn[i], over = drawn[i] + more, over - more
        some = np.flatnonzero(drawn)
        out.append(np.stack([np.full(len(some), shard), some, done[some], drawn[some], np.cumsum(drawn[some]) - drawn[some], np.full(len(some), size)], 1))
        left, done, shard = left - drawn, done + drawn, shard + 1
    return np.concatenate(out) if out else np.empty((0, 6), np.int64)


def numbered(rows: DataFrame, schema: str) -> DataFrame:
    """Rows (source, size, ...) with their input partition, place there and the words of their source before them there."""

    def run(batches):
        task, row, seen = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            codes, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
            sizes = np.asarray(batch.column(1), np.int64)
            by = np.argsort(codes, kind="stable")
            total = np.cumsum(sizes[by]) - sizes[by]
            heads = np.flatnonzero(np.concatenate([[True], codes[by][1:] != codes[by][:-1]])) if len(by) else np.empty(0, np.int64)
            first = np.repeat(total[heads], np.diff([*heads, len(by)]))
            local = np.empty(len(by), np.int64)
            local[by] = total - first + np.array([seen.get(names[c], 0) for c in codes[by][heads]]).repeat(np.diff([*heads, len(by)])).astype(np.int64)
            for c, size in zip(codes[by][heads], np.add.reduceat(sizes[by], heads) if len(heads) else (), strict=True):
                seen[names[c]] = seen.get(names[c], 0) + int(size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, task), pa.int32()), pa.array(np.arange(row, row + batch.num_rows)), pa.array(local)],
                [*batch.schema.names, "part", "row", "local"],
            )
            row += batch.num_rows

    return rows.mapInArrow(run, f"{schema}, part int, row long, local long")


@dataclass(frozen=True)
class Mix:
    """The plan of a mix: where each source's words of an input partition start (source, part, k, before, source_size, target), and takes.

    A take (part, row, k, shard, place, epoch, block, inside, from, words) says that so many words of a row, from
    ``from`` on, stand at ``inside`` in the block at a place of a shard.
    """

    sources: list[Source]
    starts: DataFrame
    takes: DataFrame

    def met(self, rows: DataFrame) -> DataFrame:
        """Rows (source, part, ...) with what ``starts`` says of them: by source and input partition, so that no key holds a whole source."""
        starts = self.starts.withColumnRenamed("source", "s").withColumnRenamed("part", "p")
        return rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")


def plan_mix(rows: DataFrame, block: int = BLOCK, shard_slots: int | None = None, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> Mix:
    """Draw a mix of numbered rows (source, size, part, row, local), which stand written."""
    spark = rows.sparkSession
    here = written(rows.groupBy("source", "part").agg(F.sum("size").alias("n")))
    totals = {r[0]: (int(r[1]), int(r[2])) for r in here.groupBy("source").agg(F.sum("n"), F.count("*")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    goals = targets([totals[s][0] for s in names], weights, share, most)
    sources = [source_plan(s, i, totals[s][0], g, block, seed) for i, (s, g) in enumerate(zip(names, goals, strict=True))]
    index = spark.createDataFrame([(s.name, i, s.size, s.target) for i, s in enumerate(sources)], "x string, k int, source_size long, target double")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = here.select("source", "part", F.coalesce(before, F.lit(0)).alias("before")).join(index, F.col("source").eqNullSafe(F.col("x"))).drop("x")
    starts = F.broadcast(starts) if sum(n for _, n in totals.values()) <= STARTS_ROWS else starts
    drawn = shard_plan([s.slots for s in sources], shard_slots, seed)
    names = ("shard", "k", "first", "n", "offset", "of")
    plan = spark.createDataFrame(pa.table({c: drawn[:, i] for i, c in enumerate(names)}), ", ".join(f"{c} long" for c in names))
    slots = plan.select(F.col("shard").cast("int"), F.col("k").cast("int"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"), (F.col("offset") - F.col("first")).alias("shift"), "of")
    blocks, last = [s.blocks for s in sources], [(s.slots - 1, s.last_words) for s in sources]

    def place(batches):
        many, ends, words = np.array(blocks or [1]), np.array([x[0] for x in last] or [0]), np.array([x[1] for x in last] or [0])
        for batch in batches:
            shard, k, j, shift, of = (np.asarray(c, np.int64) for c in batch.columns)
            epoch = j // many[k]
            got = permuted(j % many[k], many[k], epoch_key(seed, k, epoch))
            at = permuted(j + shift, of, epoch_key(seed, -1 - shard, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(epoch), pa.array(got), pa.array(np.where(j == ends[k], words[k], block).astype(np.int64))], ["shard", "k", "place", "epoch", "block", "cut"])

    slots = slots.mapInArrow(place, "shard int, k int, place long, epoch long, block long, cut long")
    mix = Mix(sources, starts, slots)
    placed = mix.met(rows.where("size > 0"))
    at = F.col("before") + F.col("local")
    spans = placed.select("k", "part", "row", "size", at.alias("at"), F.explode(F.sequence(F.expr(f"(before + local) div {block}"), F.expr(f"(before + local + size - 1) div {block}"))).alias("block"))
    low, high = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = spans.select("k", "block", "part", "row", (low - F.col("at")).alias("from"), (low - F.col("block") * block).alias("inside"), (high - low).alias("n"))
    taken = F.least(F.col("n"), F.col("cut") - F.col("inside"))
    takes = pieces.hint("merge").join(slots, ["k", "block"]).where(F.col("inside") < F.col("cut"))
    return Mix(sources, starts, takes.select("part", "row", "k", "shard", "place", "epoch", "block", "inside", F.col("from"), taken.alias("words")))


def counted(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> list:
    """The columns source and size that a mix needs."""
    return [F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")]


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """id, size, source, source_size, target and taken (words that the mix takes) of every row."""
    rows = docs.select(*counted(docs, text_col, source_col), F.col(id_col).cast("long").alias("id"))
    rows = written(numbered(rows, "source string, size long, id long"))
    mix = plan_mix(rows, **options)
    taken = mix.takes.groupBy("part", "row").agg(F.sum("words").alias("taken"))
    return mix.met(rows).hint("merge").join(taken, ["part", "row"], "left").select("id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def runs(takes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(epoch, from, to) of takes (epoch, from, words), those that continue one another joined."""
    out: list[tuple[int, int, int]] = []
    for epoch, a, n in sorted(takes):
        if out and out[-1][0] == epoch and out[-1][2] == a:
            out[-1] = (epoch, out[-1][1], a + n)
        else:
            out.append((epoch, a, a + n))
    return out


def word_slice(text: str, a: int, b: int) -> str:
    """Words a to b of a text with what stands between them; all of a text whole."""
    raw = utf8(text)
    words = raw.split()
    if (a, b) == (0, len(words)):
        return text
    at, spans = 0, []
    for w in words[:b]:
        at = raw.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    return raw[spans[a][0] : spans[b - 1][1]].decode()


def texts_taken(docs: DataFrame, text_col: str, source_col: str, options: dict, takes_of) -> tuple[DataFrame, Mix]:
    """The rows (doc, takes) that a mix takes any word of, with the takes that ``takes_of`` makes structs of; texts move once."""
    names = docs.columns
    whole = docs.select(*counted(docs, text_col, source_col), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("doc"))
    whole = written(numbered(whole, f"source string, size long, doc {whole.schema['doc'].dataType.simpleString()}"))
    mix = plan_mix(whole.select("source", "size", "part", "row", "local"), **options)
    takes = mix.takes.groupBy("part", "row").agg(F.collect_list(takes_of).alias("takes"))
    return whole.select("part", "row", "doc").hint("merge").join(takes, ["part", "row"]).select("doc", "takes"), mix


def mix_blocks(docs: DataFrame, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus in blocks: shard, place (from 0 in the shard), source, epoch, block, words and text of every slot."""
    picked, mix = texts_taken(docs, text_col, source_col, options, F.struct("k", "shard", "place", "epoch", "block", "inside", "from", "words"))
    at = docs.columns.index(text_col)
    fields = ("k", "shard", "place", "epoch", "block", "inside", "words")

    def cut(batches):
        for whole in batches:
            for batch in slices(whole):
                texts, rows = pc.struct_field(batch.column(0), [at]).to_pylist(), []
                for text, some in zip(texts, batch.column(1).to_pylist(), strict=True):
                    words = utf8(text).split()
                    rows += [(*(t[f] for f in fields), b" ".join(words[t["from"] : t["from"] + t["words"]]).decode()) for t in some]
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [*fields, "piece"])

    pieces = picked.mapInArrow(cut, "k int, shard int, place long, epoch long, block long, inside long, words long, piece string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("inside", "piece"))), lambda p: p["piece"]), " ")
    blocks = pieces.groupBy("shard", "place", "k", "epoch", "block").agg(F.sum("words").alias("words"), joined.alias("text"))
    names = docs.sparkSession.createDataFrame([(i, s.name) for i, s in enumerate(mix.sources)], "k int, source string")
    return blocks.join(names, "k").select("shard", "place", "source", "epoch", "block", "words", "text")


def mix_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: for each epoch a row with each run of a document's words that it takes.

    ``chars_col``, if there, becomes the length of the row's text.
    """
    picked, _ = texts_taken(docs, text_col, source_col, options, F.struct("epoch", "from", "words"))
    names, kind = docs.columns, picked.schema["doc"].dataType
    place = names.index(text_col)

    def cut(batches):
        for whole in batches:
            for batch in slices(whole):
                at, made, lengths = [], [], []
                texts = pc.struct_field(batch.column(0), [place]).to_pylist()
                for i, (text, some) in enumerate(zip(texts, batch.column(1).to_pylist(), strict=True)):
                    for _, a, b in runs([(t["epoch"], t["from"], t["words"]) for t in some]):
                        at.append(i)
                        made.append(word_slice(text, a, b))
                        lengths.append(len(made[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(made, pa.string()), pa.array(lengths, pa.int64())], ["doc", "text", "chars"])

    out = picked.mapInArrow(cut, f"doc {kind.simpleString()}, text string, chars long")
    value = lambda i, c: F.col("text") if c == text_col else F.col("chars").cast(docs.schema[c].dataType) if c == chars_col else F.col(f"doc.c{i}")
    return out.select(*[value(i, c).alias(c) for i, c in enumerate(names)])
