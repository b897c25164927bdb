"""Packing of documents into token windows by Karmarkar-Karp multiway differencing.

A document's ids, with the end id after them, are as many full windows as it holds, alone, and a rest. The
rests of a group of documents (an Arrow batch, at most ``group`` documents and ``GROUP_BYTES`` of text) are dealt whole to k windows
by multiway differencing: every rest begins as a partial partition of its own; the two of largest
imbalance merge, the fullest window of one with the emptiest of the other, until one is left. k begins at
the total over the capacity, rounded up, and rises by one whenever a window exceeds the capacity, as long as
the padding stays within ``PADDING`` of the tokens. Only then is anything cut: what stands over the capacity of a window, of
its longest rest, goes to the windows with room, and is cut again only where no window holds it whole.
All windows are padded to the capacity but those that end at a power of two.

Ids are made once for each distinct word that a worker meets, if the vocabulary marks the ends of words, so that
its normaliser and pre-tokeniser never look across white space and a text's ids are its words' ids in order; with any
other vocabulary texts are encoded whole. The words that a worker keeps are bounded (``KEPT_WORDS``); others are
encoded again with each batch, and are let go when the worker's next task is of another stage. The vocabulary file is found where it is opened, on the executors.

Cases: a null or empty text is the end id alone; texts of any length are packed whole; repeated rows
are packed each for itself; null ids stay null; further columns are not read; an empty table gives
an empty result. Sequence ids are unique across tasks, and the same again when a task is rerun.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, utf8

WINDOW, GROUP, GROUP_BYTES, PADDING, END_ID, VOCABULARY, KEPT_WORDS = 4096, 2048, 64 << 20, 0.002, 2, "word_bpe_49k.json", 450_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A word of plain letters and a run of marks after it: the vocabulary's pre-tokeniser makes just these two parts of it.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?()|%$#&*\"/-]*)")
#: Those marks.
_MARKS = b".,;:!?()|%$#&*\"/-"


class WordIds:
    """Ids of words, as bytes of little-endian 32-bit ids; a worker process keeps the first ``keep`` words met."""

    def __init__(self, path: str, keep: int = KEPT_WORDS):
        self.path, self.keep, self.known = path, keep, {}
        suffix = json.loads(Path(path).read_text())["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix)
        vocabulary = tokenizer(path).get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _each(self, word: str) -> bytes:
        return np.array(tokenizer(self.path).encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words that are one pre-token each, encoded as one text and parted where a word's last id is."""
        found: dict[bytes, bytes] = {}
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = np.array(tokenizer(self.path).encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(some):
                raw, ends = ids.tobytes(), [0, *(cuts * 4).tolist()]
                found.update((w, raw[a:b]) for w, a, b in zip(some, ends, ends[1:]))
            else:
                found.update((w, self._each(w.decode())) for w in some)
        return found

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of these words that aren't known; they become known while there is room."""
        known, bare, plain, new = self.known, {}, set(), {}
        for word in words:
            letters = word.rstrip(_MARKS)
            if not letters.isalpha():  # not ASCII letters alone: rare
                if not (m := _PLAIN.fullmatch(word.decode())):
                    new[word] = self._each(word.decode())
                    continue
                low, marks = m[1].lower().encode(), m[2].encode()
            else:
                low, marks = letters.lower(), word[len(letters) :]
            if low not in known:
                plain.add(low)
            if marks:
                bare[word] = low
                if marks not in known:
                    plain.add(marks)
            elif low != word:
                bare[word] = low
        made = self._together(list(plain))
        for word, low in bare.items():
            marks = word[len(low) :]
            ids = made[low] if low in made else known[low]
            new[word] = ids + (made[marks] if marks in made else known[marks]) if marks else ids
        for word in words - new.keys():
            new[word] = made[word]
        if len(known) < self.keep:
            known.update(new)
        return new

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; words part at ASCII white space. A known word is looked up once."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer(self.path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        split = [utf8(t).split() for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        gaps = [(words, ids, at) for words, ids in zip(split, found, strict=True) if (at := places(ids))]
        if gaps:
            new = self.learn({words[i] for words, _, at in gaps for i in at})
            for words, ids, at in gaps:
                for i in at:
                    ids[i] = new[words[i]]
        return [b"".join(ids) for ids in found]


def places(ids: list[bytes | None]) -> list[int]:
    """Where the nulls stand."""
    at = []
    for _ in range(ids.count(None)):
        at.append(ids.index(None, at[-1] + 1 if at else 0))
    return at


def word_ids(path: str) -> WordIds:
    """One per worker process and stage, so that later tasks find the words of earlier ones, and other stages have the memory."""
    return kept(f"words of {path}", lambda: WordIds(path))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(total)


def token_ids(texts: pa.Array, encoder: WordIds, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end_id``, and where each text's begin (then the end)."""
    end, raw = np.array([end_id], "<u4").tobytes(), []
    for i in range(0, len(texts), 256):
        raw += [ids + end for ids in encoder.encode(texts[i : i + 256].to_pylist())]
    begins = np.cumsum([0, *map(len, raw)]) // 4
    return np.frombuffer(b"".join(raw), "<u4"), begins


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each size, and the windows' sums, by differencing into ``k`` windows.

    A partial partition keeps only its windows that hold anything, fullest first; the windows that it
    lacks are empty. Windows are trees of merges over the sizes, resolved at the end.
    """
    n = len(sizes)
    parents = np.full(2 * n, -1, np.int64)  # of sizes, then of merged windows
    made = n
    order = np.argsort(-sizes, kind="stable")
    heap = [(-int(sizes[i]) if k > 1 else 0, rank, sizes[i : i + 1].astype(np.int64), order[rank : rank + 1]) for rank, i in enumerate(order)]
    heapq.heapify(heap)
    rank = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        free = k - len(a)
        if len(b) <= free:  # what is left of b goes to empty windows
            sums, bags = np.concatenate([a, b]), np.concatenate([x, y])
        else:  # b's fullest go to empty windows, its emptiest upon a's fullest
            m = len(b) - free
            sums = np.concatenate([a, b[:free]])
            bags = np.concatenate([x, y[:free]])
            # a's windows from its emptiest on meet b's from its fullest left on
            into = np.arange(len(a) - 1, len(a) - 1 - m, -1)
            sums[into] += b[free:]
            new = np.arange(made, made + m)
            parents[bags[into]] = parents[y[free:]] = new
            bags[into] = new
            made += m
            if made + k > len(parents):
                parents = np.concatenate([parents, np.full(len(parents), -1, np.int64)])
        by = np.argsort(-sums, kind="stable")
        sums, bags = sums[by], bags[by]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), rank, sums, bags))
        rank += 1
    _, _, sums, bags = heap[0]
    window = np.full(made, -1, np.int64)
    window[bags] = np.arange(len(bags))
    for node in range(made - 1, -1, -1):
        if parents[node] >= 0:
            window[node] = window[parents[node]]
    return window[:n], sums


def deal(sizes: np.ndarray, capacity: int, padding: float = PADDING) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Parts of the sizes (which size, its length, its window), those of one size in order, and the number of windows.

    The number rises while a window exceeds the capacity and the padding stays within its share; then what doesn't fit is cut.
    """
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        window, sums = difference(sizes, k)
        if sums.max() <= capacity:
            return np.arange(len(sizes)), sizes, window, len(sums)
        if (k + 1) * capacity - total > padding * total:
            break
        k += 1
    room = [capacity - int(s) for s in sums] + [capacity] * (k - len(sums))
    length, loose, moved = sizes.astype(np.int64).copy(), [], []
    by = np.lexsort((-sizes, window))
    first = np.searchsorted(window[by], np.arange(len(sums)))
    for w in np.flatnonzero(sums > capacity):
        for i in by[first[w] :]:  # from its longest on
            over = min(-room[w], int(length[i]))
            length[i] -= over
            room[w] += over
            loose.append((over, int(i)))
            if room[w] >= 0:
                break
    holes = sorted((r, w) for w, r in enumerate(room) if r > 0)
    loose.sort()
    while loose:
        size, i = loose.pop()
        at = bisect.bisect_left(holes, (size, -1))
        hole, w = holes.pop(min(at, len(holes) - 1))
        part = min(size, hole)
        moved.append((i, part, w))
        if hole > part:
            bisect.insort(holes, (hole - part, w))
        if size > part:
            bisect.insort(loose, (size - part, i))
    stays = np.flatnonzero(length > 0)
    more = np.array(moved, np.int64).reshape(-1, 3)
    which = np.concatenate([stays, more[:, 0]])
    return which, np.concatenate([length[stays], more[:, 1]]), np.concatenate([window[stays], more[:, 2]]), len(room)


@dataclass(frozen=True)
class Pieces:
    """Pieces of the documents of a group: document, first id, length, sequence (from 0) and place in it."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def pack(lengths: np.ndarray, window: int = WINDOW) -> Pieces:
    """Cut and pack documents of these lengths (1 or more each)."""
    full = lengths // window
    doc_f = np.repeat(np.arange(len(lengths)), full)
    start_f = ranges(np.zeros_like(full), full) * window
    rest = lengths - full * window
    open_ = np.flatnonzero(rest)
    if len(open_):
        which, length_p, seq_p, k = deal(rest[open_], window)
        by = np.argsort(which, kind="stable")
        which, length_p, seq_p = which[by], length_p[by], seq_p[by]
        before = np.cumsum(length_p) - length_p
        first = np.searchsorted(which, which)
        doc_p, start_p = open_[which], full[open_[which]] * window + before - before[first]
        by = np.lexsort((start_p, doc_p, seq_p))
        doc_p, start_p, length_p, seq_p = doc_p[by], start_p[by], length_p[by], seq_p[by]
        before = np.cumsum(length_p) - length_p
        offset_p = before - before[np.searchsorted(seq_p, seq_p)]
    else:
        doc_p, start_p, length_p, seq_p, offset_p, k = (*(np.empty(0, np.int64) for _ in range(5)), 0)
    zeros = np.zeros(len(doc_f), np.int64)
    return Pieces(
        np.concatenate([doc_p, doc_f]), np.concatenate([start_p, start_f]), np.concatenate([length_p, zeros + window]),
        np.concatenate([seq_p, k + np.arange(len(doc_f))]), np.concatenate([offset_p, zeros]),
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, group: int = GROUP, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset. One map, no shuffle."""

    def run(batches):
        encoder, made = word_ids(path or vocabulary_path()), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part_of in slices(batch, group, GROUP_BYTES):
                ids, begins = token_ids(part_of.column(1), encoder, end_id)
                lengths = np.diff(begins)
                got = pack(lengths, window)
                for i in range(0, len(got.doc), 4096):
                    s = slice(i, i + 4096)
                    doc, start, length = got.doc[s], got.start[s], got.length[s]
                    raw = ids[ranges(begins[doc] + start, length)]
                    data = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays(
                        [part_of.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), data, pa.array(lengths[doc]), pa.array(got.sequence[s] + made), pa.array(got.offset[s])],
                        ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                    )
                made += int(got.sequence.max(initial=-1)) + 1

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
