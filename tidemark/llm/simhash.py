"""SimHash near-duplicates by tiled exact comparison of fingerprints.

A document's fingerprint has bit b set when more than half of the hashes of its word shingles have. It is
one 64-bit word or several. Distinct fingerprints are put in cells, for one word by the population counts of its
first two quarters; cells that differ by more than the radius never meet. Cells are cut in blocks, every
pair of blocks of cells that meet is one group, and inside a group the fingerprints stand in tiles by the population
counts of all four quarters: the sum of the count differences never exceeds the number of differing bits,
so tile pairs beyond the radius are skipped, and all others are compared whole with numpy exclusive-or and
bit counts. Each group gives a spanning forest of the links that it finds, so that no group emits
all its pairs, and stars over those links give the components.

A block is sent once to each block that it may meet. Blocks grow with the square root of the number of
fingerprints (``block_size``) up to a bound, so what is sent per fingerprint stays small; the comparisons themselves grow
with the square of the number of distinct fingerprints, times the share of tile pairs within the radius.

What goes to the driver or is broadcast is the size of each cell, 65 rows at most (or one for each size band),
and keys with more than a hundred-thousandth of all rows, of which there are at most a hundred thousand: a fingerprint, a root or
a star's centre that is crowded is joined there, by broadcast, and never lands in one task.

``near_duplicates`` takes the fingerprint of ``shingle`` words, repeats included, and links at ``radius`` bits.
``deduplicated`` takes five words and a similarity of 0.8: fingerprints of two words (128 bits) over the distinct
shingles, whose differing bits estimate the angle between the shingle sets, so that ``SET_RADIUS`` bits find the candidates; sets
whose sizes differ by more than 0.8 never reach the similarity and are skipped by size bands. Every candidate pair is then
held to the exact similarity of its sets of 64-bit hashes, save pairs that confirmed links connect already (texts
with equal fingerprints count as equal). Groups of blocks don't emit pairs but who has a candidate, in units of ``UNIT`` hashes at most on
either side, or of one text; the sets of those alone are made and sent, once for each unit.

Cases: a null or empty text, or one of white space, has fingerprint 0 and links like any other; fewer words than a
shingle are hashed as the whole sequence; repeated rows get a row each; a null id keeps its row, and
its component is the smallest id of its group that isn't null (null if there is none); further
columns are not read; an empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8, written

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Of sets: words of a shingle, similarity, and differing bits of 128 of candidates (at a similarity of 0.8 they are 19 on average, 4 more or less; of random sets 64).
SET_SHINGLE, SIMILARITY, SET_RADIUS = 5, 0.8, 32
#: Hashes of either side of a unit of candidates, and the least that a set counts for.
UNIT, LEAST = 1 << 21, 64
#: Rows of a key up to which it isn't crowded, whatever the table's size; and bytes of bitmaps up to which they are broadcast.
CROWD, BITMAP_BYTES = 1000, 64 << 20


def shingle_hashes(words: list[bytes], shingle: int, digest: Callable[[bytes], bytes]) -> bytes:
    """The digests of all shingles of at least one word, in order."""
    if len(words) < shingle:
        return digest(b" ".join(words))
    return b"".join(map(digest, map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, wide: bool = False) -> tuple[bytes, int]:
    """The fingerprint of a whole text, big-endian, and the number of hashes it is made of.

    64 bits over all shingles, or with ``wide`` 128 over the distinct ones.
    """
    parts = iter((distinct_hashes(text, shingle, seed),)) if wide else all_hashes(text, shingle, lambda g: xxhash.xxh64_digest(g, seed), 8)
    return majority(parts, 16 if wide else 8)


def all_hashes(text: str | None, shingle: int, digest: Callable[[bytes], bytes], width: int) -> Iterator[np.ndarray]:
    """The hashes of a whole text's shingles, a row of bytes each, by parts."""
    words = utf8(text).lower().split()
    for at in range(0, max(1, len(words) - shingle + 1) if words else 0, 1 << 15):
        yield np.frombuffer(shingle_hashes(words[at : at + (1 << 15) + shingle - 1], shingle, digest), np.uint8).reshape(-1, width)


def distinct_hashes(text: str | None, shingle: int = SET_SHINGLE, seed: int = SEED) -> np.ndarray:
    """128-bit hashes of the distinct shingles, in order of their first 64 bits."""
    found = np.concatenate([np.empty((0, 16), np.uint8), *all_hashes(text, shingle, lambda g: xxhash.xxh3_128_digest(g, seed), 16)])
    return found[np.unique(found.view(">u8")[:, 0], return_index=True)[1]]


def majority(parts: Iterable[np.ndarray], width: int) -> tuple[bytes, int]:
    """The bits that over half of the hashes have, and how many hashes there are."""
    counts, n = np.zeros(8 * width, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            counts += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes(), n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, wide: bool = False) -> DataFrame:
    """id, fp (the fingerprint, big-endian) and n (its hashes) of every row: one map, no shuffle."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(t.as_py(), shingle, seed, wide) for t in batch.column(1)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["id", "fp", "n"])

        return each

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(picked, make, "id long, fp binary, n long")


def shingle_sets(texts: DataFrame, shingle: int = SET_SHINGLE, seed: int = SEED) -> DataFrame:
    """fp (128 bits) and set (the 64-bit hashes of the distinct shingles, in order) of the column text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [distinct_hashes(t.as_py(), shingle, seed) for t in batch.column(0)]
            prints, sets = [majority((h,), 16)[0] for h in found], [np.ascontiguousarray(h[:, :8]).tobytes() for h in found]
            return pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], ["fp", "set"])

        return each

    return map_batches(texts.select(F.col("text").cast("string").alias("text")), make, "fp binary, set binary")


def count_cell() -> list[Column]:
    """The population count of a 64-bit fingerprint."""
    return [F.lit(0).cast("int") + sum(F.bit_count(F.conv(F.hex(F.expr(f"substring(fp, {at}, 4)")), 16, 10).cast("long")).cast("int") for at in (1, 5))]


def size_cell(similarity: float = SIMILARITY) -> list[Column]:
    """The band of a set's size: sets of the similarity are in the same band or the next."""
    return [F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(-float(np.log(similarity)))).cast("int")]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links u-v: each node but the least with the least of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def tiles(fps: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of fingerprints (rows of bytes) by tile, the tiles (quarters' counts by ``step``) and where each begins, then the end."""
    counts = np.bitwise_count(fps).reshape(len(fps), 4, -1).sum(2, dtype=np.int64) // step
    found, which = np.unique(counts, axis=0, return_inverse=True)
    by = np.argsort(which.ravel(), kind="stable")
    return by, found, np.concatenate([[0], np.cumsum(np.bincount(which.ravel(), minlength=len(found)))])


def links_within(left: np.ndarray, right: np.ndarray, radius: int, step: int = 1 << 19):
    """Places of pairs, one of either side, that differ in at most ``radius`` bits; by parts. Rows are 64-bit words."""
    rows = max(1, step // max(1, len(right)))
    for lo in range(0, len(left), rows):
        for at in range(0, len(right), step):
            part, other = left[lo : lo + rows], right[at : at + step]
            bits = np.bitwise_count(part[:, 0, None] ^ other[None, :, 0])
            for w in range(1, left.shape[1]):
                bits += np.bitwise_count(part[:, w, None] ^ other[None, :, w])
            i, j = np.divmod(np.flatnonzero(bits.ravel() <= radius), len(other))
            if len(i):
                yield i + lo, j + at


def block_pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in left, then right) within the radius between two blocks, or in one, of rows of bytes; by parts, tile by tile."""
    both = left if right is None else np.concatenate([left, right])
    wide = np.ascontiguousarray(both).view(np.uint64)
    step = 1 if both.shape[1] == 8 else 16
    (by, kinds, cuts), base = tiles(left, step), 0 if right is None else len(left)
    r_by, r_kinds, r_cuts = (by, kinds, cuts) if right is None else tiles(right, step)
    l_words, r_words = wide[by], wide[r_by + base]
    for t, kind in enumerate(kinds):
        apart = np.abs(r_kinds - kind)
        near = (apart.sum(1) if step == 1 else np.where(apart > 0, (apart - 1) * step + 1, 0).sum(1)) <= radius
        if right is None:
            near[:t] = False
        near = np.flatnonzero(near)
        if not len(near):
            continue
        at = np.concatenate([np.arange(r_cuts[k], r_cuts[k + 1]) for k in near])
        for i, j in links_within(l_words[cuts[t] : cuts[t + 1]], r_words[at], radius):
            yield by[cuts[t] + i], r_by[at[j]] + base


def block_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of those pairs: each place but the least of its component with that least."""
    u, v, held = [], [], 0
    label = np.arange(len(left) + (0 if right is None else len(right)))
    for i, j in block_pairs(left, right, radius):
        apart = label[i] != label[j]
        u.append(i[apart])
        v.append(j[apart])
        held += len(u[-1])
        if held > 1 << 17:
            x, y = forest(np.concatenate(u), np.concatenate(v))
            label[x] = y
            u, v, held = [x], [y], 0
    return forest(np.concatenate(u), np.concatenate(v)) if u else (np.empty(0, np.int64), np.empty(0, np.int64))


def block_units(left: np.ndarray, right: np.ndarray | None, sizes: np.ndarray, radius: int, most: int = UNIT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units of candidates between two blocks, or in one: their places (in left, then right), and which stand on the right.

    Every pair within the radius is in one unit, on two sides or, where none stands on the right, on one. A
    component of candidates goes whole in a unit with others, or is cut in pieces, and all pairs of its pieces are units.
    """
    u, v = block_links(left, right, radius)
    if not len(u):
        return
    roots = np.unique(v)
    at, label = np.concatenate([u, roots]), np.concatenate([v, roots])
    order = np.lexsort((at, label))
    at, label = at[order], label[order]
    weight, cuts = np.maximum(sizes[at], LEAST), np.append(np.flatnonzero(np.diff(label, prepend=-1)), len(at))
    total = np.add.reduceat(weight, cuts[:-1])
    small, later = total <= most, (at >= len(left)) & (right is not None)
    unit = np.repeat(np.where(small, np.cumsum(np.where(small, total, 0)) // most, -1), np.diff(cuts))
    for k in np.unique(unit[unit >= 0]):
        yield at[unit == k], later[unit == k]
    for c in np.flatnonzero(~small):
        own = np.arange(cuts[c], cuts[c + 1])
        pieces = lambda rows: [at[rows[np.cumsum(weight[rows]) // most == k]] for k in np.unique(np.cumsum(weight[rows]) // most)]
        first = pieces(own[~later[own]])
        second = first if right is None else pieces(own[later[own]])
        for i, x in enumerate(first):
            for j, y in enumerate(second):
                if right is None and i == j:
                    yield x, np.zeros(len(x), bool)
                elif right is not None or i < j:
                    yield np.concatenate([x, y]), np.repeat([False, True], [len(x), len(y)])


def similar_links(left: np.ndarray, right: np.ndarray | None, sets: list[np.ndarray], similarity: float, radius: int, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within the radius whose sets (of left, then right) have the exact similarity."""
    n = np.array([len(s) for s in sets])
    starts, ids = np.cumsum(n) - n, np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    label, mark = np.arange(len(n)), np.zeros(len(ids), bool)
    for i, j in block_pairs(left, right, radius):
        open_ = (label[i] != label[j]) & (np.minimum(n[i], n[j]) / np.maximum(np.maximum(n[i], n[j]), 1) >= similarity)
        order = np.argsort(i[open_], kind="stable")
        i, j = i[open_][order], j[open_][order]
        for a, lo, hi in zip(*(x.tolist() for x in _runs(i)), strict=True):
            own = ids[starts[a] : starts[a] + n[a]]
            mark[own] = True
            others = j[lo:hi]
            for cut in np.split(others, np.flatnonzero(np.diff(np.cumsum(n[others]) // step)) + 1):
                cut = cut[label[cut] != label[a]]
                if not len(cut):
                    continue
                ends = np.cumsum(n[cut])
                places = np.arange(ends[-1]) + np.repeat(starts[cut] - ends + n[cut], n[cut])
                common = np.add.reduceat(mark[ids[places]], ends - n[cut], dtype=np.int64)
                near = cut[common / (n[a] + n[cut] - common) >= similarity]
                if len(near):
                    label[np.isin(label, label[near])] = label[a]
            mark[own] = False
    own = np.flatnonzero(label != np.arange(len(n)))
    return own, label[own]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of runs of equal ones, where each begins and where it ends."""
    cuts = np.flatnonzero(np.diff(x, prepend=-1))
    return x[cuts], cuts, np.append(cuts, len(x))[1:]


def block_size(n: int) -> int:
    """Fingerprints of a block: so many that blocks meet about as many others as they hold tens of fingerprints."""
    return int(min(1 << 17, max(4096, 64 * n**0.5)))


def met_blocks(nodes: DataFrame, cell: Sequence[Column], reach: int, block: int | None = None) -> DataFrame:
    """fp and n of written distinct fingerprints, once for each pair of blocks (low, high, and whether they are the same) that may meet: of cells that differ by ``reach`` at most in all."""
    spark = nodes.sparkSession
    celled = nodes.select("fp", "n", F.array(*cell).alias("cell"))
    sizes = [(tuple(r[0]), r[1]) for r in celled.groupBy("cell").agg(F.count("*")).collect()]
    block = block or block_size(sum(n for _, n in sizes))
    parts = {c: -(-n // block) for c, n in sizes}
    names = {c: i for i, c in enumerate(sorted(parts))}
    meets = [(list(c), parts[c], names[c], names[d], parts[d]) for c in names for d in names if sum(abs(x - y) for x, y in zip(c, d, strict=True)) <= reach]
    plan = spark.createDataFrame(meets, "cell array<int>, blocks int, own int, other int, theirs int")
    mine = celled.join(F.broadcast(plan), "cell").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = mine.select("fp", "n", "own", "mine", "other", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)).alias("part"))
    me, it = F.struct(F.col("own").alias("c"), F.col("mine").alias("b")), F.struct(F.col("other").alias("c"), F.col("part").alias("b"))
    rows = met.select("fp", "n", F.least(me, it).alias("low"), F.greatest(me, it).alias("high"), (me > it).alias("right"))
    return rows.withColumn("same", F.col("low") == F.col("high"))


def sides(group: pa.Table, one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Of a group's fingerprints: their order, the left ones first, then the left ones, the right ones (None if there is one side), and all in that order."""
    order = np.argsort(group.column("right").to_numpy(), kind="stable")
    fps = np.frombuffer(b"".join(group.column("fp").to_pylist()), np.uint8).reshape(group.num_rows, -1)[order]
    cut = group.num_rows - int(group.column("right").to_numpy().sum())
    return order, fps[:cut], None if one else fps[cut:], fps


def raw(fps: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in fps], pa.binary())


def cell_links(nodes: DataFrame, cell: Sequence[Column], reach: int, radius: int, block: int | None = None) -> DataFrame:
    """Links u-v between written distinct fingerprints (fp, n) of cells that differ by ``reach`` at most in all, as a forest of each group."""

    def find(group: pa.Table) -> pa.Table:
        _, left, right, fps = sides(group, group.column("same")[0].as_py())
        u, v = block_links(left, right, radius) if len(left) and (right is None or len(right)) else (np.empty(0, np.int64),) * 2
        return pa.table({"u": raw(fps[u]), "v": raw(fps[v])})

    return met_blocks(nodes, cell, reach, block).groupBy("low", "high").applyInArrow(find, "u binary, v binary")


def set_links(nodes: DataFrame, texts: DataFrame, radius: int, shingle: int, seed: int, similarity: float = SIMILARITY, block: int | None = None, most: int = UNIT) -> DataFrame:
    """Links u-v between written distinct fingerprints (fp, n, least: a row that has it) whose sets have the exact similarity, as a forest of each unit.

    ``texts`` are the written row numbers and texts.
    """

    def find(group: pa.Table) -> pa.Table:
        order, left, right, fps = sides(group, group.column("same")[0].as_py())
        if not len(left) or (right is not None and not len(right)):
            return pa.table({"unit": pa.array([], pa.string()), "fp": raw(fps[:0]), "right": pa.array([], pa.bool_())})
        low, high = (".".join(map(str, group.column(c)[0].as_py().values())) for c in ("low", "high"))
        units = list(block_units(left, right, group.column("n").to_numpy()[order], radius, most))
        at = np.concatenate([np.empty(0, np.int64), *(x for x, _ in units)])
        names = [f"{low}.{high}.{k}" for k, (x, _) in enumerate(units) for _ in range(len(x))]
        return pa.table({"unit": pa.array(names, pa.string()), "fp": raw(fps[at]), "right": pa.array(np.concatenate([np.empty(0, bool), *(y for _, y in units)]))})

    def confirm(group: pa.Table) -> pa.Table:
        order, left, right, fps = sides(group, not group.column("right").to_numpy().any())
        held = group.column("set").to_pylist()
        u, v = similar_links(left, right, [np.frombuffer(held[k], ">u8") for k in order], similarity, radius)
        return pa.table({"u": raw(fps[u]), "v": raw(fps[v])})

    units = written(met_blocks(nodes, size_cell(similarity), 1, block).groupBy("low", "high").applyInArrow(find, "unit string, fp binary, right boolean"))
    chosen = nodes.join(units.select("fp").distinct(), "fp", "left_semi").select(F.col("least").alias("row"))
    sets = shingle_sets(marked(texts, chosen), shingle, seed)
    return units.join(sets, "fp").groupBy("unit").applyInArrow(confirm, "u binary, v binary")


def marked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose number ``row`` is in ``chosen``, told by a bitmap, a bit a row, so that they aren't shuffled where it is small."""
    bits = written(chosen.groupBy(F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits")))
    bits = F.broadcast(bits) if bits.count() * 4096 <= BITMAP_BYTES else bits
    met = rows.withColumn("bucket", F.bitmap_bucket_number("row")).withColumn("bit", F.bitmap_bit_position("row")).join(bits, "bucket")
    kept = met.where("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 + 1 as int), 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    return kept.select(*rows.columns)


def joined(big: DataFrame, small: DataFrame, key: str, rows: int) -> DataFrame:
    """``big`` (written, ``rows`` rows) with its row of ``small`` (written: the key, how many rows of ``big`` have it as ``crowd``, and more).

    Keys of more than a hundred-thousandth of the rows, so a hundred thousand at most, are joined by broadcast.
    """
    much = F.col("crowd") > max(CROWD, rows // 100_000)
    crowded = F.broadcast(small.where(much))
    few = big.join(crowded.select(key), key, "left_anti").join(small.where(~much), key)
    return big.join(crowded, key).unionByName(few).drop("crowd")


def stars(links: DataFrame) -> DataFrame:
    """Components of links u-v as stars: each node u but the least of its component with that least node v.

    Large and small stars in turn: every node's larger neighbours, then its smaller ones and itself, are
    linked to the least of them all. The links stand written after each round, which ends when none changed.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("crowd")), 2 * before[0])
        large = written(joined(both, least, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), 2 * before[0])
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("crowd")), 2 * before[0])
        small = joined(large, least, "u", 2 * before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), 4 * before[0])
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def distinct_prints(rows: DataFrame) -> DataFrame:
    """fp, its least id, n and crowd (rows) of each fingerprint in the written rows (id, fp, n)."""
    return written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.count("*").alias("crowd")))


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """fp, component_id (the smallest id reachable over links u-v) and crowd (rows) of each of the written distinct fingerprints."""
    many = nodes.count()
    rooted = nodes.join(stars(links).withColumnRenamed("u", "fp"), "fp", "left")
    rooted = written(rooted.select("fp", "least", F.coalesce("v", "fp").alias("root"), F.col("crowd").alias("rows")), many)
    first = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("crowd")), many)
    return written(joined(rooted, first, "root", many).select("fp", "component_id", F.col("rows").alias("crowd")), many)


def components(rows: DataFrame, radius: int = RADIUS, block: int | None = None) -> DataFrame:
    """Components of 64-bit fingerprints, as ``labelled`` gives them, in the written rows (id, fp, n)."""
    nodes = distinct_prints(rows)
    return labelled(nodes, cell_links(nodes, count_cell(), radius, radius, block))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id, fp and component_id, the smallest id reachable over links, of every row."""
    rows = written(fingerprints(docs, id_col, text_col, shingle, seed))
    return joined(rows, components(rows, radius), "fp", rows.count()).select("id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = SET_RADIUS, shingle: int = SET_SHINGLE, seed: int = SEED) -> DataFrame:
    """One row of each component of shingle sets of the similarity, in the columns of ``docs``: that of the smallest id, of rows with equal ids the first in scan order.

    A null id stands after all others, so that a group of rows without ids keeps one. Who stays is told by a bitmap of
    rows, a bit a row, so that no text is shuffled.
    """
    names = docs.columns
    whole = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("doc")))
    own = {c: F.col(f"doc.c{i}") for i, c in enumerate(names)}
    ids, texts = whole.select("row", own[id_col].cast("long").alias("id")), whole.select("row", own[text_col].alias("text"))
    rows = written(fingerprints(texts, "row", "text", shingle, seed, wide=True))
    nodes = distinct_prints(rows)
    parts = labelled(nodes, set_links(nodes, texts, radius, shingle, seed))
    grouped = joined(rows, parts, "fp", rows.count()).select(F.col("id").alias("row"), "component_id")
    first = grouped.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    kept = marked(whole, first)
    return kept.select(*[own[c].alias(c) for c in names])


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.hex(fp))
