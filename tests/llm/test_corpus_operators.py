"""Packing, exact top-k, mixing, language model and near-duplicates against plain versions, on tidy and untidy rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import messy_rows, save
from tidemark.llm import common, gru_lm, mixing, packing, queries, simhash, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# packing


def expected_ids(text):
    return packing.tokenizer(packing.vocabulary_path()).encode(text or "", add_special_tokens=False).ids + [2]


ODD = ["A'S don't we'll  x\u0085y <|endoftext|>a<|startoftext|> ΣΑΣ é é 1２!!??'re\tİ \x1c q", "a　b c", "Foo, BAR; Été. naïve-- café's", "́x", None, "", " \n"]


def test_word_ids_are_text_ids():
    texts = ODD + [t for _, t, *_ in messy_rows()]
    encoder = packing.WordIds(packing.vocabulary_path(), keep=50)
    for _ in range(2):  # the second time partly from what is kept
        ids, begins = packing.token_ids(pa.array(texts), encoder)
        for i, t in enumerate(texts):
            assert ids[begins[i] : begins[i + 1]].tolist() == expected_ids(t), t


def test_word_ids_look_at_unknown_ascii_words_only_as_bytes(monkeypatch):
    """Capitals and marks of ASCII words part without a regular expression or a decoded word; ids are those of whole texts."""
    tokenizer = packing.tokenizer(packing.vocabulary_path())
    texts = ["Zebra zebra, ZEBRA!? (a) b\u00e9b\u00e9. \u00c9t\u00e9 x.y. ... 12% end-", None, "zebra zebra, new Zebra,", "end- ... B\u00e9b\u00e9."]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    seen, plain = [], packing._PLAIN
    monkeypatch.setattr(packing, "_PLAIN", type("Seen", (), {"fullmatch": staticmethod(lambda w: seen.append(w) or plain.fullmatch(w))}))
    for keep in (0, 3, 1000):
        assert packing.WordIds(packing.vocabulary_path(), keep=keep).encode(texts) == want
    assert "x.y." in seen and not {"Zebra", "zebra,", "ZEBRA!?", "end-"} & set(seen)
    assert packing.places([None, b"a", None, None, b"b"]) == [0, 2, 3] and packing.places([b"a"]) == []


@pytest.mark.parametrize("seed", range(12))
def test_pack_is_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [3, 600, 5000, 20000][seed % 4], rng.integers(1, 700))
    if seed > 8:
        lengths[:] = [3000, 4095, 2049][seed % 3]
    p = packing.pack(lengths)
    assert (np.bincount(p.doc, p.length, minlength=len(lengths)) == lengths).all()
    seen = defaultdict(list)
    for d, s, n in zip(p.doc, p.start, p.length, strict=True):
        seen[d].append((s, n))
    assert all([s for s, _ in sorted(v)] == [0, *np.cumsum([n for _, n in sorted(v)])[:-1]] for v in seen.values())
    by = np.lexsort((p.offset, p.sequence))
    for q in np.unique(p.sequence):
        at = by[p.sequence[by] == q]
        assert (p.offset[at] == np.cumsum(p.length[at]) - p.length[at]).all() and p.length[at].sum() <= 4096
    used = np.bincount(p.sequence, p.length)
    padding = sum(0 if not int(u) & (int(u) - 1) else 4096 - u for u in used)
    assert padding <= 4096 + 0.002 * lengths.sum() and (p.length > 0).all()


def test_rests_stay_whole_if_they_fit():
    rng = np.random.default_rng(2)
    lengths = rng.integers(100, 1500, 2000)
    p = packing.pack(lengths)
    assert len(p.doc) < 1.2 * len(lengths)  # a cut or so for each window that would be too full
    few = packing.pack(np.array([4096, 100, 3996, 2000, 2096]))
    assert sorted(few.length) == [100, 2000, 2096, 3996, 4096]


def test_differencing_levels_windows_and_counts_rise():
    sizes = np.array([8, 7, 6, 5, 4])
    window, sums = packing.difference(sizes, 2)
    assert sorted(sums) == [14, 16] and sorted(np.bincount(window, sizes)) == [14, 16]
    which, length, window, k = packing.deal(np.array([3000, 3000, 3000]), 4096)  # 9000 in three windows at least
    assert k == 3 and sorted(window) == [0, 1, 2] and sorted(which) == [0, 1, 2]
    assert packing.deal(np.array([2100] * 5), 4096, padding=1.0)[3] == 5  # room for more windows: nothing is cut
    which, length, window, k = packing.deal(np.array([2100] * 5), 4096)
    assert k == 3 and len(which) > 5 and (np.bincount(which, length) == 2100).all() and np.bincount(window, length).max() <= 4096
    sums = packing.difference(np.random.default_rng(1).integers(1, 513, 900), 60)[1]
    assert sums.max() - sums.min() < 0.01 * sums.max()


def test_vocabularies_without_word_ends_are_encoded_whole():
    path = packing.vocabulary_path("byte_bpe_50k.json")
    texts = ["Hello  world\n\n a", "", None, "x" * 50]
    got = packing.WordIds(path).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [packing.tokenizer(path).encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_query(spark, messy):
    got = queries.op3_packing(spark, messy).toPandas()
    want = sorted((i is None, i or 0, len(expected_ids(t))) for i, t, *_ in messy_rows())
    starts = got[got.start == 0]
    assert sorted((i != i, 0 if i != i else int(i), int(n)) for i, n in zip(starts.doc_id.astype(float), starts.doc_tokens, strict=True)) == want
    for seq, part in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 4096
    ids = {i: expected_ids(t) for i, t, *_ in messy_rows() if i is not None and i not in (200,)}
    whole = Counter()
    for r in got[got.doc_id.isin(list(ids))].itertuples():
        piece = ids[int(r.doc_id)][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and r.doc_tokens == len(ids[int(r.doc_id)])
        whole[int(r.doc_id)] += r.length
    assert whole == {i: len(x) for i, x in ids.items()}


# exact top-k


@pytest.mark.parametrize("seed", range(12))
def test_search_equals_brute_force(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n, d, scale = int(rng.integers(2, 900)), int(rng.integers(1, 12)), [3, 300, 100_000, 1 << 27][seed % 4]
    vecs = np.floor(rng.integers(-scale, scale, (n, d)) * (rng.random((n, 1)) ** 2 if seed % 2 else 1.0)).astype(float)
    if seed % 3 == 0:
        vecs[: n // 2] = vecs[0]
    if seed % 5 == 0:
        vecs = np.abs(vecs)
    ids = rng.permutation(2 * n)[:n].astype(np.int64)
    asked = np.arange(min(n, 40))
    monkeypatch.setattr(topk, "BUCKET", int(rng.integers(1, 200)))
    best = topk.Best(len(asked), 5)
    for a in range(0, n, 301):
        topk.search(best, ids[asked], vecs[asked], np.sqrt((vecs[asked] ** 2).sum(1)), ids[a : a + 301], vecs[a : a + 301])
    exact = [[sum(int(x) * int(y) for x, y in zip(vecs[q], v, strict=True)) for v in vecs] for q in asked]
    for r, q in enumerate(asked):
        want = sorted((-exact[r][j], int(ids[j])) for j in range(n) if j != q)[:5]
        assert [(-int(s), int(i)) for s, i in zip(best.score[best.row == r], best.id[best.row == r], strict=True)] == want


def test_sortable_bytes_and_huge_components(spark):
    rng = random.Random(9)
    some = sorted([rng.randrange(-(1 << rng.randrange(1, 300)), 1 << rng.randrange(1, 300)) for _ in range(500)] + [0, 1, -1, 255, 256, -255, -256])
    assert sorted(map(topk.sortable, some)) == [topk.sortable(x) for x in some]
    rows = [(i, [float(rng.choice([1, -1]) * rng.random() * 10 ** rng.choice([0, 3, 20, 200])) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256.0 * x)) for x in v] for i, v in rows}
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 5, "vec_id", "embedding", 256.0).collect()}
    for q in (0, 20, 40):
        want = sorted((-sum(x * y for x, y in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in want]


def test_topk_query_equals_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1 * (1 + i % 7)) for _ in range(8)], 1) for i in range(0, 330)]
    rows += [(i, rows[50][1], 1) for i in range(400, 460)] + [(100, rows[3][1], 2), (7, rows[9][1], 2), (50, rows[50][1], 3)]
    rows += [(800, [float(1 << 21)] + [0.1] * 7, 1), (850, [-float(1 << 22)] + [0.5] * 7, 1), (801, [0.25, float(1 << 22)] + [0.0] * 6, 1)]  # components past 2^28
    rows += [(None, rows[1][1], 1), (500, None, 1), (550, [0.1] * 7 + [float("nan")], 1), (600, [float("inf")] * 8, 1), (650, [0.1, None] * 4, 1), (700, [0.0] * 8, 1), (-50, [-0.3] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS score", "3 AS vec")
    folder = save(df, tmp_path, "embeddings")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, queries.op5_exact_topk(spark, folder).collect()))
    assert got == sorted(con.execute(queries.oracle_sql()["op5_exact_topk"]).fetchall()) and len({r[0] for r in got}) == 13
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    parts = topk.top_k(frame, frame.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", 256.0, chunk=3)
    assert sorted(map(tuple, parts.collect())) == got


# mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 500 / 3, 250 / 3]  # 450 by 5, 2, 1, the first stopped at 200
    assert mixing.targets([10, 0, 1000, 10]) == pytest.approx([20.0, 0.0, 1490.0, 20.0]) and mixing.targets([0, 0]) == [0.0, 0.0] and mixing.targets([]) == []
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, rng.randrange(10_000)]) for _ in range(rng.randrange(1, 9))]
        goal = mixing.targets(sizes)
        assert sum(goal) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * s + 1e-6 for g, s in zip(goal, sizes, strict=True))


def test_permutations_and_slots():
    for n in (1, 2, 3, 5, 64, 100, 1000):
        at = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9))
        assert sorted(at) == list(range(n)) and (mixing.permuted(at, np.full(n, n), np.full(n, 9), back=True) == np.arange(n)).all()
    rng = random.Random(3)
    for _ in range(300):
        size, block = rng.choice([1, 5, 255, 256, 257, 1000, 5000]), rng.choice([16, 256])
        s = mixing.source_plan("x", 1, size, rng.random() * 2 * size, block, 7)
        j = np.arange(s.slots)
        at = mixing.permuted(j % s.blocks, np.full(len(j), s.blocks), np.array([mixing.epoch_key(7, 1, int(e)) for e in j // s.blocks], np.int64))
        taken = np.where(at == s.blocks - 1, size - (s.blocks - 1) * block, block)
        if len(j):
            taken[-1] = min(taken[-1], s.last_words)
        assert taken.sum() == int(s.target)
    assert len({p[0] for p in mixing.shard_plan([40_000, 7])}) == 2501 and len({p[0] for p in mixing.shard_plan([4_000_000, 7])}) <= mixing.SHARDS + 1
    plan = mixing.shard_plan([500, 30, 0, 470], 128)
    drawn = [p[3] for p in plan if p[1] == 0]
    assert len(set(drawn)) > 2  # draws, not equal shares
    assert [sum(p[3] for p in plan if p[1] == i) for i in range(4)] == [500, 30, 0, 470] and all(sum(p[3] for p in plan if p[0] == s) == 128 for s in range(7))


def check_mix(got, rows):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    source = {i: s for i, _, _, s in rows}
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r["size"] and r.target == pytest.approx(goal[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    assert {s: taken[s] for s in names} == {s: int(goal[s] + 1e-9) for s in names}


def test_mixing_query(spark, messy):
    rows = [r for r in messy_rows()]
    got = queries.op7_mixing(spark, messy).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(words(t))) for i, t, *_ in rows)
    assert sorted(map(repr, got)) == sorted(map(repr, queries.op7_mixing(spark, messy).collect()))
    source = {(i, len(words(t))): s for i, t, _, s in rows}
    taken, size, goal = Counter(), Counter(), {}
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.taken <= 2 * r["size"]
        taken[s] += r.taken
        size[s] += r["size"]
        goal[s] = r.target
        assert r.source_size == sum(len(words(t)) for _, t, _, g in rows if g == s)
    assert {s: taken[s] for s in goal} == {s: math.floor(goal[s]) for s in goal}


def test_mixed_documents_hold_what_was_taken(spark, messy):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    taken, mixed = Counter(), Counter()
    for r in queries.op7_mixing(spark, messy).collect():
        taken[r.doc_id] += r.taken
    whole = defaultdict(list)
    for i, t, *_ in messy_rows():
        whole[i].append(t or "")
    for r in out.collect():
        mixed[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text) and any(r.text in t for t in whole[r.doc_id])
    assert {i: n for i, n in taken.items() if n} == dict(mixed)


def test_blocks_of_the_mix(spark, messy):
    """Shards hold whole slots at places 0, 1, ...; blocks hold the words that the documents of their source hold in order."""
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    got = mixing.mix_blocks(docs, block=64, shard_slots=32).collect()
    shards, words_of, full = defaultdict(list), defaultdict(Counter), Counter()
    for r in got:
        shards[r.shard].append(r.place)
        assert len(words(r.text)) == r.words <= 64
        words_of[r.source].update(words(r.text))
        full[r.source] += r.words
    assert len(shards) > 5 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    row = [r.source for r in sorted((r for r in got if r.shard == 0), key=lambda r: r.place)]
    assert sum(a != b for a, b in zip(row, row[1:])) >= len(set(row))  # sources are mixed inside a shard
    assert {len(v) for s, v in shards.items() if s < max(shards)} == {32}
    assert len({(r.source, r.epoch, r.block) for r in got}) == len(got)
    check_sizes = Counter()
    for r in mixing.mix_sizes(docs, block=64, shard_slots=32).collect():
        check_sizes[r.source] += r.taken
    assert {s: n for s, n in check_sizes.items() if n} == dict(full)
    whole = defaultdict(Counter)
    for _, t, _, s in messy_rows():
        whole[s].update(words(t))
    assert all(n <= 2 * whole[s][w] for s, c in words_of.items() for w, n in c.items())


def test_mix_plans_broadcast_nothing_that_grows(spark, messy, monkeypatch):
    """No exchange of rows by source, and slots meet blocks by a sort-merge join; where sources start is broadcast up to a counted bound."""
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    for bound, broadcasts in ((100_000, True), (0, False)):
        monkeypatch.setattr(mixing, "STARTS_ROWS", bound)
        for df in (queries.op7_mixing(spark, messy), mixing.mix_documents(docs), mixing.mix_blocks(docs).drop("source")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins = re.findall(r"(\w+Join) \[k#\d+, block#\d+L?\]", plan)
            assert joins and set(joins) == {"SortMergeJoin"}
            assert not re.search(r"hashpartitioning\(source#\d+, \d+\).*\n.*Project \[source#\d+, size", plan)
            slots = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "place#" in line]
            assert not slots and ("BroadcastHashJoin" in plan) >= broadcasts


# language model


def test_gradients():
    layout = gru_lm.Layout.make([b"a", b"b", b"\n", b"c", b"d"], np.array([90, 7, 5, 1, 1]), np.ones(gru_lm.TAIL))
    layout.starts = np.array([0, 1, 3, 5])
    layout.__post_init__()
    net = gru_lm.Network(layout, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, h0 = rng.integers(0, 9, (3, 6)), rng.integers(0, 9, (3, 6)), rng.standard_normal((3, 5))

    def loss():
        h, total = h0, 0.0
        for t in range(6):
            h = net.step((net.p["E"][x[:, t]] @ net.p["W"] + net.p["b"]).T, h.T).T
            total -= gru_lm.window_scores(net, layout, h, y[:, t]).sum()
        return total / 18

    _, grads = gru_lm.backward(net, layout, x, y, h0)
    for k, p in net.p.items():
        for flat in rng.integers(0, p.size, 6):
            at = np.unravel_index(flat, p.shape)
            p[at] += 1e-5
            up = loss()
            p[at] -= 2e-5
            down = loss()
            p[at] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(grads[k][at], abs=1e-7)


def test_scores_are_probabilities_and_keep_state():
    rng = np.random.default_rng(4)
    layout = gru_lm.Layout.make([b"a", b"b", b"\n", b"c", b"d"], np.array([90, 7, 5, 1, 1]), np.ones(gru_lm.TAIL))
    net = gru_lm.Network(layout, 6)
    n = len(layout.words) + gru_lm.TAIL
    one_step = gru_lm.log_likelihoods(net, layout, [np.array([i]) for i in range(n)])
    assert np.exp(one_step).sum() == pytest.approx(1, abs=1e-5)
    docs = [rng.integers(0, n, k) for k in (1, 200, 33, 32, 31, 0, 77)]
    want = []
    for d in docs:
        h, last, total = np.zeros((1, 6), np.float32), 2, 0.0
        for i in d:
            h = net.step((net.p["E"][[last]] @ net.p["W"] + net.p["b"]).T, h.T).T
            total += gru_lm.window_scores(net, layout, h, np.array([i]))[0]
            last = i
        want.append(total)
    for window, together in ((32, 1024), (7, 2)):
        assert gru_lm.log_likelihoods(net, layout, docs, window, together) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_training_learns():
    words_of = [b"a", b"b", b"c", gru_lm.END]
    layout = gru_lm.Layout.make(words_of, np.array([9, 9, 9, 3]), np.ones(gru_lm.TAIL))
    net = gru_lm.Network(layout, 16)
    ids = np.tile(layout.encode([b"a", b"b", b"c", gru_lm.END]), 4000)
    held = [np.array(layout.encode([b"a", b"b", b"c", gru_lm.END]))]
    before = gru_lm.log_likelihoods(net, layout, held)[0]
    gru_lm.train(net, layout, ids, rate=0.02, streams=4)
    assert before < -8 and gru_lm.log_likelihoods(net, layout, held)[0] > -0.5


def test_language_model_query(spark, messy):
    got = queries.op8_gru_lm(spark, messy).collect()
    toks = lambda t: [*words(low(t)), "\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in messy_rows() if not held(i) for w in toks(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i is None, i or 0, held(i), len(toks(t)), sum(counts[w] > 0 for w in toks(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks(t)), 3)) for i, t, *_ in messy_rows())
    have = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got)
    for a, b in zip(have, want, strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], abs=2e-3)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_base_needs_no_network_and_is_the_query_s_own(spark, messy, monkeypatch):
    """Counts and base scores train nothing and run nothing, and are those of op8; few counts are broadcast here, the others joined."""
    monkeypatch.setattr(gru_lm, "HEAD", 20)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known)
    whole = sorted(queries.op8_gru_lm(spark, messy).collect(), key=key)

    def never(*_, **__):
        raise AssertionError("a network was trained")

    for step in ("train", "averaged", "Network"):
        monkeypatch.setattr(gru_lm, step, never)
    got = sorted(queries.queries()["unigram_base"](spark, messy).collect(), key=key)
    assert [tuple(r)[:5] for r in got] == [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in whole]
    assert [r.base_score for r in got] == pytest.approx([r.base_score for r in whole], abs=1e-4)


def test_texts_are_split_together_as_each_by_itself(spark):
    texts = [t for _, t, *_ in messy_rows()] + [" a A\x0bb\x1cc ", "\n", "\t \r", "É é\x85é b\x0c", "zz zz zz new new"]
    each = [gru_lm.tokens(t) for t in texts]
    for known in ([b"the", b"zz", b"a"], [gru_lm.END, b"b", b"the"], []):
        row, at, rest = gru_lm.place(pa.array(texts, pa.string()), pa.array(known, pa.binary()))
        places = {w: i for i, w in enumerate(known)}
        assert row.tolist() == [i for i, toks in enumerate(each) for _ in toks]
        assert at.tolist() == [places.get(w, -1) for toks in each for w in toks]
        assert rest.to_pylist() == [w for toks in each for w in toks if w not in places]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for keep in (1, 1000, 24 << 20):
        assert {r.word: r.n for r in gru_lm.token_counts(docs, keep).collect()} == Counter(w for toks in each for w in toks)


def test_language_model_beats_unigrams_on_held_out_documents(spark):
    got = queries.op8_gru_lm(spark, "/root/testdata/sf0.01").where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > 0.95 * got[1]


# near-duplicates


def plain_fingerprint(text):
    w = words(low(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_set_fingerprint(text):
    """Of the distinct 5-word shingles, 128 bits; and their number."""
    w = words(low(text))
    grams = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()
    hashes = [xxhash.xxh3_128_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)), len(grams)


def plain_components(prints, ids, radius=3, linked=lambda i, j: True):
    own = list(range(len(prints)))

    def root(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and linked(i, j):
                own[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(root(i), []).append(d)
    return [min((d for d in least[root(i)] if d is not None), default=None) for i in range(len(prints))]


def plain_set(text):
    w = words(low(text))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def plain_set_components(texts):
    """Component (a number) of each text by an exact similarity of 0.8 or more of the 5-word sets; no fingerprint is used."""
    sets = [plain_set(t) for t in texts]
    alike = lambda i, j: sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    return plain_components([0] * len(texts), list(range(len(texts))), 0, alike)


def test_near_duplicate_query(spark, messy):
    rows = messy_rows()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    want = sorted(map(repr, zip((i for i, *_ in rows), (f"{p:016x}" for p in prints), plain_components(prints, [i for i, *_ in rows]), strict=True)))
    assert sorted(repr(tuple(r)) for r in queries.op10_simhash_dedup(spark, messy).collect()) == want


def test_chains_and_crowds_of_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    prints, base = [0, (1 << 64) - 1], rng.getrandbits(64)
    for _ in range(60):  # a chain, each within the radius of the next alone
        for b in rng.sample(range(64), 3):
            base ^= 1 << b
        prints.append(base)
    crowd = rng.getrandbits(64)
    prints += [crowd ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)] + [rng.getrandbits(64) for _ in range(400)]
    ids = rng.sample(range(10_000), len(prints))
    rows = spark.createDataFrame([(i, p.to_bytes(8), 1) for i, p in zip(ids, prints, strict=True)], "id long, fp binary, n long")
    want = {p: c for p, c in zip(prints, plain_components(prints, ids), strict=True)}
    for block, crowd in ((None, 10_000), (5, 10_000), (50, 3)):  # one block or many of a cell; roots and centres crowded or not
        monkeypatch.setattr(simhash, "CROWD", crowd)
        got = {int.from_bytes(r.fp): r.component_id for r in simhash.components(rows, block=block).collect()}
        assert got == want


def test_one_fingerprint_on_most_rows(spark, monkeypatch):
    """A crowded fingerprint is joined by broadcast: no exchange by fingerprint has its rows, and no row is lost."""
    monkeypatch.setattr(simhash, "CROWD", 100)
    rows = [(i, "the same page again and again" if i % 10 else f"page {i} of its own with words {i * 7} {i * 13}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    assert got == dict(zip((i for i, _ in rows), plain_components(prints, [i for i, _ in rows]), strict=True))
    assert simhash.deduplicated(docs).count() == len(set(plain_set_components([t for _, t in rows])))
    small = spark.createDataFrame([(k, 5000 if k == 0 else 1) for k in range(50)], "k int, crowd long")
    big = spark.range(5050).selectExpr("id", "cast(greatest(id - 5000, 0) as int) AS k")
    out = simhash.joined(big, small, "k", 5050)
    assert out.count() == 5050
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.count("BroadcastHashJoin") >= 2


def test_sets_link_at_their_similarity():
    """Texts of a known 5-word similarity: fingerprints differ by what the angle between the sets says."""
    rng, hits = random.Random(8), Counter()
    for _ in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for share, name in ((4, "near"), (60, "far")):
            other = list(own)
            for _ in range(share):
                other[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            a, b = ({tuple(t[i : i + 5]) for i in range(396)} for t in (own, other))
            similarity = len(a & b) / len(a | b)
            x, y = (int.from_bytes(simhash.fingerprint(" ".join(t), 5, wide=True)[0]) for t in (own, other))
            assert x == plain_set_fingerprint(" ".join(own))[0]
            hits[name, similarity >= 0.8, (x ^ y).bit_count() <= simhash.SET_RADIUS] += 1
    assert hits["near", True, True] >= 58 and sum(n for (k, _, linked), n in hits.items() if k == "far" and linked) == 0


def family_texts(rng, families=14):
    """Families of texts whose similarity runs from 0.4 to 1, chains among them, and some of other sizes."""
    texts = []
    for f in range(families):
        text = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((90, 200, 260)))]
        for k in range(12):
            own = list(text if f % 2 or not k else texts[-1].split())
            for _ in range(rng.choice((0, 1, 2, 4, 6, 9))):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own[: max(40, len(own) - rng.choice((0, 0, 30)))]))
    return texts + ["", " ", "one", "one", "one two", None]


def test_units_of_candidates_keep_every_confirmed_link():
    """Whatever the size of a unit, in one block or between two: the components of all pairs in the radius that are alike."""
    texts = sorted({(t or "").strip() for t in family_texts(random.Random(12))})
    hashes = [simhash.distinct_hashes(t) for t in texts]
    prints = np.stack([np.frombuffer(simhash.majority((h,), 16)[0], np.uint8) for h in hashes])
    sets = [np.ascontiguousarray(h[:, :8]).view(">u8").ravel() for h in hashes]
    sizes, plain, half = np.array([len(h) for h in hashes]), [plain_set(t) for t in texts], len(texts) // 2
    for right in (None, half):
        left, other = (prints, None) if right is None else (prints[:half], prints[half:])
        for most, step in ((1 << 21, 1 << 20), (500, 1 << 20), (2000, 300), (1, 1)):
            u, v = [], []
            for at, later in simhash.block_units(left, other, sizes, simhash.SET_RADIUS, most):
                order = at[np.argsort(later, kind="stable")]
                cut = int((~later).sum())
                x, y = simhash.similar_links(prints[order[:cut]], prints[order[cut:]] if later.any() else None, [sets[k] for k in order], 0.8, simhash.SET_RADIUS, step)
                u += order[x].tolist()
                v += order[y].tolist()
            own = list(range(len(texts)))
            want = plain_components([int.from_bytes(p.tobytes()) for p in prints], own, simhash.SET_RADIUS, lambda i, j: (right is None or (i < half) != (j < half)) and 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j]))
            groups = defaultdict(set)
            for i, c in enumerate(want):
                groups[c].add(i)
            assert {frozenset(g) for g in _groups(len(texts), np.array(u, int), np.array(v, int))} == {frozenset(g) for g in groups.values()}


def test_only_texts_of_the_similarity_go(spark, monkeypatch):
    """Against exact similarity alone; with many blocks and small units as with one."""
    texts = family_texts(random.Random(21))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least = {}
    for i, c in enumerate(plain_set_components(texts)):
        least.setdefault(c, i)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == sorted(least.values())
    nodes = simhash.written(simhash.distinct_prints(simhash.written(simhash.fingerprints(docs, shingle=5, wide=True))))
    rows = simhash.written(docs.select(F.col("doc_id").alias("row"), "text"))
    for block, most in ((None, 1 << 21), (20, 900)):
        links = simhash.set_links(nodes, rows, simhash.SET_RADIUS, 5, simhash.SEED, block=block, most=most)
        assert {r.component_id for r in simhash.labelled(nodes, links).collect()} == set(least.values())


def test_few_links_are_written_in_few_files(spark):
    """Components of a chain and a star of links stand in few files, whatever the number of partitions."""
    keys = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, before = {k: spark.conf.get(k, None) for k in keys}, set(common.made(spark))
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 300)]
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = {r["u"]: r["v"] for r in simhash.stars(spark.createDataFrame(links, "u long, v long")).collect()}
        tables = [f for f in common.made(spark) if f not in before]
        files = [len(spark.read.parquet(f).inputFiles()) for f in tables]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 300)}
    assert len(files) > 3 and max(files[1:]) <= common.WRITERS, files


def test_forest_keeps_components():
    rng = np.random.default_rng(6)
    for n in (1, 5, 50, 400):
        u, v = rng.integers(0, n, n), rng.integers(0, n, n)
        a, b = simhash.forest(u, v)
        assert len(a) < n
        groups = lambda x, y: {frozenset(g) for g in _groups(n, x, y)}
        assert groups(u, v) == groups(a, b)


def _groups(n, u, v):
    own = list(range(n))
    for _ in range(n):
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            own[a] = own[b] = min(own[a], own[b])
    out = defaultdict(list)
    for i, g in enumerate(own):
        out[g].append(i)
    return out.values()


def test_one_document_of_each_group_stays(spark, messy, monkeypatch):
    docs, rows = spark.read.parquet(f"{messy}/documents.parquet"), messy_rows()
    groups = defaultdict(list)
    for (i, *_), c in zip(rows, plain_set_components([t for _, t, *_ in rows]), strict=True):
        groups[c].append((i is None, i or 0))
    for most in (simhash.BITMAP_BYTES, 0):  # bitmaps broadcast, or joined by shuffle
        monkeypatch.setattr(simhash, "BITMAP_BYTES", most)
        out = simhash.deduplicated(docs)
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
        assert out.columns == docs.columns and got == sorted(min(g) for g in groups.values())


def test_language_model_learns_from_every_training_row(spark):
    rows = [(i, f"w{i % 7} of the w{i % 11} people " * (1 + i % 5)) for i in range(120)] + [(None, "a row without id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left_out = docs.where("doc_id is not null and pmod(xxhash64('own', cast(doc_id as string)), 16) <> 0")
    model = gru_lm.fit(left_out, F.lit(False), warm_rows=0)
    assert (model.net.flat() != gru_lm.Network(model.layout).flat()).any()
    model = gru_lm.fit(docs, F.lit(False))
    assert model.learned == model.total == sum(len(gru_lm.tokens(t)) for _, t in rows)
