"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and brute-force versions."""

import collections
import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ann, decontamination, html_text, jaccard_join, line_dedup, lm_scoring, packing, quality, secrets, token_files, tokens
from quantloom.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, words string, n long, key string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def sentence(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "w", 1, "k") for i, t in rows], DOC)


LONG = sentence(30_000, 1)
ROWS = [(1, None), (2, ""), (3, "one two"), (4, "One\ttwo "), (5, sentence(60, 2)), (6, sentence(60, 2)), (6, sentence(60, 2)), (7, LONG), (8, LONG + " more"), (None, sentence(40, 3)), (9, "日本 ünï\n\n x")]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# ---- line dedup

def brute_lines(rows, min_docs):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate({c: c + 32 for c in range(65, 91)})
    seen = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shared", [line_dedup.MAX_SHARED, 0])
def test_line_dedup_like_brute_force(spark, monkeypatch, shared):
    monkeypatch.setattr(line_dedup, "MAX_SHARED", shared)
    rows = ROWS + [(20 + i, f"Shared LINE \n{sentence(5, i)}\n\tshared line") for i in range(6)]
    df = docs_of(spark, rows)
    got = line_dedup.LineIndex(spark, min_docs=3, shards=4).insert(df).dedup(df)
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=str) == brute_lines(rows, 3)
    assert set(df.columns) <= set(got.columns)


@pytest.mark.parametrize("per_shard", [line_dedup.PER_SHARD, 0.1])
def test_line_index_is_reversible(spark, monkeypatch, per_shard):
    monkeypatch.setattr(line_dedup, "PER_SHARD", per_shard)  # the small one makes more shards at once
    a, b = [(i, f"common\nown {i}") for i in range(4)], [(10 + i, "common\nfresh") for i in range(4)]
    index = line_dedup.LineIndex(spark, min_docs=4, shards=4).insert(docs_of(spark, a))
    before = sorted(map(tuple, index.counts().where("n > 0").select("h1", "h2", "n").collect()))
    index.insert(docs_of(spark, b))
    assert {r.text for r in index.dedup(docs_of(spark, b)).collect()} == {""}
    index.delete(docs_of(spark, b))
    assert sorted(map(tuple, index.counts().where("n > 0").select("h1", "h2", "n").collect())) == before
    assert {r.text for r in index.dedup(docs_of(spark, b)).collect()} == {"fresh"}
    index.delete(docs_of(spark, a[:1]))
    assert {r.n_dropped for r in index.dedup(docs_of(spark, a[1:])).collect()} == {0}


def test_line_dedup_empty(spark, empty):
    assert line_dedup.LineIndex(spark).insert(empty).dedup(empty).count() == 0


def test_cuckoo_filter_holds_all_and_deletes():
    h = np.random.default_rng(0).integers(0, 2**63, (2, 5000)).astype(np.uint64)
    f = line_dedup.CuckooFilter.sized(5000)
    assert f.insert(*h)
    whole = line_dedup.FilterSet(1, {0: (f.buckets, f.cells.tobytes())})
    assert whole.may_hold(*h).all()
    f.delete(h[0][:2500], h[1][:2500])
    assert (f.cells != 0).sum() == 2500
    left = line_dedup.FilterSet(1, {0: (f.buckets, f.cells.tobytes())})
    assert left.may_hold(h[0][2500:], h[1][2500:]).all() and left.may_hold(h[0][:2500], h[1][:2500]).mean() < 0.01


# ---- jaccard join

def brute_components(rows, width=5, percent=80):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((i, {tuple(w[k : k + min(width, len(w))]) for k in range(len(w) - min(width, len(w)) + 1)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(a), find(i)) for i, a in sets)


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def test_jaccard_like_brute_force(spark):
    rows = [(i, t) for i, t in ROWS if i is not None]
    base = {n: sentence(n, n) for n in (30, 200, 700, 1500)}
    passage, number = sentence(60, 77), 100
    for n, t in base.items():
        for k in range(12):
            rows.append((number, edited(t, k % 7 * n // 150, number)))
            number += 1
        rows.append((number, passage + " " + sentence(n, number)))
        number += 1
    rows += [(number + k, passage + " " + sentence(40, number + k)) for k in range(30)]
    got = jaccard_join.jaccard_components(docs_of(spark, rows), block=8).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_jaccard_null_id_and_empty(spark, docs, empty):
    got = jaccard_join.jaccard_components(docs)
    assert got.count() == len(ROWS) and got.where("doc_id is null and component_id is not null").count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_partial_components_never_join_too_much(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    whole = {x.id: x.component for x in components(df).collect()}
    for rounds in (1, 2):
        part = components(df, rounds).collect()
        assert len(part) == len(whole) and all(whole[x.id] == whole[x.component] for x in part)


def test_jaccard_rows_of_one_id_are_one_document(spark):
    a, b = sentence(40, 70), sentence(40, 71)
    rows = [(3, a), (5, a), (5, b), (8, b), (8, None), (9, ""), (9, b + " x"), (11, sentence(30, 72)), (11, sentence(30, 73)), (None, b), (None, "")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {(3, 3), (5, 3), (8, 3), (9, 3), (11, 11), (None, 3), (None, None)}
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(docs_of(spark, rows), percent=50)


def test_jaccard_pair_comes_from_one_group(spark, monkeypatch):
    """Near copies share many groups; each pair is sent on once."""
    sent = []
    plain = jaccard_join.materialize

    def watched(df, name):
        out = plain(df, name)
        if name == "pairs":
            plan = df._jdf.queryExecution().analyzed().toString()
            sent.append((out.count(), plan))
        return out

    monkeypatch.setattr(jaccard_join, "materialize", watched)
    monkeypatch.setattr(jaccard_join, "SALTS", ())
    base = sentence(200, 80).split()
    rows = [(i, " ".join([*base[:i], f"w{i}", *base[i + 1 :]])) for i in range(12)]
    groups = {r.component_id for r in jaccard_join.jaccard_components(docs_of(spark, rows)).collect()}
    assert groups == {0} and sent[0][0] == 66


def test_jaccard_no_task_holds_a_large_group(spark, monkeypatch):
    plain = jaccard_join._candidates

    def watched(percent, salt):
        inner = plain(percent, salt)

        def run(batches):
            from collections import Counter

            kept = list(batches)
            rows = Counter(k for b in kept for k in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
            if max(rows.values(), default=0) > 80:
                raise ValueError(f"{max(rows.values())} rows of a group in one task")
            yield from inner(iter(kept))

        return run

    monkeypatch.setattr(jaccard_join, "_candidates", watched)
    base = sentence(200, 5)
    rows = [(i, edited(base, i % 5, i)) for i in range(300)] + [(1000 + i, base + " " + sentence(300, i)) for i in range(20)]
    got = jaccard_join.jaccard_components(docs_of(spark, rows), block=16).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


@pytest.mark.parametrize("last", [[9], [7, 8, 9], []])
def test_jaccard_parts_of_a_group_share_its_name(monkeypatch, last):
    monkeypatch.setattr(jaccard_join, "MAX_SEEN", 3)
    rows = [(1, 50), (1, 51)] + [(2, c) for c in range(7)] + [(2, c) for c in last] + [(3, 60), (3, 61)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k : k + 3], strict=True)], ["sig", "c1"]) for k in range(0, len(rows), 3)]
    groups = collections.defaultdict(set)
    for b in jaccard_join._groups(iter(batches)):
        for gid, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            groups[gid].add(c)
    assert sorted(map(sorted, groups.values())) == sorted([[50, 51], [*range(7), *last], [60, 61]])


def test_jaccard_row_without_id_before_its_copies(spark):
    text = sentence(40, 8)
    rows = [(None, text), (1, text), (2, text + " more"), (None, text)]
    got = jaccard_join.jaccard_components(docs_of(spark, rows).coalesce(1)).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted([(None, 1), (1, 1), (2, 1), (None, 1)], key=str)


def test_bounds_never_lose_a_pair():
    r = np.random.default_rng(1)
    for n in (5, 40, 500, 530, 4000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.92 * len(a))], r.integers(0, 2**63, n // 20).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        similar = 100 * both >= 80 * (len(a) + len(b) - both)
        p = jaccard_join.Points(np.arange(2), np.arange(2), np.array([len(a), len(b)]), [jaccard_join.point(a), jaccard_join.point(b)])
        assert not similar or p.passing(np.array([0]), np.array([1]), 80)[0]
        prefix = lambda s: s[: len(s) - -(-80 * len(s) // 100) + 1]
        assert not similar or np.intersect1d(prefix(a), prefix(b)).size


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51), (60, 60)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 50, 51: 50}


# ---- decontamination

@pytest.mark.parametrize("shared", [decontamination.MAX_SHARED, 0])
def test_decontamination_like_brute_force(spark, monkeypatch, shared):
    monkeypatch.setattr(decontamination, "MAX_SHARED", shared)
    item = sentence(40, 9).split()
    items = [(1, " ".join(item)), (2, "short item only"), (3, None), (4, ""), (None, sentence(20, 10)), (10, " ".join(item[:20])), (11, "solo")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = ROWS + [(40, "A b " + ", ".join(item[5:30]).upper() + " c"), (41, "x Short-item ONLY y"), (42, sentence(500, 11) + " " + " ".join(item[:13])), (43, "solo " * 3)]
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word(t)
        n = min(13, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    expected = []
    for i, t in rows:
        w, hit, ids = word(t), set(), set()
        for p, own in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= own
        expected.append((i, len(w), len(hit), tuple(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontamination.contamination(docs_of(spark, rows), bench).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got], key=str) == sorted(expected, key=str)


def test_decontamination_empty(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, bench).where("contaminated or n_hit > 0").count() == 0
    assert decontamination.contamination(empty, bench).count() == 0


def test_extra_columns_of_any_name(spark):
    """Operators that keep the columns of docs keep any name."""
    names = "bad _bad id _id hash _hash _text _h1 _h2 h1 keys gone twice _trusted chosen judge row key _key hits _hits".split()
    df = docs_of(spark, [(1, "one line\nof text"), (2, "another line\nof text"), (3, None)]).drop("key").withColumns({n: F.lit(n) for n in names})
    bench = spark.createDataFrame([(1, "another line of")], "item_id long, text string")
    outs = [decontamination.decontaminated(df, bench), quality.accepted(df, df.select(F.col("doc_id").alias("known"))), line_dedup.LineIndex(spark, min_docs=2, shards=4).insert(df).dedup(df)]
    for out, kept in zip(outs, (2, 3, 3), strict=True):
        rows = out.collect()
        assert len(rows) == kept and all(r[n] == n for r in rows for n in names) and set(df.columns) <= set(out.columns)


# ---- tokens, files, packing

@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_chunks_give_the_library_ids(whole):
    alphabet = list("aAbBzZ.,,.;:'\"-éÉßÇ×÷ẞ日٣４①ﬁ…«»<|>$#  \n\t\x0b\x1c\x85 ́̇İΣK1290") + ["'s", "'re", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>"]
    r = random.Random(3)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(3000)] + [t or "" for _, t in ROWS]
    ids, lengths = tokens.encoder(tokens.default_tokenizer()).encode_all([t.encode() for t in texts], 1)
    got = np.split(ids, np.cumsum(lengths)[:-1])
    assert [g.tolist() for g in got] == [x.ids + [1] for x in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n, high", [(0, 5), (1, 5), (4096, 49408), (9000, 1), (20_000, 300), (5000, 2**31)])
def test_blocks_round_trip(n, high):
    x = np.random.default_rng(n).integers(0, high, n).astype(np.uint32)
    blocks = token_files.encode_blocks(x)
    assert (token_files.decode_blocks(b"".join(blocks), len(blocks)) == x).all()


def test_damaged_block_is_found():
    x = np.random.default_rng(0).integers(0, 500, 3000).astype(np.uint32)
    raw = bytearray(b"".join(token_files.encode_blocks(x)))
    raw[-200] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_blocks(bytes(raw), 1)


def sentences(n, seed=0):
    """Ids of uneven frequencies, a fifth of them followed by a fixed one."""
    r = np.random.default_rng(seed)
    x = (3000 * r.random(n) ** 3).astype(np.int64)
    fixed = np.flatnonzero(r.random(n - 1) < 0.2)
    x[fixed + 1] = x[fixed] * 7 % 3000
    return x.astype(np.uint32)


def test_blocks_take_fewer_bits_than_order_0():
    x = sentences(400_000)
    p = np.bincount(x)[np.unique(x)] / len(x)
    assert 8 * sum(map(len, token_files.encode_blocks(x))) / len(x) < -(p * np.log2(p)).sum()


def test_coding_takes_few_passes_over_ids():
    x = sentences(1_200_000)
    blocks = token_files.encode_blocks(x)
    data = b"".join(blocks)

    def least(work):
        times = []
        for _ in range(3):
            start = time.process_time()
            work()
            times.append(time.process_time() - start)
        return min(times)

    rows = np.ascontiguousarray(x[: 4096 * 290].reshape(290, 4096).T).astype(np.int64)
    table, at = np.zeros(290 * 4096, np.int64), np.arange(290) * 4096

    def passes():
        """One step of a gather, a product and a scatter over 290 blocks, for each place in a block."""
        for row in rows:
            table[at + row] = table.take(at + row) * row

    assert least(lambda: (token_files.encode_blocks(x), token_files.decode_blocks(data, len(blocks)))) < 30 * least(passes)  # about 50 with all done a step at a time


@pytest.mark.parametrize("n", [2, 4097, 8192, 30_011])
def test_blocks_of_several_groups(n, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 3)
    x = sentences(n)
    blocks = token_files.encode_blocks(x)
    assert len(blocks) == -(-n // 4096) and (token_files.decode_blocks(b"".join(blocks), len(blocks)) == x).all()


def test_any_damage_to_blocks_is_found():
    x, r = sentences(9000), np.random.default_rng(1)
    blocks = token_files.encode_blocks(x)
    raw = b"".join(blocks)
    for i in r.integers(0, len(raw), 100).tolist():
        bad = bytearray(raw)
        bad[i] ^= 1 << int(r.integers(8))
        with pytest.raises((ValueError, struct.error)):
            token_files.decode_blocks(bytes(bad), len(blocks))


def test_token_files_like_the_library(spark, docs, whole, empty):
    from quantloom.llm.common import shared_path

    path = shared_path(spark, "test-tokens")
    token_files.write_tokens(docs, path, files=3)
    got = token_files.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([i for i, _ in ROWS], key=lambda i: -1 if i is None else i)
    start, by_id = 0, {i: whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in ROWS}
    for r in got:
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(by_id[r.doc_id]), by_id[r.doc_id], zlib.crc32(np.array(by_id[r.doc_id], "<u4").tobytes()))
        start += r.n_tokens
    path = shared_path(spark, "test-tokens")
    token_files.write_tokens(empty, path)
    assert token_files.read_tokens(spark, path).count() == 0


def test_fullest_combination_like_brute_force():
    r = random.Random(0)
    for _ in range(60):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(6)}
        room = r.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == max(sums) and all(chosen.count(k) <= counts[k] for k in set(chosen))


def test_packing_is_whole_and_gapless(spark, docs, whole, empty):
    rows = packing.pack(docs, capacity=64).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    expected = collections.Counter()
    for i, t in ROWS:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            expected[i, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(empty).count() == 0


# ---- secrets

def test_secrets_like_the_patterns(spark, empty):
    texts = ["token = 'abcdEFGH12'", "API_KEY:short apikey:\"longenough=1\"", "x AKIAABCDEFGHIJKL12 AKIASHORT", "é" * 3 + " " + "0f" * 16 + " " + "0f" * 15, "ſecret=abcdefghij", None, "", "key aZ8kQ2xv91LmPq0TrYw3BnUj end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50 + i, sentence(200, i)) for i in range(5)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan_secrets(docs_of(spark, rows)).collect()}
    assign = re.compile(r"""((?:p|P)assword|token|secret|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in rows:
        t = t or ""
        base = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert sorted(s for s in got[i] if s[0] != "markov") == sorted(base)
    assert [s[0] for s in got[7]] == ["markov"] and not any(got[50 + i] for i in range(5))
    assert secrets.scan_secrets(empty).count() == 0


# ---- language models

def test_scores_prefer_the_target(spark, empty):
    rows = [(i, sentence(80, i)) for i in range(30)] + [(100 + i, " ".join(w.upper() + "!!" for w in sentence(80, i).split())) for i in range(10)] + [(200, None), (201, "")]
    df = docs_of(spark, rows)
    ids = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(df, ids).collect()}
    assert max(got[i].score for i in range(30)) < min(got[100 + i].score for i in range(10))
    assert got[200].score is None and got[201].n_tokens == 0
    assert lm_scoring.cross_entropy_difference(empty, ids).count() == 0


def test_scores_do_not_depend_on_the_number_of_ngrams(spark, docs, monkeypatch):
    from quantloom.llm import ngrams

    df = docs.unionByName(docs_of(spark, [(None, sentence(30, 12)), (None, None), (None, ""), (2, "")]))
    ids = spark.createDataFrame([(i,) for i in (5, 6, 7)], "doc_id long")

    def scored():
        one = [tuple(r) for r in lm_scoring.cross_entropy_difference(df, ids).collect()]
        two = [(r.doc_id, r.n_tokens, r.perplexity) for r in quality.classify(df, ids).collect()]
        return [sorted(x, key=lambda r: tuple(-1.0 if v is None else v for v in r)) for x in (one, two)]

    small = scored()
    monkeypatch.setattr(ngrams, "MAX_SHARED", 0)
    for a, b in zip(small, scored(), strict=True):
        assert len(a) == len(b) == len(ROWS) + 4
        assert [r[:2] for r in a] == [r[:2] for r in b]
        assert all(u == v or u == pytest.approx(v, abs=1e-11) for x, y in zip(a, b, strict=True) for u, v in zip(x[2:], y[2:], strict=True))


def test_kneser_ney_sums_to_one(spark):
    from quantloom.llm.ngrams import count_grams

    text = sentence(300, 4)
    df = docs_of(spark, [(1, text)]).select("text", F.lit(1).alias("part"))
    counts = count_grams(df, 2, 2)
    symbols = sorted({ord(c) for c in text})
    pairs = [(a << 16 | b, 0, 0) for a in symbols for b in symbols]
    every = counts.unionByName(spark.createDataFrame(pairs, counts.schema)).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    loss = {r.gram: r.loss for r in quality.kneser_ney(every, 2, len(symbols)).collect()}
    total = sum(np.exp(-loss[ord("a") << 16 | b]) for b in symbols)
    assert total == pytest.approx(1.0, abs=1e-6)


def test_quality_keeps_clean_and_rejects_junk(spark, empty):
    rows = [(i, sentence(80, i)) for i in range(80)] + [(100 + i, " ".join(w.upper() + "$$$" for w in sentence(80, i).split())) for i in range(10)] + [(200, None), (201, ""), (202, "ab")]
    df = docs_of(spark, rows)
    ids = spark.createDataFrame([(i,) for i in range(70)], "doc_id long")
    keep = {r.doc_id: r.keep for r in quality.classify(df, ids).collect()}
    # So few documents set rough thresholds; on the tables 3 of 3409 good documents go.
    assert sum(keep[i] for i in range(80)) >= 78 and keep[200] and keep[201] and not any(keep[100 + i] for i in range(10))
    kept = quality.accepted(df, ids)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, k in keep.items() if k}
    assert quality.classify(empty, ids).count() == 0
    assert quality.classify(df, ids.where("doc_id < 0")).where("not keep").count() == 0


# ---- nearest neighbours

def test_recall_and_exact_scores(spark):
    v = np.random.default_rng(2).normal(size=(1500, 24)).astype(np.float32)
    v[5] = v[6] = v[7] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (5080, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=20, block_rows=100).toPandas()
    x, found = v.astype(np.float64), 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in g["vec_id"].tolist()
        assert np.allclose(g["score"], x[g["vec_id"]] @ x[q], atol=1e-12)
        assert [tuple(t) for t in g[["score", "vec_id"]].values] == sorted([tuple(t) for t in g[["score", "vec_id"]].values], key=lambda t: (-t[0], t[1]))
        s = x @ x[q]
        s[q] = -np.inf
        found += len(set(np.lexsort((np.arange(len(s)), -s))[:20]) & set(g["vec_id"]))
    assert got["query_id"].nunique() == 75 and found / 1500 >= 0.9


def test_repeated_ids_leave_room_for_others(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(30)] + [(2 + i, [0.9 - 0.01 * i, 0.01]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(i, i) for i in range(1, 6)]
    assert got[0].score == 1.0


def test_few_rows_give_all_candidates(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0, k=20).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3, 4, 5]
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


# ---- pages

PAGE = """<html><body class="home sidebar-right"><header><h1>Site</h1><ul><li><a href=1>Home</a></ul></header><div id="cookie-notice">We use cookies, and so on.</div>
<div id=main><div class=post><h2>My title</h2><p>First paragraph &amp; more, of text that is long enough to be taken as content, no doubt.<p>Second one, with <i>inline</i>
 text; it goes on. And on.<script>var t="</p>";</script><ul><li>point one<li>point two</ul><div class="share">Share this. On all nets.</div></div>
<div class="comments"><p>I like this article, really. Great stuff! Thanks, all.</p></div></div><aside>Side things.</aside><form>Your name: <input></form><footer>(c) all rights.</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "plain text, only. Yes."), (4, "u", "<p>broken <b>bold<br>line</p></div>"), (5, "u", "<nav>menu</nav>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()]
    whole = "My title First paragraph & more, of text that is long enough to be taken as content, no doubt. Second one, with inline text; it goes on. And on. point one point two"
    assert sorted(got) == sorted([(1, whole, len(whole)), (2, "", 0), (3, "", 0), (4, "plain text, only. Yes.", 22), (4, "broken bold line", 16), (5, "", 0)])


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_neighbours_do_not_depend_on_the_number_of_rows(spark):
    """A pair that meets in a small table meets in a larger one that holds it."""
    r = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(6000, 64)))]
    found = lambda n: ann.nearest(spark.createDataFrame(rows[:n], "vec_id long, embedding array<double>"), F.col("vec_id") < 40, k=20).toPandas()
    few, many = found(500), found(6000)
    last = many.groupby("query_id").score.min().to_dict()
    held = set(zip(many.query_id, many.vec_id, strict=True))
    near = [(q, v) for q, v, s in few[["query_id", "vec_id", "score"]].itertuples(index=False) if s > last[q]]
    assert len(near) > 20 and set(near) <= held
