"""Every registered training-data query on the smallest tables: against its SQL, or against plain Python over the same rows."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from quantloom.llm import html_text, queries, quality, secrets
from quantloom.llm.common import table

TABLES = "documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    """Rows of each query, made once."""
    made = {}

    def rows(name):
        if name not in made:
            made[name] = queries.QUERIES[name](spark, sf_dir).toPandas()
        return made[name]

    return rows


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return {t: table(spark, sf_dir, t).toPandas() for t in TABLES}


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def rows_of(df, columns):
    """Values as text; a column of whole numbers with nulls is floating in one frame and not in the other."""
    shown = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return sorted(tuple(map(shown, row)) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(results, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    theirs = c.sql(queries.ORACLE_SQL[name]).df()
    ours = results(name)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours, sorted(ours.columns)) == rows_of(theirs, sorted(ours.columns))


def test_html(results, data):
    expected = {(r.page_id, r.url): html_text.main_text(r.html) for r in data["pages"].itertuples()}
    got = results("op1_html_extraction")
    assert len(got) == len(data["pages"]) and all(expected[r.page_id, r.url] == r.text and len(r.text) == r.n_chars for r in got.itertuples())


def test_secrets(results, data):
    patterns = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
    }
    least = {"assign": 8, "access": 16, "hex": 32}
    got = {r.doc_id: r for r in results("op3_secret_scan").itertuples()}
    assert len(got) == len(data["documents"])
    for d in data["documents"].itertuples():
        spans = [(m.start(), list(least).index(k), k, m.end()) for k, p in patterns.items() for m in p.finditer(d.text or "") if len(m[2] if k == "assign" else m[0]) >= least[k]]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        r = got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        n = collections.Counter(k for _, _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == [s for s in joined.split(",") if s]


def test_language_models(results, data):
    four, five = results("op4_lm_scoring"), results("op5_quality_classifier")
    assert len(four) == len(five) == len(data["documents"])
    assert (four.score.dropna() - (four.target_loss - four.background_loss).dropna()).abs().max() < 1e-12
    labels = data["labels"].set_index("doc_id")
    kept = five.set_index("doc_id").keep
    good = [i for i in labels.index[labels.quality == 1] if i in kept.index]
    bad = [i for i in labels.index[labels.quality == 0] if i in kept.index]
    assert kept[good].mean() >= 0.95 and (not bad or kept[bad].mean() <= 0.5)


def test_neighbours(results, data):
    fine = {r.vec_id: np.array(r.embedding, float) for r in data["embeddings"].itertuples() if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)}
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids.tolist()])
    found = total = 0
    got = results("op7_nearest_neighbours")
    assert set(got.query_id) == {i for i in fine if i % 20 == 0}
    for q, g in got.groupby("query_id"):
        s = x @ fine[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        found, total = found + len(set(best) & set(g.vec_id)), total + len(best)
        assert np.allclose([fine[i] @ fine[q] for i in g.vec_id], g.score, atol=1e-12) and sorted(g["rank"]) == list(range(1, len(g) + 1))
    assert found / total >= 0.9


def test_token_files_and_packing(results, data, whole):
    ids = {d.doc_id: np.array([*whole.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4") for d in data["documents"].itertuples()}
    start, got = 0, results("op8_token_files").set_index("doc_id")
    for i in sorted(ids):
        assert tuple(got.loc[i, ["start", "n_tokens", "ids_crc32"]]) == (start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    pieces, bins = results("op9_best_fit_packing"), collections.defaultdict(list)
    for r in pieces.itertuples():
        own = ids[r.doc_id][4096 * r.piece : 4096 * (r.piece + 1)]
        assert (r.start, r.length, r.ids_crc32) == (4096 * r.piece, len(own), zlib.crc32(own.tobytes()))
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(pieces) == sum(-(-len(x) // 4096) for x in ids.values())
    for parts in bins.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(bins) <= -(-start // 4096) + 1


def pipeline_by_hand(spark, sf_dir, data):
    """Texts by id after all filtering stages, in plain Python but for the classifier's verdicts."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    keep = {r.doc_id for r in quality.classify(table(spark, sf_dir, "documents"), trusted).where("keep").collect()}
    texts = {d.doc_id: d.text for d in data["documents"].itertuples() if d.doc_id in keep}
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(lower)
    seen = collections.Counter(k for t in texts.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    texts = {i: "\n".join(x for x in (t or "").split("\n") if seen[key(x)] < 10) for i, t in texts.items()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    first = {i: i for i in texts}

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    order = sorted(texts)
    for n, i in enumerate(order):
        for j in order[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                first[b] = a
    texts = {i: t for i, t in texts.items() if find(i) == i}
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = set()
    for b in data["benchmark"].itertuples():
        w = word(b.text)
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in texts.items():
        w, hit = word(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def test_pipeline_like_plain_python_twice(spark, sf_dir, data, whole):
    expected = pipeline_by_hand(spark, sf_dir, data)
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in expected.items()}
    pieces = sorted((i, k, 4096 * k, len(x[4096 * k : 4096 * k + 4096]), zlib.crc32(x[4096 * k : 4096 * k + 4096].tobytes())) for i, x in ids.items() for k in range(-(-len(x) // 4096)))
    for _ in range(2):
        got = corpus_pipeline.run(spark, sf_dir).collect()
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
