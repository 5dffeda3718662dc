"""Queries with SQL against DuckDB on sf0.001; all others against
brute-force versions, round trips and held-out accuracy."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import language_id, ngram_join, packing, topk_search
from ledgerlens.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return {i: t or "" for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda row: tuple((v is None, str(type(v).__name__), v if v is not None else 0) for v in row)
    assert sorted((key(tuple(r[n] for n in names)) for r in df.collect())) == sorted(key(r) for r in cur.fetchall())


def shingles(text, n=5):
    words = text.encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            at[g].append(k)
    shared = Counter((a, b) for ks in at.values() for i, b in enumerate(ks) for a in ks[:i])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted((i, len(sets[k]), min(least[find(k)])) for k, (i, _) in enumerate(rows))


def near_copies(n, seed=0):
    """A hot group: near copies of one text, with others that share a passage."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    core, passage, rows = [word() for _ in range(120)], [word() for _ in range(60)], []
    for i in range(n):
        if i % 3 == 0:
            own = [word() for _ in range(80)] + passage
        else:
            own = list(core)
            for _ in range(rng.integers(0, 6)):
                own[rng.integers(0, len(own))] = word()
        rows.append((1000 - i, " ".join(own)))
    return rows


@pytest.mark.parametrize("block_shingles", [1 << 22, 1000])
def test_ngram_join_is_exact(spark, texts, block_shingles):
    rows = [*texts.items(), *((i + 10**6, t) for i, t in near_copies(150))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_classes(df, block_shingles=block_shingles).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(rows)


def test_warc_round_trip(spark, con):
    html = {i: (h or "").encode() for i, h in con.execute("SELECT page_id, html FROM pages").fetchall()}
    first = {}
    for i in sorted(html):
        first.setdefault(html[i], i)
    got = QUERIES["op2_warc"](spark, SF).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(
        (i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == i else "revisit",
         -1 if first[h] == i else first[h]) for i, h in html.items())


def test_lm_base_and_held_out(spark, texts):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    got = QUERIES["op5_lm_score"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(ws), n)
        assert r.n_known == sum(w in count for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_packing_round_trip(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = tokenizer.encode_batch(list(texts.values()), add_special_tokens=False)
    ids = {i: [*e.ids, 0] for i, e in zip(texts, found, strict=True)}
    got = QUERIES["op4_packing"](spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(pieces[i], len(ids[i])) for i in texts] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == (total or at) and (total is not None or at <= 1024)
    used = [sum(n for _, n in s) for s in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used)
    assert padding < 0.03 * (sum(used) + padding)


@pytest.mark.parametrize("text", [
    "hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext|", " <|endoftext|>\n\n", "<|im_start|> x"])
def test_packing_ids_of_added_tokens(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [0]
    row = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.length, r.ids_crc32) for r in row] == [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]


def slow_cuts(places, penalties, costs):
    best = [0.0]
    for i in range(1, len(places)):
        options = []
        for j in range(i):
            n = places[i] - places[j]
            if n <= costs.capacity:
                free = n & (n - 1) == 0 and n >= 64
                options.append(best[j] + (0 if free else costs.capacity - n))
        best.append(min(options) + penalties[i] + costs.window)
    return best[-1]


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_optimal(seed):
    rng = np.random.default_rng(seed)
    costs = packing.Costs(capacity=256)
    ids = rng.integers(0, 50, 3000).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(1, 3000, 9), 3000))
    places, penalties = packing.cut_places(ids, ends, np.arange(50) == 7, costs)
    cuts = packing.best_cuts(places, penalties, costs)
    at = {p: i for i, p in enumerate(places.tolist())}
    cost = 0.0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        n = b - a
        assert 0 < n <= costs.capacity
        cost += (0 if n & (n - 1) == 0 and n >= 64 else costs.capacity - n) + penalties[at[b]] + costs.window
    assert math.isclose(cost, slow_cuts(places.tolist(), penalties.tolist(), costs), rel_tol=1e-6)


def test_language_id_held_out(spark, con):
    got = QUERIES["op10_language_id"](spark, SF).collect()
    gold = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert len(got) == len(gold)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == gold[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.accepted for r in got)  # clean documents stay


def test_language_id_rejects_noise(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs, steps=60)
    assert not language_id.has_letter("12 %% 34") and language_id.has_letter("12 é")
    assert 0 <= model.threshold <= 0.4 and model.temperature >= 1


@pytest.mark.parametrize("rows,k", [(300, 5), (40, 5), (3, 5)])
def test_topk_matches_brute_force(spark, rows, k):
    rng = np.random.default_rng(rows)
    vectors = np.round(rng.normal(0, 0.3, (rows, 8)), 1).astype(np.float32)  # many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 7 == 0, k=k, block_rows=64, resolve_rows=6).collect())
    whole = np.floor(vectors.astype(float) * 256).astype(int)
    wanted = []
    for q in range(0, rows, 7):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(rows) if i != q)[:k]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(wanted)
