"""Bottom-k sketch classes against brute force, also with blocks so small
that every class is split, and the edge cases."""

import random
import time
from itertools import combinations

import duckdb
import numpy as np
import pytest

from ledgerlens.llm import minhash
from ledgerlens.llm.sketch_join import SKETCH, SketchIndex, sketch_links


def shingles(text, n=4):
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(rows):
    """Rows of (id, text) to (id, size, smallest id, kept), ids not null."""
    sets = [shingles(t) for _, t in rows]
    own = list(range(len(rows)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4:
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                own[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def got(spark, rows, schema="doc_id long, text string", **options):
    df = minhash.sketch_classes(spark.createDataFrame(rows, schema), **options)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return [tuple(r) for r in df.collect()]


def near_copies(rng, stem, copies, words=120):
    base = [f"{stem}{rng.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, 6)):
            own[at] = f"new{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    texts = []
    for g in range(6):
        texts += near_copies(rng, f"g{g}x", (2, 3, 5, 9, 20, 40)[g])
    texts += ["one two three", "one two three", "ONE two\tthree", "one two", "a b c d", "a b c d e", "a b c d e f"]
    passage = " ".join(f"shared{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"own{k}w{i}" for i in range(90)) for k in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block_shingles", [minhash.BLOCK_SHINGLES, 500])
def test_planted_groups(spark, planted, block_shingles):
    assert sorted(got(spark, planted, block_shingles=block_shingles)) == brute(planted)


def test_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    df = minhash.op13_minhash(spark, sf)
    assert sorted(tuple(r) for r in df.collect()) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "x"), (8, "x"), (3, long), (2, long + " end"), (1, "é É"), (0, "É é")]
    assert sorted(got(spark, rows)) == brute(rows)
    assert got(spark, []) == []


def test_null_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (None, base + " tail"), (None, "alone but null"), (None, None), (4, base), (4, "other text of four")]
    found = sorted(got(spark, rows), key=str)
    assert found == sorted([
        (None, 57, 4, None), (None, 58, 4, None), (None, 1, None, None), (None, 0, None, None), (4, 57, 4, True), (4, 1, 4, True),
    ], key=str)


def test_many_null_ids_do_not_meet(spark):
    rows = [(None, f"text number {i} has words {i * 7} of {i * 13} its own {i}") for i in range(3000)]
    assert len(got(spark, rows)) == 3000


def test_clashing_columns(spark, planted):
    rows = [(*r, 1, "x", 2, 3, "y") for r in planted[:60]]
    names = "doc_id long, text string, n int, number string, block int, value long, class string"
    assert sorted(got(spark, rows, names)) == brute(planted[:60])


def exact(a, b):
    both = len(np.intersect1d(a, b))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def pair_state(a, b):
    """(overlap of the sketches, whether the estimate lets the pair pass, overlap of the sets)."""
    index = SketchIndex([a, b], 2, 4, 5)
    other = np.array([0])
    shared = index.shared.of(1, other)
    return int(shared[0]), bool(index.may_link(1, other, shared)[0]), int(index.overlaps.of(1, other)[0])


def test_estimate_is_exact_for_whole_sets_and_never_loses_a_similar_pair():
    rng = np.random.default_rng(1)
    for size in (3, 10, 40, 63, 64, 65, 80, 100, 400):
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            changed = rng.integers(0, max(1, size // 9) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[changed:], rng.integers(0, 1 << 63, changed, np.uint64)]))
            shared, passes, overlap = pair_state(a, b)
            assert shared == len(np.intersect1d(a[:SKETCH], b[:SKETCH])) and overlap == len(np.intersect1d(a, b))
            if exact(a, b):
                assert passes
            elif max(len(a), len(b)) <= SKETCH:
                assert not passes


@pytest.mark.parametrize("changed", [4, 14, 20])
def test_a_block_of_near_copies_equals_brute_force(changed):
    """All, some or next to none of the pairs of one group link."""
    rng = np.random.default_rng(changed)
    base = np.unique(rng.integers(0, 1 << 63, 150, np.uint64))
    sets = [np.unique(np.append(rng.permutation(base)[changed:], rng.integers(0, 1 << 63, changed, np.uint64))) for _ in range(150)]
    links = sketch_links([(i, i, 2, s) for i, s in enumerate(sets)], 4, 5)
    own = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if own[i] != own[j] and exact(sets[i], sets[j]):
            least, most = sorted((own[i], own[j]))
            own = [least if o == most else o for o in own]
    assert dict(links) == {i: o for i, o in enumerate(own) if i != o}


def test_a_large_group_that_does_not_link_is_fast():
    """Pairs below the threshold that only exact similarity turns away."""
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 120, np.uint64))
    sets = [np.unique(np.append(rng.permutation(base)[18:], rng.integers(0, 1 << 63, 18, np.uint64))) for _ in range(4000)]
    start = time.monotonic()
    sketch_links([(i, i, 2, s) for i, s in enumerate(sets)], 4, 5)
    assert time.monotonic() - start < 30
