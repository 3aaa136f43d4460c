"""Near-duplicate texts, vectors and connected components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import embed_dedup, minhash, texts
from panelspark.llm.components import components


def groups_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    links = [tuple(map(int, x)) for x in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(150, 190)] + [(200, i) for i in range(201, 260)]
    edges = spark.createDataFrame(links + links[:9] + [(None, 3), (4, None)], "a long, b long")
    want = groups_of(260, links)
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {x: want[x] for x in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text, width):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = low.encode().split()
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(width))))


def brute(rows, width, percent):
    sets = {i: words_of(t, width) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for y in range(x):
            p, q = sets[a], sets[ids[y]]
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                links.append((x, y))
    return {i: ids[g] for i, g in zip(ids, groups_of(len(ids), links))}, {i: len(s) for i, s in sets.items()}


def corpus(seed):
    """Groups of copies whose edits lie around the threshold, and odd texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = []
    for size in (40, 25, 6, 2, 2, 1, 1):
        base = list(rng.choice(vocabulary, int(rng.integers(30, 200))))
        for _ in range(size):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 18)))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            rows.append(" ".join(copy))
    rows += ["", None, " \n\t ", "one", "ONE", "two words", "Two  words", "a b c", "a b c", "É b c", "é b c"]
    order = rng.permutation(len(rows))
    return [(int(k), rows[j]) for k, j in enumerate(order)]


@pytest.mark.parametrize("width, percent, chunk", [(3, 85, 512), (5, 80, 7)])
def test_near_copies_equal_brute_force(spark, monkeypatch, width, percent, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    rows = corpus(chunk)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in minhash.dedup(docs, percent, width).collect()}
    want, sizes = brute(rows, width, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_near_copies_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, "a b c d e f", 0), (None, "a b c d e f", 0), (3, None, 0), (4, "", 0)],
        "doc_id long, text string, component long")
    got = minhash.dedup(docs, 85, 3).select("id", "n_shingles", "component_id", "kept").collect()
    got = sorted(map(tuple, got), key=str)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (None, 4, None, True), (3, 0, 3, True), (4, 0, 4, True)], key=str)
    assert minhash.dedup(docs.limit(0)).count() == 0


def repeated_ids(seed):
    """(place, id, text): ids come up to four times, with equal and with other texts."""
    rng = np.random.default_rng(seed)
    rows = [(i, t) for i, t in corpus(seed) if t is not None]
    rows = [(int(rng.integers(0, len(rows) // 3)), t) for _, t in rows]
    rows += [rows[int(k)] for k in rng.integers(0, len(rows), 12)]
    return [(place, i, t) for place, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_repeated_ids_lose_no_link_and_no_row(spark, seed):
    rows = repeated_ids(seed)
    by_place, _ = brute([(place, t) for place, _, t in rows], 5, 80)
    ids = {place: i for place, i, _ in rows}
    low = {}
    for place, group in by_place.items():
        low[group] = min(low.get(group, ids[place]), ids[place])
    want = sorted((ids[place], len(words_of(t, 5)), low[by_place[place]] if words_of(t, 5) else ids[place])
                  for place, _, t in rows)
    docs = spark.createDataFrame(rows, "place long, doc_id long, text string").repartition(6)
    got = minhash.dedup(docs).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.id == r.component_id) for r in got)
    kept = [r.place for r in minhash.distinct_rows(docs).collect()]
    blank = [place for place, _, t in rows if not words_of(t, 5)]
    groups = [by_place[place] for place in kept if place not in blank]
    assert len(kept) == len(set(kept)) and set(blank) <= set(kept)
    assert sorted(groups) == sorted({by_place[place] for place, _, t in rows if place not in blank})


def test_one_id_with_two_texts(spark):
    """The copy of either text is found, and a text of its own under a copied id stays."""
    a, b = " ".join(f"w{k}" for k in range(62)), " ".join(f"v{k}" for k in range(62))
    rows = [(1, a), (1, b), (5, b + " more"), (0, a + " too"), (7, "quite another text of its own here"), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.n_shingles): r.component_id for r in minhash.dedup(docs).collect()}
    assert got[5, 59] == 1 and got[0, 59] == 0
    kept = {(r.doc_id, r.text) for r in minhash.distinct_rows(docs).collect()}
    assert (7, "quite another text of its own here") in kept and (0, a + " too") in kept and len(kept) == 3


def test_densified_bins_collide_as_often_as_sets_are_alike():
    rng = np.random.default_rng(0)
    rates = []
    for _ in range(300):
        a = rng.integers(0, 2**63, 20, dtype=np.uint64)
        b = a.copy()
        b[:4] = rng.integers(0, 2**63, 4, dtype=np.uint64)
        x, y = minhash.signatures([np.unique(a), np.unique(b)])
        rates.append((x == y).mean())
    assert abs(np.mean(rates) - 16 / 24) < 0.03


def test_words_across_windows(monkeypatch):
    import pyarrow as pa

    rows = ["alpha beta gamma delta", "", "x" * 200 + " y", "ä ö ü ß", None, "tail"]
    want = [set(s.tolist()) for s in texts.shingle_sets(pa.array(rows), 2)]
    monkeypatch.setattr(texts, "WINDOW", 8)
    assert [set(s.tolist()) for s in texts.shingle_sets(pa.array(rows), 2)] == want
    assert [len(s) for s in want] == [3, 0, 1, 2, 0, 1]


def vectors(spark, seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for size in (60, 5, 3, 1, 1, 1):
            centre = rng.normal(size=32)
            for _ in range(size):
                v = centre + rng.normal(size=32) * rng.choice([0.0, 0.2, 0.35])
                rows.append((k, [float(x) for x in v], label))
                k += 1
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    rows += [(k + j, v, 0) for j, v in enumerate(odd)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("chunk", [4096, 20])
def test_vectors_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embed_dedup, "CHUNK", chunk)
    rows, frame = vectors(spark, chunk)
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if fine(v) and label is not None}
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a in unit for b in unit if b < a and label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    count = np.bincount([x for pair in links for x in pair], minlength=len(rows))
    want = groups_of(len(rows), links)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.dedup(frame).collect()}
    assert got == {i: (int(count[i]), want[i], want[i] == i) for i in range(len(rows))}
    assert len(links) > 100


def test_vector_edge_cases(spark):
    frame = spark.createDataFrame(
        [(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], None, "x")],
        "vec_id long, embedding array<double>, label int, id string")
    got = sorted(map(tuple, embed_dedup.dedup(frame).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False), (2, 0, 2, True)], key=str)
    assert embed_dedup.dedup(frame.limit(0)).count() == 0
    assert embed_dedup.dedup(frame.withColumn("embedding", F.lit(None).cast("array<double>"))).where("n_links > 0").count() == 0


def test_long_vectors_are_planned_from_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SAMPLE_BYTES", 20 * 1024 * 8)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 1024))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, base[:9] + 0.01 * rng.normal(size=(9, 1024))]))]
    got = {r.id: r.component_id for r in embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: i if i < 60 else i - 60 for i in range(69)}
