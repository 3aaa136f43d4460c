"""Document statistics, quality models and language models."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import doc_stats, langid, pu_quality, quality_rules, texts, trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_of(text):
    w = WORD.findall(text or "")
    windows = list(zip(w, w[1:], w[2:]))
    often = Counter(windows)
    repeated = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab#|é  \x1c \n\t\r\x0b𝄞A.", max_size=60)), min_size=1, max_size=6),
       st.sampled_from([7, 64, 1 << 20]))
def test_counts_equal_plain_counting(rows, window):
    kept, texts.WINDOW = texts.WINDOW, window
    try:
        counts, features = doc_stats.statistics(pa.array(rows, pa.string()))
    finally:
        texts.WINDOW = kept
    assert counts.tolist() == [counts_of(t) for t in rows]
    assert np.isfinite(features).all()


def test_trees_fit_and_keep_their_signs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] - 2 * np.abs(x[:, 1]) + 0.3 * rng.normal(size=3000) > -1).astype(float)
    forest = trees.fit(x, y, np.array([1, 0, -1, 0]))
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.93
    for column, sign in ((0, 1), (2, -1)):
        ramp = np.repeat(x[:200], 30, axis=0)
        ramp[:, column] = np.tile(np.linspace(-4, 4, 30), 200)
        steps = np.diff(forest.margin(ramp).reshape(200, 30), axis=1)
        assert (sign * steps >= -1e-12).all()
    free = trees.fit(x, y, np.zeros(4, dtype=int))
    ramp = np.repeat(x[:200], 30, axis=0)
    ramp[:, 1] = np.tile(np.linspace(-4, 4, 30), 200)
    assert (np.diff(free.margin(ramp).reshape(200, 30), axis=1) < 0).any()


def quality_tables(spark, n=600):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{k}" for k in rng.integers(0, 3000, 80)]
        good = rng.random() < 0.7
        rows.append((i, " ".join(w) if good else "### ".join(w), "src", "x", 1.5))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    rows += [(n, None, "src", "x", 1.0), (n + 1, "", None, "x", 1.0), (None, " ".join(w), "s", "x", None), (n + 2, "again and " * 60, "s", "x", 0.0)]
    labels += [(0, 1), (0, 0), (None, 1), (3, None), (5, labels[4][1])]
    return (spark.createDataFrame(rows, "doc_id long, text string, source string, score string, kept double"),
            spark.createDataFrame(labels, "doc_id long, quality int"), n)


def test_rules_on_a_small_table(spark):
    docs, labels, n = quality_tables(spark)
    got = {r["_row"]["doc_id"]: r for r in quality_rules.judge(docs, labels, docs.columns).collect()}
    texts_of = {r.doc_id: r.text for r in docs.collect()}
    for i, r in got.items():
        c = counts_of(texts_of[i])
        assert [r[k] for k in doc_stats.COUNTS] == c
        assert r["base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
    bad = [i for i, t in texts_of.items() if t and "###" in t]
    assert not any(got[i]["kept"] for i in bad)
    assert all(got[i]["kept"] for i, t in texts_of.items() if i is not None and i < n and "#" not in t)
    assert [got[n + k]["base_failed"] for k in range(3)] == [True] * 3
    assert got[4]["_row"]["score"] == "x"
    alone = quality_rules.judge(docs, labels.where("quality = 1"), ["doc_id"])
    assert alone.where("score != 1 or kept = base_failed").count() == 0
    assert quality_rules.judge(docs.limit(0), labels, docs.columns).count() == 0


def test_rules_learn_from_all_labels_in_tasks_as_on_the_driver(spark):
    docs, labels, _ = quality_tables(spark)
    here, least = quality_rules.fit(docs, labels)
    there, other = quality_rules.fit(docs.repartition(3), labels, most=0)
    assert (here.feature == there.feature).all() and (here.threshold == there.threshold).all()
    assert np.allclose(here.value, there.value) and abs(least - other) < 1e-9
    known = doc_stats.trusted(labels)
    rows = doc_stats.features_of(docs, known).toPandas()
    x, y = np.stack(rows["x"].to_list()), (rows["y"] > 0).to_numpy()
    plain = trees.fit(x, y.astype(float), np.array([quality_rules.SIGNS.get(f, 0) for f in doc_stats.FEATURES]))
    assert (here.feature == plain.feature).all() and np.allclose(here.threshold, plain.threshold)
    assert abs(least - min(0.5, np.quantile(plain.probability(x)[y], quality_rules.MAX_LOSS))) < 1e-9
    assert doc_stats.features_of(docs, known).count() == docs.join(known, docs.doc_id == known.id).select("id").distinct().count()


def test_positives_and_unlabelled_text_suffice(spark):
    from pyspark.sql import functions as F

    docs, labels, n = quality_tables(spark, 900)
    score = lambda x: {r["_row"]["doc_id"]: r.score for r in pu_quality.score(docs, x, docs.columns).collect()}
    got = score(labels)
    texts_of = {r.doc_id: r.text for r in docs.collect()}
    good = [got[i] for i, t in texts_of.items() if i is not None and i < n and "#" not in t]
    bad = [got[i] for i, t in texts_of.items() if t and "#" in t]
    assert np.mean(np.array(good)[:, None] > np.array(bad)) > 0.99
    assert np.mean(np.array(good) >= 0.5) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == docs.count()
    # held-out labels are not learned from: turning them over changes nothing
    turned = labels.withColumn("quality", F.when(texts.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert score(turned) == got
    none = pu_quality.score(docs, labels.limit(0), ["doc_id"])
    assert none.where("score != 0.5 or predicted != 1").count() == 0
    assert pu_quality.score(docs.limit(0), labels, docs.columns).count() == 0


def test_prior_and_risk_on_arrays():
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.7):
        positive = rng.normal(1.5, 1, (3000, 3))
        hidden = rng.random(4000) < prior
        unlabelled = np.where(hidden[:, None], rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3)))
        model, found = pu_quality.fit_arrays(positive, unlabelled)
        assert abs(found - prior) < 0.1
        assert ((model.score(unlabelled) >= 0.5) == hidden).mean() > 0.95
    assert pu_quality.fit_arrays(positive[:1], unlabelled) is None


def test_kneser_ney_sums_to_one_and_equals_the_formula():
    text = " the cat sat on the mat the cat ate"
    packed, _ = next(langid.grams(*texts.buffers(pa.array([text]))))
    keys, counts = np.unique(packed, return_counts=True)
    orders = langid.kneser_ney(keys, counts)
    alphabet = np.unique(keys & np.uint64(0xFFFF))
    model = langid.Model(["x"], [orders], 1 / len(alphabet))
    for head in ("the", "cat", "zzz", " th"):
        context = sum(np.uint64(ord(c)) << np.uint64(16 * (3 - k)) for k, c in enumerate(head))
        p = np.exp(-model.surprise(context | alphabet)[0])
        assert abs(p.sum() - 1) < 1e-5 and (p > 0).all()
    # the highest order by hand: "the" is followed by a space three times
    c = Counter(zip(text, text[1:], text[2:], text[3:]))
    ones, twos = (sum(1 for v in Counter(dict(zip(keys.tolist(), counts.tolist()))).values() if v == n) for n in (1, 2))
    discount = ones / (ones + 2 * twos)
    key = sum(np.uint64(ord(ch)) << np.uint64(16 * (3 - k)) for k, ch in enumerate("the "))
    share = langid._found(orders[-1].grams, orders[-1].shares, np.array([key], np.uint64), 4, 0.0)[0]
    assert abs(share - (c["t", "h", "e", " "] - discount) / c["t", "h", "e", " "]) < 1e-6


def test_grams_do_not_depend_on_windows(monkeypatch):
    rows = ["Ab, cd! éè", "", "x" * 50 + " y " * 30, None, "123", "İstanbul 𐐀𐐨"]
    want = [tuple(map(tuple, g)) for g in langid.grams(*texts.buffers(pa.array(rows)))]
    flat = lambda found: sorted((int(r), int(p)) for g in found for p, r in zip(*g))
    monkeypatch.setattr(langid, "FLUSH", 10)
    assert flat(langid.grams(*texts.buffers(pa.array(rows)))) == flat(want)


@pytest.fixture(scope="module")
def letters(spark):
    rng = np.random.default_rng(2)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "éfghi "}
    rows = []
    for i in range(400):
        lang = list(alphabets)[i % 3]
        rows.append((i, "".join(rng.choice(list(alphabets[lang]), 120)), lang, "clash"))
    rows += [(900, None, "aa", "c"), (901, "", "aa", "c"), (902, "123 !?", "bb", "c"), (None, "abcab deab", "aa", "c"), (903, "abc abd", None, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id string")


def test_languages_of_held_out_texts(spark, letters):
    model = langid.fit(letters)
    assert model.langs == ["aa", "bb", "cc"]
    got = langid.predict(letters, model, ["doc_id", "lang", "text"]).withColumn("out", texts.held_out("doc_id")).toPandas()
    long_out = got[got.out & (got.doc_id < 400)]
    assert len(long_out) > 80 and (long_out.lang == long_out.lang_pred).mean() > 0.98
    odd = got[got.doc_id.isin([900, 901, 902])]
    assert (odd.lang_pred == "und").all() and (odd.score == 0).all() and not odd.rejected.any()
    assert got.score.between(0, 1).all() and len(got) == letters.count()
    strange = letters.limit(1).selectExpr("1L as doc_id", "'zzzz yyyy qqqq wwww' as text")
    row = langid.predict(strange, model, ["doc_id"]).first()
    assert row.rejected and row.lang_pred in model.langs


def test_temperature_and_limits_come_from_all_documents(spark, letters):
    model = langid.fit(letters)
    known = langid._learnable(letters, "text", "lang", "doc_id")
    rows = langid._entropies(known, model, ["lang"], "text").where("letters").select("_row.lang", "h").collect()
    entropy, lang = np.array([r.h for r in rows]), np.array([r.lang for r in rows])
    truth = np.searchsorted(model.langs, lang)
    for k, x in enumerate(model.langs):
        assert abs(model.limits[k] - np.quantile(entropy[lang == x, k], 1 - langid.MAX_REJECTED)) < 1e-9
    loss = [-np.log(np.maximum(langid.probabilities(entropy, t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in langid.TEMPERATURES]
    assert model.temperature == langid.TEMPERATURES[int(np.argmin(loss))]
    got = langid.identify(letters, ["doc_id", "lang"]).collect()
    want = langid.predict(letters, model, ["doc_id", "lang"]).collect()
    assert sorted(got, key=str) == sorted(want, key=str)
    assert not hasattr(langid, "MAX_SAMPLE")


def test_nothing_to_learn_from(spark, letters):
    assert langid.fit(letters.where("lang is null")) is None
    assert langid.predict(letters, None, ["doc_id"]).where("lang_pred != 'und' or score != 0").count() == 0
    assert langid.predict(letters.limit(0), langid.fit(letters), ["doc_id"]).count() == 0


def test_frequent_grams_keep_to_the_bound(spark):
    rows = [("a", g, 1 + g % 50) for g in range(3000)] + [("b", g, 100 + g) for g in range(100)]
    counts = spark.createDataFrame(rows, "lang string, gram long, n long")
    kept = {r["lang"]: (r["count"], r["low"]) for r in langid.frequent(counts, 800).groupBy("lang").agg({"*": "count", "n": "min"}).withColumnRenamed(
        "count(1)", "count").withColumnRenamed("min(n)", "low").collect()}
    assert kept["b"] == (100, 100) and 300 < kept["a"][0] <= 400 and kept["a"][1] > 40


@pytest.mark.parametrize("head", [0, 60, 1 << 22])
def test_model_is_of_all_grams_whatever_is_broadcast(spark, letters, monkeypatch, head):
    monkeypatch.setattr(langid, "HEAD", head)
    monkeypatch.setattr(langid, "MAX_GRAMS", 40)
    known = langid._learnable(letters, "text", "lang", "doc_id").toPandas()
    plain, last = [], set()
    for lang in ("aa", "bb", "cc"):
        found = langid.grams(*texts.buffers(pa.array(known.text[known.lang == lang], pa.string())))
        keys, counts = np.unique(np.concatenate([g for g, _ in found]), return_counts=True)
        plain.append(langid.kneser_ney(keys, counts))
        last |= set((keys & np.uint64(0xFFFF)).tolist())
    model = langid.Model(["aa", "bb", "cc"], plain, 1 / (len(last) + 1))
    fitted = langid.fit(letters)
    assert len(fitted.head[0]) <= head and (head < 1 << 22 or len(fitted.head[0]) > 100)
    odd = letters.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(i, "zzzz abcy qabc " * 3 + "é" * i) for i in range(3)], "doc_id long, text string"))
    got = langid._entropies(odd, fitted, ["text"], "text").select("_row.text", "h", "letters").toPandas()
    want, found = model.entropies(pa.array(got.text, pa.string()))
    assert len(got) == odd.count() and (got.letters == found).all()
    assert np.allclose(np.array(got.h.tolist())[found], want[found], atol=1e-6)


def test_an_id_is_learned_from_once_however_often_it_repeats(spark):
    docs = [(0, "good words in a line " * 9)] * 10_000 + [(i, f"text {i} " * 20) for i in range(1, 40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    known = doc_stats.trusted(labels)
    x, y = doc_stats.sample_features(frame, doc_stats.smallest(known, 30, 3))
    assert len(x) == len(y) == min(30, known.count())


def test_samples_are_the_smallest_hashes_with_and_without_the_threshold(spark):
    ids = spark.range(20_000).repartition(9)
    every = ids.select("id", F.xxhash64(F.lit(5), "id").alias("h")).orderBy("h").limit(300)
    got = sorted(r["id"] for r in doc_stats.smallest(ids, 300, 5).collect())
    assert got == sorted(r["id"] for r in every.collect())
    assert doc_stats.likely(ids, 300, F.xxhash64(F.lit(5), "id")).count() < 450
    assert doc_stats.smallest(ids.limit(0), 300, 5).count() == 0


def walked(forest, line):
    """The margin of one row, node by node."""
    total, inner = forest.start, len(forest.feature[0])
    for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
        node = 0
        while node < inner:
            node = 2 * node + (2 if line[feature[node]] > threshold[node] else 1)
        total += value[node - inner]
    return total


def test_rules_equal_a_plain_walk_over_the_trees(spark, sf):
    """``kept`` of every document of the table, from its own statistics and one tree node after another."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest, least = quality_rules.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    counts, features = doc_stats.statistics(pa.array([r.text for r in rows], pa.string()))
    want = {}
    for r, c, f in zip(rows, counts.tolist(), features):
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        margin = walked(forest, f) if forest else 40.0
        score = 1 / (1 + np.exp(-min(40.0, max(-40.0, margin))))
        want[r.doc_id] = (failed, not failed and score >= least, tuple(counts_of(r.text)))
    got = quality_rules.judge(docs, labels, ["doc_id"]).select("_row.doc_id", "base_failed", "kept", *doc_stats.COUNTS).collect()
    assert {g[0]: (g[1], g[2], tuple(g[3:])) for g in got} == want


def test_scores_equal_a_plain_sum_of_weights(spark, sf):
    """Every document's score, from its own statistics and one feature after another."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = pu_quality.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    _, features = doc_stats.statistics(pa.array([r.text for r in rows], pa.string()))
    want = {}
    for r, line in zip(rows, features):
        total, at = found[0].bias if found else 0.0, 0
        for edges, x in zip(found[0].edges if found else [], line):
            total += found[0].weights[at + sum(e < x for e in edges)]
            at += len(edges) + 1
        want[r.doc_id] = 1 / (1 + np.exp(-min(40.0, max(-40.0, total))))
    got = pu_quality.score(docs, labels, ["doc_id"]).select("_row.doc_id", "score", "predicted").collect()
    assert len(got) == len(want)
    for g in got:
        assert g[1] == pytest.approx(want[g[0]], abs=1e-9) and g[2] == (g[1] >= 0.5)
