"""Url rules, revisits, mixing and the pipeline on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import minhash, mixing, packing, pu_quality, quality_rules, queries, url_filter, warc


def judged(spark, pages, **options):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame, ["page_id"], **options).collect()}


def test_hosts_paths_and_rules(spark):
    got = judged(spark, [
        (1, "HTTP://A.Example.ORG/es/x?q#f", None), (2, "http://example.org", None), (3, "http://notexample.org/en/1", None),
        (4, "http://example.org/en/1a", None), (5, "x://shop.com/de/1", None), (6, "x://shop.com/fr/1", ""), (7, None, None),
        (8, "no scheme", None), (9, "a://b://c/d", None), (10, "http://É.com?x", None), (11, "://h.com/DE/", None), (12, "http://", None)])
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "", None, "allow"),
        3: ("notexample.org", "/en/1", "org/", "allow"), 4: ("example.org", "/en/1a", "example.org/en/1", "block"),
        5: ("shop.com", "/de/1", "com/de/", "block"), 6: ("shop.com", "/fr/1", "com/fr/", "allow"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("b:", "//c/d", None, "allow"),
        10: ("É.com", "", None, "allow"), 11: ("h.com", "/DE/", None, "allow"), 12: ("", "", None, "allow")}


def test_blocks_reach_aliases_and_allow_comes_first(spark):
    canonical = lambda url: f"<LINK href='{url}' rel=\"canonical\">"
    got = judged(spark, [
        (1, "http://a.net/x", canonical("https://b.com/de/1")),  # alias of a blocked url
        (2, "http://www.a.net/x.html?utm_source=q", None), (3, "http://m.a.net/x/#top", None),  # redirect to 1
        (4, "http://c.net/", '<meta http-equiv="refresh" content="0; url=http://a.net/x">'),
        (5, "http://d.net/1", canonical("/2")), (6, "http://d.net/2", canonical("http://e.com/fr/1")),  # allowed chain
        (7, "http://e.com/fr/1", canonical("http://b.com/de/2")), (8, "http://b.com/de/2", None),
        (9, "http://f.net/", None), (10, "http://b.com/de/1", None)],
        redirects=spark.createDataFrame([("http://g.net/", "http://b.com/de/1"), ("http://f.net/", "http://g.net/"), (None, "x")], "a string, b string"))
    assert {k: v[3] for k, v in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "block"}


LINKS = ["http://B.com/de/1", "https://b.com", "//b.com/de/1?x=1", "//b.com", "/r?u=http://b.com/de/9", "/a/../b/./c", "/../..", "p2.html",
         "./p2", "../up?q=/../z", "..", "?page=2", "?u=http://c.com/", "a/b/", "#top", "mailto:x@b.com", "a//b", "/.well/x..y", "/a/b/..",
         "x.html?u=//q", "/e?a=1&amp;b=2", "...", "a/.../b/.", "HTTP://b.com/De/../x"]
BASES = ["http://A.net/dir/page.html?s=1#f", "https://a.net", "http://a.net/", "x://a.net/one", "http://a.net?q=/x/y"]


def test_links_mean_what_they_mean_to_a_browser(spark):
    from urllib.parse import urljoin, urlsplit

    def key(base, link):
        link = link.replace("&amp;", "&")
        if link.startswith("#") or link.startswith("mailto:"):
            return None
        web = base.replace("x://", "http://")  # the library joins links for known schemes only
        full = urlsplit(urljoin(web, link))
        path = full.path or ("/" if not link.startswith(("?", "//")) and "://" not in link else "")
        return full.netloc.lower() + path + (f"?{full.query}" if full.query else "")

    rows = [(f"{k}|{b}", base, f'<link rel="canonical" href="{link}">') for k, link in enumerate(LINKS) for b, base in enumerate(BASES)]
    rest = url_filter.after_scheme(F.col("url"))
    found = spark.createDataFrame(rows, "id string, url string, html string").select(
        "id", url_filter.named_in(F.col("html"), url_filter.CANONICAL, url_filter.HREF, rest).alias("key")).collect()
    for r in found:
        k, b = map(int, r["id"].split("|"))
        if LINKS[k] not in ("a//b", "HTTP://b.com/De/../x"):  # the library drops empty segments, and keeps dots after a host
            assert r["key"] == key(BASES[b], LINKS[k]), (BASES[b], LINKS[k])


def test_the_sql_of_the_rules_knows_links_too(spark):
    import duckdb

    from panelspark.llm import oracles

    rows = [(k * 10 + b, base, f'<link href="{link}" rel=canonical>') for k, link in enumerate(LINKS) for b, base in enumerate(BASES)]
    rows += [(900, "http://b.com/de/1", None), (901, "http://a.net/r?u=http://b.com/de/9", None), (902, None, ""), (903, "http://a.net/dir/p2.html", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in url_filter.judge(pages, ["page_id"]).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id bigint, url varchar, html varchar)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({oracles.url_filter_sql()})").fetchall())
    assert got == want


def test_blocks_follow_links_of_every_kind_and_no_others(spark):
    link = lambda to: f'<link rel="canonical" href="{to}">'
    got = judged(spark, [
        (1, "http://a.net/x", link("/r?u=http://b.com/de/9")), (2, "http://b.com/de/9", None),
        (3, "http://c.net/d/1", link("p2.html")), (4, "http://c.net/d/p2.html", link("//b.com/de/1")),
        (5, "http://e.net/d/1", link("?page=2")), (6, "http://e.net/d/1?page=2", link("../../b.com/de/1")),
        (7, "http://f.net/d/1", link("./../q")), (8, "http://f.net/q", link("https://b.com/x/../de/3"))])
    assert {k: v[3] for k, v in got.items()} == {
        1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "block"}


def test_url_edge_cases(spark):
    frame = spark.createDataFrame([(1, "http://a.net/", "h", "x")] * 3, "page_id long, url string, html string, _key string")
    assert url_filter.judge(frame, ["page_id", "_key"]).count() == 3
    assert url_filter.judge(frame.limit(0), ["page_id"]).count() == 0
    with pytest.raises(ValueError, match="host"):
        url_filter.judge(frame.withColumnRenamed("_key", "host"), ["host"])


def test_revisits_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        url = "http://hot.net/a" if rng.random() < 0.4 else f"https://www.h{rng.integers(30)}.net/{rng.integers(3)}/"
        kind = "response" if rng.random() < 0.4 else "revisit"
        tag = [None, '"1"', '"2"', 'W/"2"'][rng.integers(4)]
        head = {"ETag": tag, "Last-Modified": [None, "m1", "m2"][rng.integers(3)], "Date": str(i), "X-Own": kind}
        rows.append((f"r{i:04}", kind, url, int(rng.integers(400)), {k: v for k, v in head.items() if v}))
    rows += [("z1", "revisit", None, 5, {"etag": '"1"'}), ("z2", "revisit", "http://h1.net/1", None, None), ("z3", "other", "http://h1.net/1", 9, None)]
    schema = "record_id string, type string, url string, ts long, headers map<string,string>"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: r for r in warc.resolve(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    key = lambda u: u.split("://")[1].removeprefix("www.").removesuffix("/") if u else None
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    seen = set()
    for rid, kind, url, ts, head in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if url and ts is not None and r[1] == "response" and key(r[2]) == key(url) and r[3] < ts]
        found = max(before, key=lambda r: (r[3], r[0]), default=None)
        own = low(head)
        if found is None:
            want = "unresolved"
        else:
            old = low(found[4])
            if "etag" in own:
                same = own["etag"].removeprefix("W/") == old.get("etag", "").removeprefix("W/")
            else:
                same = own.get("last-modified") == old.get("last-modified")
            want = "no_validator" if not {"etag", "last-modified"} & set(own) else "resolved" if same else "validator_mismatch"
        r = got[rid]
        assert r.status == want
        seen.add(want)
        if want == "resolved":
            assert (r.response_id, r.response_ts) == (found[0], found[3])
            assert r.headers == old | {k: v for k, v in own.items() if k in warc.PERMITTED} and r.headers["x-own"] == "response"
        else:
            assert r.response_id is None and r.headers is None
    assert seen == {"unresolved", "no_validator", "resolved", "validator_mismatch"} and len(got) == sum(r[1] == "revisit" for r in rows)


def test_no_captures(spark, sf):
    pages = queries.table(spark, sf, "pages")
    assert warc.resolve(warc.captures_of(pages.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, "http://a.net/", "x")], "page_id long, url string, html string")
    assert {r.status for r in warc.resolve(warc.captures_of(odd)).collect()} == {"unresolved"}


def test_raked_margins_meet_their_targets():
    rng = np.random.default_rng(0)
    cells = [(a, b, c, int(rng.integers(1, 1000))) for a in "abc" for b in "xy" for c in "pqrs" if rng.random() < 0.9]
    goals = [{"a": 5, "b": 3, "c": 2}, {"x": 1, "y": 1, "absent": 9}, {"p": 1, "q": 2, "r": 3, "s": 4}]
    weight = mixing.rake(cells, goals, 0.02)
    assert weight.sum() == pytest.approx(0.02 * sum(c[-1] for c in cells))
    for k, goal in enumerate(goals):
        there = {c[k] for c in cells}
        total = sum(v for x, v in goal.items() if x in there)
        for name in there:
            share = weight[[i for i, c in enumerate(cells) if c[k] == name]].sum() / weight.sum()
            assert abs(share - goal[name] / total) < 1e-9


def test_sampled_tokens_follow_the_rates(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(n)), f"s{min(i % 10, 3)}", ["en", "de", None][i % 3], 0.5) for i, n in enumerate(rng.integers(20, 2000, 3000))]
    rows += [(9001, None, None, None, 0.0), (9002, "", "s1", "en", 0.0), (None, "a b", "rare", "xx", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate double")
    goals = {"source": {"s0": 0.25, "s1": 0.25, "s2": 0.2, "s3": 0.3}}
    got = mixing.mix(docs, goals, budget=0.3).select("doc_id", "text", "_mix.*").toPandas()
    assert len(got) == len(rows) and got.rate.between(0, 1).all()
    assert (got.n_tokens * got.rate).sum() == pytest.approx(0.3 * got.n_tokens.sum(), rel=0.01)
    large = got[got.source.isin(list(goals["source"]))]
    expected = (large.n_tokens * large.rate).groupby(large.source).sum()
    assert np.allclose(expected / expected.sum(), [goals["source"][s] for s in expected.index], atol=0.01)
    taken = large[large.taken].groupby("source").n_tokens.sum()
    assert np.allclose(taken / taken.sum(), expected / expected.sum(), atol=0.04)
    assert set(got[got.source.isin(["rare", "(none)"])].topic) == {"note"}
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def corpus(spark, sf):
    docs = queries.table(spark, sf, "documents")
    odd = spark.createDataFrame([(90001, None, None, None, 0), (90002, "", "en", "s", 0), (None, "x " * 80, "en", "s", 160)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(odd).cache()


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=str)


def test_stages_take_effect_and_keep_columns(spark, sf, corpus):
    labels = queries.table(spark, sf, "labels")
    plain = {
        "quality classifier": lambda d: ids(pu_quality.score(d, labels, ["doc_id"]).where("predicted = 1").select("_row.doc_id")),
        "quality rules": lambda d: ids(quality_rules.judge(d, labels, ["doc_id"]).where("kept").select("_row.doc_id")),
        "near duplicates": near_copies_kept,
        "mixing": lambda d: ids(mixing.mix(d).where("_mix.draw < _mix.rate")),
        "packing": ids,
    }
    docs = corpus
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        assert ids(out) == plain[name](docs), name
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    assert docs.columns == packing.pack(corpus.limit(0)).columns


def near_copies_kept(docs):
    """The smallest id of each group by comparing all pairs."""
    texts_of = {r.doc_id: set(zip(*((w := (r.text or "").encode().lower().split())[k:] for k in range(5)))) or {tuple(w)} - {()}
                for r in docs.collect() if r.doc_id is not None}
    order = sorted(texts_of)
    root = {i: i for i in order}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(order):
        for b in order[:n]:
            x, y = texts_of[a], texts_of[b]
            if x and y and 0.8 * len(x | y) <= len(x & y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return sorted([i for i in order if top(i) == i] + [None] * docs.where("doc_id is null").count(), key=str)


def test_stages_on_empty_tables(spark, sf, corpus):
    empty = corpus.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_stages_with_clashing_columns(spark, sf, corpus):
    clashing = corpus.limit(60)
    for name in ("id", "kept", "score", "n_words", "rate", "_row", "component_id", "batch"):
        clashing = clashing.withColumn(name, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, sf)
        assert out.columns == clashing.columns and out.where("id != 'own' or _row != 'own'").count() == 0, name


def test_small_sizes_of_minhash_parameters():
    assert minhash.BINS == minhash.ROWS * minhash.BANDS and (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-6


@pytest.mark.parametrize("most", [0, 100_000])
def test_rare_values_have_targets_of_their_own(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "CELLS", most)
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", lang, topic, int(rng.integers(80, 100)))
            for i in range(300) for lang in ("en", "de", "xx") for topic in ("note", "essay")]
    frame = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    table = mixing.rates(frame, budget=0.3)
    got = frame.join(table, list(mixing.MARGINS)).toPandas()
    assert len(got) == len(rows) and got.source.nunique() == 300 and got.rate.max() <= 1
    for m in mixing.MARGINS:
        own = got.groupby(m).n_tokens.sum() ** mixing.TEMPER
        taken = (got.n_tokens * got.rate).groupby(got[m]).sum()
        assert np.allclose(taken / taken.sum(), own / own.sum(), rtol=1e-8), m


def plain_levels(tokens, share, budget):
    """Pours the budget out a little at a time."""
    given, left = [0.0] * len(tokens), budget
    while left > 1e-9 * budget:
        open_ = [i for i, t in enumerate(tokens) if given[i] < t * (1 - 1e-12) and share[i] > 0]
        if not open_:
            break
        pour = min(left / sum(share[i] for i in open_), min((tokens[i] - given[i]) / share[i] for i in open_))
        for i in open_:
            given[i] += pour * share[i]
            left -= pour * share[i]
    return given


@pytest.mark.parametrize("seed", range(5))
def test_budgets_are_dealt_as_by_pouring(seed):
    rng = np.random.default_rng(seed)
    tokens, share = rng.integers(1, 1000, 12).astype(float), rng.random(12) * (rng.random(12) < 0.8)
    for part in (0.05, 0.5, 0.95):
        want = plain_levels(tokens, share, part * tokens.sum())
        assert np.allclose(mixing.dealt(tokens, share, part * tokens.sum()), want, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("most", [0, 100_000])
def test_one_rare_cell_takes_no_more_than_its_tokens(spark, monkeypatch, most):
    """240 equal cells and one tiny one in a source and language of its own: the budget is still kept."""
    monkeypatch.setattr(mixing, "CELLS", most)
    rows = [(f"s{i}", lang, topic, 10**9) for i in range(20) for lang in ("en", "de", "fr") for topic in ("a", "b", "c", "d")]
    rows.append(("rare", "xx", "a", 50))
    frame = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    got = frame.join(mixing.rates(frame, budget=0.6), list(mixing.MARGINS)).toPandas()
    taken = got.n_tokens * got.rate
    assert taken.sum() == pytest.approx(0.6 * got.n_tokens.sum(), rel=1e-6)
    assert got[got.source == "rare"].rate.iloc[0] == pytest.approx(1) and got.rate.max() <= 1
    assert taken.groupby(got.source).sum().drop("rare").std() < 1e-3 * 1e9


def test_given_topics_and_refused_names(spark):
    rows = [(i, "a b c", "s", "en", f"t{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string")
    got = mixing.mix(docs, {"topic": {"t0": 3, "t1": 1}}, budget=0.4, topic="subject").select("_mix.*").toPandas()
    assert got.groupby("topic").rate.first().tolist() == pytest.approx([0.6, 0.2])
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("_mix", F.lit(1)))


def test_rules_stage_rejects_by_the_trees(spark, sf):
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    judged = quality_rules.judge(docs, labels, ["doc_id"]).select("_row.*", "base_failed", "kept").toPandas()
    alone = judged[~judged.base_failed & ~judged.kept].doc_id
    assert len(alone)
    bad = labels.where("quality = 0").select("doc_id")
    good_and_new = docs.join(bad, "doc_id", "left_anti").unionByName(docs.where(F.col("doc_id").isin(alone.tolist()))).distinct()
    kept = ids(corpus_pipeline.rules(spark, good_and_new, sf))
    assert kept and not set(kept) & set(alone)
