"""The manifest against a tree built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, arity):
    """(top, [proof entries (before, after) of every leaf])."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            lo = i // arity * arity
            run = nodes[lo: lo + arity]
            paths[leaf].append(("".join(run[: i - lo]), "".join(run[i - lo + 1:])))
        at = [i // arity for i in at]
        nodes = [h(*nodes[i: i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain(rows, arity):
    """{(source, doc_id, leaf): [(subroot, root, proof text)]}."""
    groups = {}
    for doc_id, source, leaf in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id))
    tops, inner = {}, {}
    for source, members in groups.items():
        members.sort(key=lambda m: m[:3])
        tops[source], inner[source] = climb([m[2] for m in members], arity)
    names = sorted(tops, key=lambda s: (s is not None, (s or "").encode()))
    root, outer = climb([tops[s] for s in names], arity)
    found = []
    for k, source in enumerate(names):
        for m, path in zip(groups[source], inner[source]):
            found.append((m[3], m[2], tops[source], root, "".join(a + b for a, b in path + outer[k])))
    return sorted(found, key=str)


def rows_of(n, hot):
    out = [(i, "hot", h(str(i))) for i in range(hot)]
    out += [(i, f"s{i % 7}é" if i % 11 else None, h("x", str(i))) for i in range(n)]
    return out + [(3, "hot", h("again")), (3, "hot", h("again")), (None, "hot", h("none")), (1, "lone", h("lone")), (2, "", h("empty"))]


@pytest.mark.parametrize("arity,n,hot", [(16, 90, 300), (2, 25, 40), (3, 9, 30), (16, 0, 0)])
def test_every_row_equals_the_plain_tree(spark, arity, n, hot):
    rows = rows_of(n, hot)
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(5)
    found = merkle.manifest(df, ["doc_id", "leaf"], "source", "doc_id", "leaf", arity).select(
        "row.doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("p"),
        merkle.folded(F.col("leaf"), F.col("path")).alias("folded"))
    got = [tuple(r) for r in found.collect()]
    assert all(r[5] == r[3] for r in got)
    assert sorted([r[:5] for r in got], key=str) == plain(rows, arity)


def test_a_changed_leaf_no_longer_leads_to_the_root(spark):
    rows = [(i, f"s{i % 3}", h(str(i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    found = merkle.manifest(df, ["doc_id"], "source", "doc_id", "leaf")
    wrong = merkle.folded(F.sha2(F.concat("leaf", F.lit("!")).cast("binary"), 256), F.col("path"))
    assert found.where(wrong == F.col("root")).count() == 0


def test_one_row_no_row_and_clashing_names(spark):
    schema = "doc_id long, source string, leaf string, idx string, digest string, grp string, n string, run string, path string"
    one = spark.createDataFrame([(7, None, h("a"), *["x"] * 6)], schema)
    keep = ["doc_id", "idx", "digest", "grp", "n", "run", "path"]
    row = merkle.manifest(one, keep, "source", "doc_id", "leaf").first()
    assert (row["leaf"], row["subroot"], row["root"], row["path"]) == (h("a"), h("a"), h("a"), [])
    assert row["row"]["grp"] == "x"
    assert merkle.manifest(one.limit(0), keep, "source", "doc_id", "leaf").count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(one, keep, "source", "doc_id", "leaf", arity=1)


def test_codes_tell_null_empty_and_number_apart(spark):
    df = spark.createDataFrame([(None,), ("",), ("é",)], "v string").select(merkle.coded(F.col("v")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["-", "0:", "2:é"]


def test_siblings_are_exclusive_or_in_binary_trees(spark):
    df = spark.range(8).select("id", merkle.siblings(F.col("id"), 2).alias("two"), merkle.siblings(F.col("id"), 4).alias("four"))
    for r in df.collect():
        assert r["two"] == [r["id"] ^ 1]
        assert sorted(r["four"]) == [i for i in range(r["id"] // 4 * 4, r["id"] // 4 * 4 + 4) if i != r["id"]]
