"""Shards and batches on small tables, with brute force."""

import itertools

import numpy as np
import pytest

from panelspark.llm import packing, shards

SCHEMA = "doc_id long, text string, slot_ string"


def rows_of(spark, docs, **options):
    path = shards.write_shards(docs, **options)
    return shards.read_shards(docs, path).toPandas()


@pytest.fixture(scope="module")
def mixed(spark):
    """Null and repeated ids and texts, empty texts, one long text."""
    rows = [(i, f"text {i}", "x") for i in range(300)]
    rows += [(None, f"no id {i}", "y") for i in range(100)] + [(7, "same", "z")] * 60
    rows += [(1000, None, "n"), (1001, "", "e"), (1002, "long " * 5000, "l")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "text")


def test_slots_are_gapless_and_no_row_is_lost(spark, mixed):
    found = rows_of(spark, mixed, n_shards=4, bucket_bytes=500)
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    key = lambda t: tuple(map(str, t))
    got = sorted((key(t) for t in found[["doc_id", "text", "slot_"]].astype(object).where(found.notna(), None).itertuples(index=False)))
    assert len(got) == mixed.count()
    assert sorted(x[1] for x in got) == sorted(str(r.text) for r in mixed.collect())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    from pyspark.sql import functions as F

    ids = spark.range(5000).select(
        shards.shard_of(F.col("id"), 16, 17).alias("a"), shards.shard_of(F.col("id"), 17, 17).alias("b")).toPandas()
    moved = ids[ids.a != ids.b]
    assert set(moved.b) == {16} and 150 < len(moved) < 450
    assert ids.groupby("a").size().between(230, 400).all()


def test_a_hot_key_is_cut_into_buckets_that_fit(spark):
    docs = spark.createDataFrame([(None, "x" * 50)] * 2000, "doc_id long, text string")
    path = shards.write_shards(docs, n_shards=4, bucket_bytes=5000)
    sizes = spark.read.parquet(path).groupBy("shard", "bucket").count().toPandas()
    assert sizes["shard"].nunique() == 1 and len(sizes) >= 20 and sizes["count"].max() * 51 < 2 * 5000


def test_same_seed_same_order_other_seed_other_order(spark):
    docs = spark.range(0, 400, 1, 3).selectExpr("id as doc_id", "cast(id as string) as text")
    order = lambda seed: list(rows_of(spark, docs, n_shards=2, seed=seed).sort_values(["shard", "slot"])["doc_id"])
    assert order(1) == order(1) != order(2)
    places = rows_of(spark, docs, n_shards=1, seed=5).sort_values("slot")["doc_id"].to_numpy()
    assert abs(np.corrcoef(places, np.arange(len(places)))[0, 1]) < 0.2


def test_empty_table_and_clashing_names(spark, mixed):
    assert len(rows_of(spark, mixed.limit(0), n_shards=3)) == 0
    with pytest.raises(ValueError, match="shard"):
        shards.write_shards(mixed.withColumnRenamed("slot_", "Shard"))


def padding(ends, longest, counts):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(longest, counts))


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_have_the_least_padding(seed):
    rng = np.random.default_rng(seed)
    longest = np.sort(rng.choice(60, 9, replace=False))
    counts = rng.integers(1, 50, 9)
    for buckets in (1, 2, 3, 4):
        found = packing.best_boundaries(longest, counts, buckets)
        best = min(padding((*c, longest[-1]), longest, counts) for c in itertools.combinations(longest[:-1], buckets - 1))
        assert len(found) <= buckets and padding(found, longest, counts) == best
    assert packing.best_boundaries(longest, counts, 20) == sorted(longest)


def test_many_lengths_equal_the_plain_programme():
    """Against the programme that tries every boundary for every length."""
    rng = np.random.default_rng(2)
    longest = np.sort(rng.choice(5000, 700, replace=False)).astype(np.int64)
    counts = rng.integers(1, 30, 700)
    before = np.concatenate([[0], np.cumsum(counts)])
    cost = longest * before[1:]
    for _ in range(6):
        fresh, pick = packing._layer(cost, longest, before)
        for j in range(1, 700):
            through = cost[:j] + longest[j] * (before[j + 1] - before[1: j + 1])
            assert fresh[j] == through.min() and pick[j] == through.argmin()
        cost = fresh


def test_a_mass_of_equal_rows_is_dealt_out(spark):
    docs = spark.createDataFrame([(5, "same words")] * 3000 + [(i, "w " * i) for i in range(1, 40)], "doc_id long, text string")
    found = packing.pack(docs, buckets=3, budget=100).toPandas()
    assert len(found) == 3039 and not found.duplicated(["bucket", "batch", "place"]).any()
    for _, part in found.groupby("bucket"):
        assert sorted(part.groupby("batch").size())[1:] == [max(1, 100 // part.padded_to.iloc[0])] * (part.batch.nunique() - 1)


def test_batches_hold_the_budget_and_every_row(spark):
    rng = np.random.default_rng(1)
    rows = [(i if i % 7 else None, " ".join(["w"] * int(n)), 1) for i, n in enumerate(rng.geometric(0.02, 900))]
    rows += [(5000, None, 1), (5001, " \n", 1), (5002, "w " * 3000, 1)] + [(9, "same words here", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int")
    found = packing.pack(docs, buckets=5, budget=1000).toPandas()
    assert len(found) == len(rows) and (found.n_tokens <= found.padded_to).all()
    assert sorted(found.n_tokens) == sorted(len((t or "").split()) for _, t, _ in rows)
    for (_, padded), part in found.groupby(["bucket", "padded_to"]):
        sizes = part.groupby("batch").size()
        most = max(1, 1000 // max(padded, 1))
        assert list(sizes.index) == list(range(len(sizes))) and (sizes.iloc[:-1] == most).all() and sizes.iloc[-1] <= most
        assert all(sorted(g.place) == list(range(len(g))) for _, g in part.groupby("batch"))
    assert packing.pack(docs.limit(0)).count() == 0
