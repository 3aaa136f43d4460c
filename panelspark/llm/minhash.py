"""Near-duplicate texts by one-permutation MinHash, star-shaped candidates and exact checks.

1. Every text becomes its set of word shingles. Texts with equal sets form one class, told by
   two 64-bit sums over the set; only classes go on, each under a number of its own and with the key
   of one text: the smallest id and a hash of the text, as an id may come with several texts.
2. One permutation is cut into ``BANDS * ROWS`` bins. The smallest hash of a bin is its value;
   empty bins borrow from bins drawn by hashing (bin, attempt) until one is not empty, which
   keeps collisions of bins independent (optimal densification). Bands of ROWS values are buckets.
3. In every bucket each member is tied to the smallest id: a star, so candidates are as many as
   members. Pairs whose sizes rule the similarity out are left out; the rest is checked on whole
   sets, read from the texts again.
4. A star can miss links between two members that its centre is not linked with. So buckets whose
   members are still in several components are searched in blocks: members outside the bucket's
   largest component against all members, in chunks of bounded size. Again only spanning pairs
   leave a task. With this no pair that shares a bucket is lost.

A pair at the threshold shares no bucket with probability (1 - s ** ROWS) ** BANDS: 3e-10 at
0.85, 2e-7 at 0.8.

Edge cases, all defined: a text that is null or without words has an empty set and links with
nothing; a text shorter than a shingle is one shingle; rows that repeat an id each have a result
by their own text, and ``distinct_rows`` keeps one row of a group whatever ids repeat; rows without an id link
with nothing and are kept; an empty table gives an empty result. Ids are integers. Other columns of the
input play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import texts
from panelspark.llm.components import Forest, components
from panelspark.session import bounded, written

ROWS, BANDS = 4, 30
BINS = ROWS * BANDS
#: Bounds of a block's side: members, and shingles of all its members.
CHUNK, SHINGLES = 512, 1 << 20


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BINS) densified values; rows of empty sets are all the largest value."""
    n, empty = len(sets), np.uint64(2**64 - 1)
    out = np.full(n * BINS, empty, dtype=np.uint64)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    h = texts.mix(np.concatenate(sets) ^ np.uint64(0xA5A5A5A5DEADBEEF)) if len(rows) else np.zeros(0, np.uint64)
    bins = (h >> np.uint64(32)) % np.uint64(BINS)
    np.minimum.at(out, rows * BINS + bins.astype(np.int64), h & np.uint64(0xFFFFFFFF))
    out = out.reshape(n, BINS)
    filled = out != empty
    row, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (texts.mix(bin_.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        good = filled[row, donor]
        out[row[good], bin_[good]] = out[row[good], donor[good]]
        row, bin_ = row[~good], bin_[~good]
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    parts = values.reshape(len(values), BANDS, ROWS)
    h = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(ROWS):
        h = texts.mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(id, key, n, k1, k2, bands) of every (id, key, text); k1 and k2 tell the sets apart."""

    def run(batches):
        for batch in batches:
            for piece in texts.pieces(batch, "text"):
                sets = texts.shingle_sets(piece.column("text"), width)
                sums = [np.array([int(texts.mix(s + np.uint64(k)).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                        for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), piece.column("key"), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums),
                     pa.array(list(band_hashes(signatures(sets))), pa.list_(pa.int64()))],
                    names=["id", "key", "n", "k1", "k2", "bands"])

    return docs.mapInArrow(run, "id long, key long, n long, k1 long, k2 long, bands array<long>")


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which left sets and right sets have a Jaccard similarity of ``percent`` or more."""
    size_l, size_r = (np.array([len(s) for s in x]) for x in (left, right))
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(flat_l, flat_r)
    both = np.zeros((len(left), len(right)))
    step = max(1, (1 << 22) // (len(left) + len(right)))
    for lo in range(0, len(shared), step):
        part = shared[lo: lo + step]
        sides = []
        for flat, sizes in ((flat_l, size_l), (flat_r, size_r)):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            side = np.zeros((len(sizes), len(part)), dtype=np.float32)
            side[np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    return 100 * both >= percent * (size_l[:, None] + size_r - both)


def confirm(jobs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) that span the links in every job.

    jobs: (j1, j2, j3, j4) name a job; ``left`` tells the side of the class ``id``; classes in the same
    ``component`` are not compared. A class is checked on the text whose id and key it carries.
    """

    def run(key, job):
        side = job.column("left").to_numpy(zero_copy_only=False)
        left, right = job.filter(pa.array(side)), job.filter(pa.array(~side))
        xs = ys = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            sets = [texts.shingle_sets(t.column("text").combine_chunks(), width) for t in (left, right)]
            ids = [t.column("id").to_numpy() for t in (left, right)]
            parts = [t.column("component").to_numpy() for t in (left, right)]
            forest = Forest(*ids)
            forest.add(0, linked(*sets, percent) & (parts[0][:, None] != parts[1]))
            xs, ys = forest.pairs()
        return pa.table({"a": xs, "b": ys})

    jobs = written(jobs, "jobs")
    wanted = jobs.select("id").distinct().join(
        classes.select("id", F.col("doc").alias("_doc"), F.col("key").alias("_key")), "id")
    here = (F.col("_id") == F.col("_doc")) & (F.col("key") == F.col("_key"))
    whole = docs.select(F.col("id").alias("_id"), "key", "text").join(wanted, here).groupBy("id").agg(F.max("text").alias("text"))
    return jobs.join(whole, "id").groupBy("j1", "j2", "j3", "j4").applyInArrow(run, "a long, b long")


def _chunks(members, shingles):
    return F.greatest(F.ceil(members / CHUNK), F.ceil(shingles / SHINGLES), F.lit(1)).cast("int")


def star_jobs(members: DataFrame, percent: int) -> DataFrame:
    """One pair of every member of a bucket with the bucket's smallest id, dealt into jobs."""
    centres = members.groupBy("band", "h").agg(
        F.min(F.struct("id", "n")).alias("c"), F.count("*").alias("size")).where("size > 1")
    pairs = (
        members.join(centres, ["band", "h"]).where(F.col("id") != F.col("c.id"))
        .where(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
        .select(F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n"), "id", "n").distinct())
    pairs = written(pairs, "star-pairs")
    sizes = pairs.groupBy("centre").agg(_chunks(F.count("*"), F.sum("n")).alias("chunks"))
    none = F.lit(0).alias("j3"), F.lit(0).alias("j4")
    # few centres have more than a chunk of members, so a hot one need not be shuffled to
    large = bounded(written(sizes.where("chunks > 1"), "large-stars"))
    dealt = pairs.join(large, "centre", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).select(
        F.col("centre").alias("j1"), F.pmod(F.xxhash64("id"), "chunks").cast("int").alias("j2"), *none,
        F.lit(False).alias("left"), "id", F.col("id").alias("component"))
    heads = sizes.select(
        F.col("centre").alias("j1"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j2"), *none,
        F.lit(True).alias("left"), F.col("centre").alias("id"), F.col("centre").alias("component"))
    return dealt.unionByName(heads)


def residual_jobs(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members outside the largest component of their bucket, against all members of the bucket."""
    members = members.join(groups, F.col("id") == F.col("node"), "left").select(
        "band", "h", "id", "n", F.coalesce("component", "id").alias("component"))
    members = written(members, "bucket-members")
    parts = members.groupBy("band", "h", "component").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    buckets = written(
        parts.groupBy("band", "h").agg(
            F.max(F.struct("size", "n", "component")).alias("top"), F.sum("size").alias("size"),
            F.sum("n").alias("n"), F.count("*").alias("kinds"))
        .where("kinds > 1 and size > 2")
        .select("band", "h", F.col("top.component").alias("top"),
                _chunks(F.col("size") - F.col("top.size"), F.col("n") - F.col("top.n")).alias("lefts"),
                _chunks(F.col("size"), F.col("n")).alias("rights")), "open-buckets")
    both = members.join(buckets, ["band", "h"])
    deal = F.xxhash64(F.lit(1), "id")

    def side(rows: DataFrame, left: bool) -> DataFrame:
        mine, theirs = ("lefts", "rights") if left else ("rights", "lefts")
        own, other = F.pmod(deal, mine).cast("int"), F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        rows = rows.select("band", "h", "id", "component", own.alias("own"), other.alias("other"))
        return rows.select(
            F.col("h").alias("j1"), F.col("band").alias("j2"), F.col("own" if left else "other").alias("j3"),
            F.col("other" if left else "own").alias("j4"), F.lit(left).alias("left"), "id", "component")

    return side(both.where("component != top"), True).unionByName(side(both, False))


def key_of(text: Column) -> Column:
    """A hash that tells the texts of one id apart."""
    return F.xxhash64(F.lit(7), text)


def dedup(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, n_shingles, component_id, kept, head) for every row.

    ``key`` is ``key_of`` its text; ``head`` tells rows with the id and key that stand for their
    group. If ids repeat with other texts, more than one row of a group may have its id, but only one
    pair of id and key is the head.
    """
    texts.small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), key_of(F.col(text)).alias("key"), F.col(text).alias("text"))
    sketches = written(sketch(docs, width), "sketches")
    able = sketches.where("id is not null and n > 0")
    classes = written(
        able.groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "key", "bands")).alias("head"))
        .select("k1", "k2", "n", F.monotonically_increasing_id().alias("id"), F.col("head.id").alias("doc"),
                F.col("head.key").alias("key"), F.col("head.bands").alias("bands")), "text-classes")
    members = classes.select("id", "n", F.posexplode("bands").alias("band", "h"))
    crowded = members.groupBy("band", "h").count().where("count > 1").select("band", "h")
    members = written(members.join(crowded, ["band", "h"], "left_semi"), "bucket-members")
    stars = written(confirm(star_jobs(members, percent), docs, classes, width, percent), "links")
    groups = written(components(stars), "groups")
    rest = written(confirm(residual_jobs(members, groups), docs, classes, width, percent), "links")
    joined = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = components(joined.unionByName(rest))
    grouped = written(classes.select("id", "k1", "k2", "n", "doc", "key").join(groups, F.col("id") == F.col("node"), "left").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n").alias("c3"), "doc", "key",
        F.coalesce("component", "id").alias("component")), "grouped-classes")
    heads = grouped.groupBy("component").agg(F.min(F.struct("doc", "key")).alias("first"))
    judged = grouped.select("c1", "c2", "c3", "component").join(heads, "component").select("c1", "c2", "c3", "first")
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") == F.col("c3")) & F.col("id").isNotNull()
    component = F.coalesce("first.doc", "id")
    return sketches.select("id", "key", "n", "k1", "k2").join(judged, same, "left").select(
        "id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        (F.col("first").isNull() | ((F.col("id") == F.col("first.doc")) & (F.col("key") == F.col("first.key")))).alias("head"))


def distinct_rows(docs: DataFrame, percent: int = 80, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one row stays of every group, all columns with it."""
    found = written(dedup(docs, percent, width, doc_id, text).select("id", "key", "n_shingles", "head"), "near-copies")
    copies = found.where("not head").select("id", "key").distinct()
    twice = found.where("head and n_shingles > 0 and id is not null").groupBy("id", "key").count().where("count > 1").select("id", "key")
    keyed = docs.select(F.struct("*").alias("row"), docs[doc_id].cast("long").alias("id"), key_of(docs[text]).alias("key"))
    kept = keyed.join(copies, ["id", "key"], "left_anti")
    if not twice.isEmpty():  # equal ids and texts: any one of the rows
        kept = kept.join(twice, ["id", "key"], "left_anti").unionByName(
            kept.join(twice, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]))
    return kept.select("row.*")
