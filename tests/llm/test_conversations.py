"""Repair against a search over all edits, and against the edited rows themselves."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from panelspark.llm import conversations as C
from panelspark.llm import queries

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """What ``repair`` returns for the rows [(turn, role, text)] of one conversation, in order."""
    seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid, kind = SOLID.findall(text), None
        if not solid:
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif solid[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        kinds.append(kind)
        if kind:
            counts[kind] += 1
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    @lru_cache(None)
    def best(i, out, spare):
        """(cost, audit, lines) of the cheapest and then least way to go on; all single edits are tried."""
        ways = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", out):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, out, 2)
            ways.append((cost + 2, "D" + audit, lines))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                for letter, fee, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if ok(out + new[:1]) and new[:1]:
                        cost, audit, lines = best(i + 1, short(out + new[:1]), 2)
                        ways.append((cost + fee + more, letter + audit, (f"{new}:{text}", *lines)))
        if spare:
            for new in ("user", "assistant"):
                if ok(out + new[:1]):
                    cost, audit, lines = best(i, short(out + new[:1]), spare - 1)
                    ways.append((cost + 5, "I" + audit, (f"{new}:", *lines)))
        return min(ways) if ways else (10**9, "", ())

    def ok(out):
        return re.fullmatch("s?(ua)*u?", out)

    def short(out):  # what decides whether the roles can go on
        return re.sub("(ua)+", "ua", out)

    cost, audit, lines = best(0, "", 2)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(rng, conv):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "usher"]
    words = ["Yes.", "No!", "Why", "", " \t", "More?", "And so on. ", "Yes."]
    return [(conv, t, rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(words) + (str(rng.randrange(9)) + "." if rng.random() < .5 else ""))
            for t in sorted(rng.sample(range(12), rng.randint(0, 7)))]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def test_every_conversation_equals_the_search_over_all_edits(spark):
    rng = random.Random(2)
    made_up = [made(rng, i) for i in range(400)]
    rows = [r for rs in made_up for r in rs] + [(1000, t, "user", "Same.") for t in range(6)]
    rows += [(1001, None, "user", "A."), (1001, None, "assistant", "B."), (1001, 4, "user", "C."), (1001, 4, "user", "C.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r[0]: tuple(r[1:]) for r in C.repair(df).collect()}
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(tuple(row))
    assert set(got) == set(by_conv)
    for conv, mine in by_conv.items():
        assert got[conv] == plain(in_order(mine)), mine


def test_edited_rows_hash_to_the_digest_and_read_as_they_should(spark):
    rng = random.Random(4)
    rows = [r for i in range(150) for r in made(rng, i)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    audits = C.repair(df)
    turns = {}
    for r in C.repaired_turns(df, audits).orderBy("conv_id", "place").collect():
        turns.setdefault(r["conv_id"], []).append(r)
    for r in audits.collect():
        mine = turns.get(r["conv_id"], [])
        assert [t["place"] for t in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in mine))
        text = "\n".join(f"{t['role']}:{t['text']}" for t in mine)
        assert hashlib.sha256(text.encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(t["edit"] for t in mine) == r["audit"].replace("D", "")
        assert all((t["turn"] is None) for t in mine if t["edit"] == "I")


def test_pointers_spill_and_batches_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD", 64)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(6)
    rows = [(None, t, rng.choice(["user", "assistant"]), f"Line {rng.randrange(2000)}.") for t in range(5000)]
    stream = C.Stream("x")
    seen = set()
    for _, turn, role, text in rows:
        stream.row(turn, role, text, (role, text) not in seen)
        seen.add((role, text))
    want = stream.finish()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r[1:]) for r in got] == [want[1:]] and len(want[7]) >= 5000


def test_nulls_empty_tables_lost_conversations_and_other_columns(spark):
    schema = "conv_id long, turn long, role string, text string, kind string, digest string"
    rows = [(1, 0, None, "Hm.", "k", "d"), (1, 1, "assistant", None, "k", "d"), (None, None, "user", "Hello.", "k", "d"),
            (None, 1, "assistant", "Yes. " * 50_000, "k", "d")]
    df = spark.createDataFrame(rows, schema)
    every = spark.createDataFrame([(1,), (None,), (9,)], "conv_id long")
    got = {r["conv_id"]: r for r in C.repair(df, every=every).collect()}
    assert got[9][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[1]["blank"] == 1 and got[1]["audit"] == "DD" and got[1]["illegal"] == 1
    assert got[None]["audit"] == "KK" and got[None]["gaps"] == 0
    assert C.repair(df.limit(0)).count() == 0
    assert C.repair(df.limit(0), every=every).count() == 3


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = {}
    for r in C.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, row = zlib.crc32(key.encode()) % 20, (role or " ", text or " ")
        want = {0: [], 1: [(row[0], "")], 2: [(row[0], re.sub("[.!?]", "", row[1]))], 3: [row, row], 4: [("user", row[1])]}
        assert got.get((conv, turn), []) == want.get(kind, [row])


def test_query_equals_the_search(spark, sf):
    table = queries.table(spark, sf, "conversations")
    by_conv = {r[0]: [] for r in table.select("conv_id").collect()}
    for r in C.damaged(table).collect():
        by_conv[r[0]].append(tuple(r[1:]))
    for r in queries.op13_conversations(spark, sf).collect():
        mine = by_conv[r["conv_id"]]
        assert tuple(r[1:]) == (plain(in_order(mine)) if mine else (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()))
