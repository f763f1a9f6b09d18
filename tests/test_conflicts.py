"""The conflict merge against the pair-by-pair process, on random pairs, chains and a hub."""

import random

from foliant.operators import conflicts as C
from pyspark.sql import functions as F

MEMBERS = "conflict_id long, chunk_id long, status string, detected_at long"


def one_by_one(pairs, members):
    """Outcome, conflict and joined chunk of each pair in order; a new conflict is named by its pair's ('new', seq)."""
    held = {}
    for conflict, chunk, status, at in members:
        held.setdefault(conflict, [status, at, set()])[2].add(chunk)
    out = {}
    for seq, a, b in sorted(pairs):
        known = [c for c, (_, _, chunks) in held.items() if a in chunks and b in chunks]
        of = []
        for x in (a, b):
            open_ = [(at, c) for c, (status, at, chunks) in held.items() if status == "OPEN" and x in chunks]
            of.append(min(open_)[1] if open_ else None)
        if known:
            out[seq] = ("recorded", sorted(known, key=str)[0], None)
        elif of[0] is None and of[1] is None:
            held["new", seq] = ["OPEN", 10**9 + seq, {a, b}]
            out[seq] = ("created", ("new", seq), None)
        elif of[0] is not None and of[1] is not None:
            out[seq] = ("skipped", None, None)
        else:
            target, joined = (of[0], b) if of[0] is not None else (of[1], a)
            held[target][2].add(joined)
            out[seq] = ("grown", target, joined)
    return out


def merged(spark, pairs, members):
    rows = C.merge_pairs(spark.createDataFrame(pairs, "seq long, a long, b long").repartition(3), spark.createDataFrame(members, MEMBERS)).collect()
    assert len(rows) == len({r["seq"] for r in rows})
    return {r["seq"]: (r["outcome"], r["conflict_id"] if r["opened_by"] is None else ("new", r["opened_by"]), r["joined"]) for r in rows}


def test_random_pairs_merge_as_one_by_one(spark):
    rnd = random.Random(4)
    for n, chunks, recorded in ((60, 12, 0), (150, 60, 6), (200, 300, 20)):
        pairs = []
        for seq in rnd.sample(range(10 * n), n):
            a, b = rnd.sample(range(chunks), 2)
            pairs.append((seq, a, b))
        members = [(9000 + c, x, "OPEN" if c % 3 else "REVIEWED", 50 - c) for c in range(recorded // 2) for x in range(chunks) if x % max(1, recorded) in (2 * c, 2 * c + 1) and x % 2 == c % 2]
        assert merged(spark, pairs, members) == one_by_one(pairs, members)


def test_repeated_odd_and_empty_pairs(spark):
    pairs = [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 5, 5), (5, None, 6), (6, 7, None), (7, 6, 7)]
    members = [(40, 6, "DISMISSED", 1), (40, 7, "DISMISSED", 1), (41, None, "OPEN", 1)]
    assert merged(spark, pairs, members) == one_by_one([p for p in pairs if None not in p and p[1] != p[2]], members)
    assert merged(spark, [], members) == {} and merged(spark, [(1, 8, 9)], []) == {1: ("created", ("new", 1), None)}


def test_pairs_of_a_chunk_with_itself_count_if_asked(spark):
    pairs = spark.createDataFrame([(1, 5, 5), (2, 5, 6), (3, 6, 6), (4, 8, 8), (5, None, 5)], "seq long, a long, b long")
    members = spark.createDataFrame([(40, 8, "OPEN", 1)], MEMBERS)
    got = {r["seq"]: (r["outcome"], r["conflict_id"], r["opened_by"], r["joined"]) for r in C.merge_pairs(pairs, members, own=True).collect()}
    assert got == {1: ("created", None, 1, None), 2: ("grown", None, 1, 6), 3: ("recorded", None, 1, None), 4: ("recorded", 40, None, None)}


def test_statements_of_created_and_grown_conflicts(spark):
    pairs = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 4, 1), (4, 3, 4)], "seq long, a long, b long")
    got = C.new_statements(C.merge_pairs(pairs, spark.createDataFrame([], MEMBERS))).collect()
    assert sorted((r["opened_by"], r["seq"], r["place"], r["chunk"]) for r in got) == [(1, 1, 0, 1), (1, 1, 1, 2), (1, 2, 0, 3), (1, 3, 0, 4)]


def test_a_long_chain_takes_few_rounds(spark):
    n = 3000  # each chunk joins through the one before it
    got = merged(spark, [(i, i, i + 1) for i in range(n)], [])
    assert got[0][0] == "created" and all(got[i] == ("grown", ("new", 0), i + 1) for i in range(1, n))


def test_a_hub_is_no_group(spark):
    rows = C.merge_pairs(spark.range(100_000).select(F.col("id").alias("seq"), F.lit(-1).cast("long").alias("a"), F.col("id").alias("b")), spark.createDataFrame([], MEMBERS))
    counts = {r["outcome"]: r["count"] for r in rows.groupBy("outcome").count().collect()}
    assert counts == {"created": 1, "grown": 99_999}
    assert rows.filter("opened_by <> 0 OR (outcome = 'grown' AND joined <> b)").isEmpty()


def test_confirmation_needs_a_verdict(spark):
    rows = spark.createDataFrame([(True, 0.6), (True, 0.59), (False, 0.9), (None, 0.9), (True, None)], "c boolean, p double")
    assert [r[0] for r in rows.select(C.confirmed(F.col("c"), F.col("p"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in rows.select(C.opened_severity(F.col("c"), F.col("p"))).limit(3).collect()] == ["MAJOR", "MAJOR", "MODERATE"]
