"""Repaired conversations against SQL that keeps every cheapest path, whole and cut into segments; defined cases."""

import hashlib
import itertools
import random

import duckdb
import pytest

from residua.llm.chat_repair import ARCS, distances, repair_conversations, repair_sql, walk

SCHEMA = "conv_id long, turn long, role string, text string, seg long, code string, n int"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
ROLES = ["user"] * 4 + ["assistant"] * 4 + ["system", "tool", "usher", "", None, "été"]
TEXTS = ["Yes.", "No!", "Why? ", "cut off", "a.\x0b\n", " \t", "", None, "...", "é ", "same.", "x" * 50_000 + "."]


def conversations(seed, count, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(count):
        for t in range(rng.randrange(1, longest)):
            turn = rng.choice([t, t, t, t + 5, None]) if rng.random() < 0.2 else t
            text = rng.choice(TEXTS) if rng.random() < 0.5 else f"Said {c} {t}{rng.choice('.!? ,')}"
            rows += [(c if c else None, turn, rng.choice(ROLES), text, 0, "x", 1)] * rng.choice([1, 1, 1, 1, 2])
    return rows


def by_sql(spark, rows):
    con = duckdb.connect()
    con.register("conversations", spark.createDataFrame(rows, SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    done = con.execute(repair_sql())
    names = [d[0] for d in done.description]
    return {tuple(dict(zip(names, r))[c] for c in COLUMNS) for r in done.fetchall()}


@pytest.mark.parametrize("segment_rows", [4096, 1, 3])
def test_against_all_cheapest_paths(spark, segment_rows):
    rows = conversations(3, 90, 14)
    got = repair_conversations(spark.createDataFrame(rows, SCHEMA), segment_rows=segment_rows).select(*COLUMNS).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {tuple(r) for r in got} == by_sql(spark, rows)


def test_one_conversation_with_most_rows(spark):
    """Spread over segments and partitions; a third of its rows repeat one text, one row is repeated in its own turn."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), "again." if t % 3 == 0 else f"row {t}{rng.choice(['.', '', '!'])}", 0, "", 0) for t in range(900)]
    rows += [(7, 450, "user", "once more.", 0, "", 0)] * 300 + conversations(6, 9, 5)
    got = repair_conversations(spark.createDataFrame(rows, SCHEMA), segment_rows=64).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == by_sql(spark, rows)


def brute(codes):
    """Least (cost, edits) over every sequence of edits with at most two inserts before each row and at the end."""
    follow, best = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}, None
    for plan in itertools.product(itertools.product(range(3), "DKR"), repeat=len(codes)):
        for tail in range(3):
            s, cost, out = 0, 0, ""
            for (inserts, edit), code in [*zip(plan, codes), ((tail, ""), 0)]:
                for _ in range(inserts):
                    s, cost, out = follow[s][2 if s == 2 else 1], cost + 3, out + "I"
                initial = code % 4 if edit == "K" else 2 if s == 2 else 1
                if edit in "KR" and edit:
                    if initial not in follow[s]:
                        s = None
                        break
                    s, cost = follow[s][initial], cost + (3 if edit == "R" else 0) + (3 if code >= 12 else 0)
                cost, out = cost + 4 * (edit == "D"), out + edit
            if s in (0, 3) and (best is None or (cost, out) < best):
                best = cost, out
    return best


def test_paths_against_enumeration():
    for n in range(4):
        for codes in itertools.product(sorted(ARCS), repeat=n) if n < 3 else random.Random(1).sample(list(itertools.product(sorted(ARCS), repeat=3)), 40):
            dist = distances(bytes(codes), [0, None, None, 0], True)
            assert (dist[0][0], walk(bytes(codes), dist, 0, True)[1]) == brute(codes), codes


def test_no_rows(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    import zlib

    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    [r] = repair_conversations(spark.createDataFrame([(5, gone, "user", "Hm.", 0, "", 0)], SCHEMA)).collect()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
