"""Conversation repair against an exhaustive search, on awkward rows, and its query against its SQL."""

import hashlib
import random
from functools import lru_cache

import duckdb
import pytest

from pedigraph.llm import repair

CONVS = "conv_id long, turn long, role string, text string"


def slow(initials, forced, truncated):
    """Cheapest edits by memoised search over single edits."""

    @lru_cache(None)
    def go(i, state, run):
        found = [(0, "")] if i == len(initials) and state in (repair.START, repair.ASSISTANT) else []
        if run < 2:
            cost, rest = go(i, repair.expected(state), run + 1)
            found.append((cost + 2, "I" + rest))
        if i < len(initials):
            cost, rest = go(i + 1, state, 0)
            found.append((cost + 3, "D" + rest))
            if not forced[i]:
                cost, rest = go(i + 1, repair.expected(state), 0)
                found.append((cost + 2 + truncated[i], "R" + rest))
                own = initials[i]
                if own == "s" and state == repair.START or own == ("a" if state == repair.USER else "u"):
                    cost, rest = go(i + 1, repair.following(state, own), 0)
                    found.append((cost + truncated[i], "K" + rest))
        return min(found) if found else (10**9, "")

    return go(0, repair.START, 0)


def slow_report(turns):
    """One conversation's (turn, role, text) rows, in order, as the report and the repaired lines."""
    faults, seen = [], set()
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in turns]
    cost, audit = slow(tuple(initials), tuple(f in (1, 2) for f in faults), tuple(f == 3 for f in faults))
    lines, at, state = [], 0, repair.START
    for edit in audit:
        if edit in "IR":
            state = repair.expected(state)
            lines.append(repair.NAMES[state] + ":" + ("" if edit == "I" else turns[at][2]))
        elif edit == "K":
            state = repair.following(state, initials[at])
            lines.append(turns[at][1] + ":" + turns[at][2])
        at += edit != "I"
    numbers = [t for t, _, _ in turns if t is not None]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, "blank": faults.count(1), "duplicate": faults.count(2),
        "truncated": faults.count(3), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost,
        "audit": audit, "digest": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_blocks_and_tables(size):
    rng = random.Random(size)
    for _ in range(400):
        n = rng.randrange(1, 15)
        initials = [rng.choice("suauauax ") for _ in range(n)]
        forced = [rng.random() < 0.2 for _ in initials]
        truncated = [not f and rng.random() < 0.3 for f in forced]
        cut = [repair.aligned(initials[k:k + size], forced[k:k + size], truncated[k:k + size]) for k in range(0, n, size)]
        cost, parts = repair.folded([c for c, _ in cut], [a for _, a in cut])
        assert (cost, "".join(a for _, a in parts)) == slow(tuple(initials), tuple(forced), tuple(truncated))


def made(seed, convs, most):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three", "Four?  ", "", " \n", None, "é\U0001f389.", "Five. Six"]
    return [(rng.choice([c, c, c, None]) if c % 7 == 0 else c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(texts)) for c in range(convs) for t in range(rng.randrange(most))]


@pytest.mark.parametrize("block", [2, 64])
def test_awkward_conversations(spark, block):
    rows = made(block, 30, 12) + [(1, 3, "user", "same.")] * 5
    df = spark.createDataFrame(rows, CONVS).withColumn("conv", repair.F.lit("x")).withColumn("copies", repair.F.lit("y"))
    report, turns = repair.repair(df, block=block)
    hashed = {r.conv: r.digest for r in repair.digests(turns).collect()}
    got = {r.conv: r.asDict() for r in report.collect()}
    assert set(got) == {c for c, _, _, _ in rows}
    for conv, own in got.items():
        mine = sorted((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv)
        want = slow_report([(t if known else None, r, x) for known, t, r, x in mine])
        assert {**{k: v for k, v in own.items() if k != "conv"}, "digest": hashed.get(conv, hashlib.sha256().hexdigest())} == want
    assert repair.repair(df.limit(0))[0].count() == 0 and repair.repair(df.limit(0))[1].count() == 0


def test_a_long_conversation_in_blocks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No.", f"Line {t}.", f"Cut {t}", ""]) + "x" * rng.choice([0, 0, 40_000])) for t in range(400)]
    rows += [(1, None, "user", "Many."), *[(2, 5, "user", "Again.")] * 700]
    df = spark.createDataFrame(rows, CONVS)
    whole = {r.conv: r.asDict() for r in repair.repair(df, block=1 << 20)[0].collect()}
    assert {r.conv: r.asDict() for r in repair.repair(df)[0].collect()} == whole
    assert whole[2]["duplicate"] == 699 and whole[2]["cost"] == 3 * 699 + 2


def test_query_equals_its_sql(spark, tmp_path):
    rows = made(11, 120, 9)
    spark.createDataFrame(rows, CONVS).write.parquet(f"{tmp_path}/conversations.parquet")
    df = repair.op12_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    answer = con.execute(repair.ORACLE)
    names = [c[0] for c in answer.description]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted(answer.fetchall(), key=repr)
    assert df.columns == names
