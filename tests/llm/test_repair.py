"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import re
import sys
import zlib

import duckdb
import pytest

from strandmill.llm import repair

SPACE, NEXT = "\x20\t\n\x0b\x0c\r", {0: 2, 1: 2, 3: 2, 2: 3}
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for row in rows:
        conv, turn, role, text = (" " if x is None else x for x in row)
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(row[0], row[1], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired rows): the least of all ways, by the suffix."""
    sys.setrecursionlimit(20_000)

    @functools.cache
    def go(i, state, inserts):
        ways, to = [], NEXT[state]
        turn = "user" if to == 2 else "assistant"

        def then(cost, letter, rest, row=None):
            ways.append((cost + rest[0], letter + rest[1], ((row,) if row else ()) + rest[2]))

        if i == len(rows):
            if state in (0, 3):
                return 0, "", ()
        else:
            _, _, role, text = rows[i]
            then(2, "D", go(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] == "s" and state == 0:
                    then(more, "K", go(i + 1, 1, 0), (role, text))
                if role[:1] == turn[:1]:
                    then(more, "K", go(i + 1, to, 0), (role, text))
                then(1 + more, "R", go(i + 1, to, 0), (turn, text))
        if inserts < 3:
            then(5, "I", go(i, to, inserts + 1), (turn, ""))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    return go(0, 0, 0)


def plain(rows):
    left, out = damaged(rows), {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, fixed = cheapest(tuple(own), tuple(faults)) if own else (0, "", ())
        out[conv] = (gaps, *map(faults.count, FIELDS[1:4]), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def talks():
    rng = random.Random(13)
    roles, said = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Hi.", "ok", "", "  ", "What?\n", "no!  ", None, "a.b", "x\x0b", "é."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(said)) for c in [None, *range(60)] for _ in range(rng.randrange(0, 14))]
    rows += [(1000, i, rng.choice(roles), f"{rng.choice('ab')}{rng.randrange(300)}." if rng.random() < 0.8 else "same.") for i in range(400)]
    rows += [(1001, 5, "user", "x.")] * 300 + [(1002, i, "user", f"x{i}.") for i in range(300)] + [(1003, 0, "system", "s."), (1004, 0, "assistant", "long. " * 50_000)]
    return rows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("talks"))
    spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{root}/conversations.parquet")
    return root


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_query_matches_the_plain_version(spark, table, batch):
    """Blocks of at most seven rows, so that large conversations are put together from many, and blocks of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {r.conv_id: tuple(r[c] for c in FIELDS) for r in repair.op13_repair(spark, table).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == plain(talks())


def test_sql_matches_the_plain_version(table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{table}/conversations.parquet/*.parquet' WHERE conv_id IS NULL OR conv_id < 1000 OR conv_id > 1002")
    found = con.sql(repair.ORACLE_SQL)
    at = [found.columns.index(c) for c in ("conv_id", *FIELDS)]
    expected = plain([r for r in talks() if r[0] is None or r[0] < 1000 or r[0] > 1002])
    assert {r[at[0]]: tuple(r[i] for i in at[1:]) for r in found.fetchall()} == expected


def test_powers_are_repeated_steps():
    for symbol in range(9):
        by_steps = repair.power(symbol, 0)
        for _ in range(12):
            by_steps = repair._times(by_steps, repair.power(symbol, 0))
        assert repair.matrix([(symbol, 13)]) == by_steps
        assert repair.costs(by_steps, repair.END)[0] == repair.costs(repair.matrix([(symbol, 6), (symbol, 7)]), repair.END)[0]


def test_operator_gives_rows(spark):
    rows = spark.createDataFrame([("a", 1.5, "user", "Hi.", 1), ("a", 2.5, "user", "Well.", 2), ("b", 0.5, "user", " ", 3), (None, None, None, None, 4)], "conv string, turn double, role string, text string, place int")
    found = repair.repair(rows, "conv")
    fixed = {}
    for r in found.repaired.orderBy("place", "sub").collect():
        fixed.setdefault(r.conv, []).append((r.role, r.text))
    assert fixed == {"a": [("user", "Hi."), ("assistant", "Well.")]}
    done = {}
    for r in found.edits.orderBy("block").collect():  # a conversation may lie in two blocks
        letters, cost = done.get(r.conv, ("", 0))
        done[r.conv] = (letters + r.letters, cost + r.cost)
    assert done == {"a": ("KR", 1), "b": ("D", 2), None: ("D", 2)}
    assert repair.repair(rows.limit(0), "conv").repaired.collect() == []
