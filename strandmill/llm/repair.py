"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

Rows of a conversation become symbols of role and fault, and equal ones in a row become runs. The cost of what is still
to come, from each of four states (nothing yet, after a system, a user, an assistant turn), is a vector; a symbol's edits
are a 4 x 4 matrix in min-plus algebra. A run of n rows is n such steps at once, by the binary powers of its matrix, which each
process keeps. Choices are then unrolled row by row, always the least letter of those that stay on a cheapest way.

A conversation may hold any share of all rows, so no step brings its rows together. Rows are sorted over all tasks by
conversation and turn (a range of the order each, so a large conversation lies in many), and their place in that order
is their number. A stretch of up to a batch of rows is a block; only blocks meet by conversation, as a few numbers
each: once from the last to the first, to hand each block the costs that come after it, and once from the first to
the last, to choose between what it does from each state. A later block is unrolled from all four states. Rows seen earlier are
told by the least place of each (conversation, role, SHA-256 of the text), added up before the shuffle and joined back
by place. ``repair`` gives the rows; the digest and the audit of a whole conversation are one value, which the query
makes from them in one pass over sorted rows.

Defined cases: a null role or text is one space; null turns come first; rows of one turn are ordered by role and the
text's SHA-256, so equal rows are neighbours; rows with null conversation are one conversation; a role counts by its first character,
one without any fits nowhere; an empty table gives no rows; a text of any length is one value; repeated rows are
duplicates; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm import common

SPACE = " \t\n\x0b\f\r"
INITIALS = "sua"  # system, user, assistant; any other is the fourth kind
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
GONE = 8  # the symbol of a row that must be deleted; others are 2 * kind of role + (1 if truncated)
FAR = 1 << 60
AFTER_USER = {0: 2, 1: 2, 3: 2, 2: 3}  # state -> state, by a user turn or, after a user, an assistant turn
END = (0, 2 * INSERT, INSERT, 0)  # costs after the last row: what is missing is inserted
OUT = 1 << 14  # rows that a task gathers before it hands them on; a block adds a batch at most
FAULTS = ("blank", "duplicate", "truncated")


def _times(a, b):
    """Product of matrices, rows of tuples, in min-plus algebra."""
    columns = tuple(zip(*b))
    return tuple(tuple(min(map(sum, zip(row, column))) for column in columns) for row in a)


@functools.cache
def _moves(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what can be done with a row, in the order of letters; D, then K and R."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        role, more, to = symbol // 2, TRUNCATED * (symbol % 2), AFTER_USER[state]
        if (role == 0 and state == 0) or role == to - 1:
            out.append(("K", KEEP + more, 1 if role == 0 else to))
        out.append(("R", REROLE + more, to))
    return tuple(out)


@functools.cache
def power(symbol: int, k: int):
    """The matrix of 2 ** k rows of a symbol; inserts before a row belong to it."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    step = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        at, paid = state, 0
        for _ in range(4):  # no, one, two or three inserts first
            for _, cost, to in _moves(symbol, at):
                step[state][to] = min(step[state][to], paid + cost)
            at, paid = AFTER_USER[at], paid + INSERT
    return tuple(map(tuple, step))


def matrix(runs: list[tuple[int, int]]):
    out = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for symbol, n in reversed(runs):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = _times(power(symbol, k), out)
    return out


def costs(rows, after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(map(sum, zip(row, after))) for row in rows)


@functools.lru_cache(1 << 16)
def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs before a row, less the least of them, from those after it."""
    here = costs(power(symbol, 0), after)
    return tuple(c - min(here) for c in here)


@functools.lru_cache(1 << 16)
def _choice(symbol: int, after: tuple[int, ...], state: int) -> tuple[str, str]:
    """The least letters of a row, inserts before it included, that are on a cheapest way; the state after each."""
    here, letters, states = costs(power(symbol, 0), after), "", ""
    while True:
        fits = {letter: to for letter, cost, to in _moves(symbol, state) if cost + after[to] == here[state]}
        if "D" not in fits and INSERT + here[AFTER_USER[state]] == here[state]:
            state = AFTER_USER[state]
            letters, states = letters + "I", states + str(state)
            continue
        letter = min(fits)
        return letters + letter, states + str(fits[letter])


def unrolled(runs: list[tuple[int, int]], after: tuple[int, ...], starts: range, last: bool) -> list[tuple[str, str]]:
    """From each start state: the letters of the rows, and the state after each letter."""
    steps, v = [], tuple(c - min(after) for c in after)
    for symbol, n in reversed(runs):
        for _ in range(n):
            steps.append((symbol, v))
            v = _before(symbol, v)
    steps.reverse()
    out = []
    for state in starts:
        letters, states = [], []
        for symbol, v in steps:
            said, went = _choice(symbol, v, state)
            letters.append(said)
            states.append(went)
            state = int(went[-1])
        while last and END[state]:
            state = AFTER_USER[state]
            letters.append("I")
            states.append(str(state))
        out.append(("".join(letters), "".join(states)))
    return out


def placed(talks: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, role, text, digest, blank, ended, place), sorted and numbered over all conversations."""
    n = int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    space = F.lit(" ")
    rows = talks.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    bare = F.rtrim("text", F.lit(SPACE))
    rows = rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), (bare == "").alias("blank"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"))
    order = ("conv", "turn", "role", "digest", "tie")  # the last keeps a million equal rows from one task
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return common.stored(rows.drop("tie").withColumn("place", F.monotonically_increasing_id()), "talks")


def marked(rows: DataFrame) -> DataFrame:
    """(conv, turn, place, kind, fault): the kind of role, and the row's first fault or null."""
    first = rows.groupBy("conv", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    kind = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    kind = F.when(F.col("role") == "", F.lit(3)).otherwise(kind)
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    own = rows.select("conv", "turn", "place", kind.cast("int").alias("kind"), "blank", "ended")
    return own.join(first, "place", "left").select("conv", "turn", "place", "kind", fault.alias("fault"))


_RUNS = T.ArrayType(T.StructType([T.StructField("symbol", T.IntegerType()), T.StructField("n", T.LongType())]))
_LONGS = T.ArrayType(T.LongType())


def _schema(like: DataFrame, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv", like.schema["conv"].dataType), *(T.StructField(k, v) for k, v in fields.items())])


def _batch(schema: T.StructType, rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows)) if rows else [()] * len(schema)
    kinds = [conv, *(to_arrow_type(f.dataType) for f in schema.fields[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)


def blocks(marks: DataFrame) -> DataFrame:
    """(conv, block, runs, steps, illegal, first, last): stretches of rows of a conversation; ``block`` is the first one's place."""
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = _schema(marks, block=T.LongType(), runs=_RUNS, steps=_LONGS, illegal=T.LongType(), first=T.IntegerType(), last=T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            code = b.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            place, kind, symbol = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            cut = np.flatnonzero((np.diff(code) != 0) | (np.diff(place) != 1)) + 1
            convs, out = b.column(0).to_pylist(), []
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(b)]):
                turns = np.flatnonzero(np.diff(symbol[s:e])) + 1
                edges = [0, *turns.tolist(), e - s]
                runs = [(int(symbol[s + i]), j - i) for i, j in zip(edges, edges[1:])]
                a, z = kind[s : e - 1], kind[s + 1 : e]
                legal = ((a == 0) & (z == 1)) | ((a == 1) & (z == 2)) | ((a == 2) & (z == 1))
                steps = [c for row in matrix(runs) for c in row]
                out.append((convs[s], int(place[s]), [{"symbol": x, "n": k} for x, k in runs], steps, int((~legal).sum()), int(kind[s]), int(kind[e - 1])))
            yield _batch(schema, out, b.schema.field(0).type)

    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.lit(GONE)).otherwise(2 * F.col("kind") + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    own = marks.select("conv", "place", "kind", symbol.cast("int").alias("symbol"))
    return common.stored(own.repartitionByRange(n, "place").sortWithinPartitions("place").mapInArrow(run, schema), "blocks")


def _by_conversation(rows: DataFrame, order: Column, fields: dict, walk) -> DataFrame:
    """Small rows of blocks by conversation, in order. ``walk()`` makes a function of a row (None at the end) that gives rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = _schema(rows, **fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = walk(), None
        for b in batches:
            kind = b.schema.field(0).type
            out = []
            for part in common.slices(iter([b]), 1024):
                for row in part.to_pylist():
                    out += state(row)
            if out:
                yield _batch(schema, out, kind)
        if kind is not None and (out := list(state(None))):
            yield _batch(schema, out, kind)

    return rows.repartition(n, "conv").sortWithinPartitions("conv", order).mapInArrow(run, schema)


class _Backward:
    """Blocks of a conversation from the last to the first -> what the rows after each cost; a row waits for the next one."""

    def __init__(self):
        self.held, self.after = None, END

    def __call__(self, row):
        out, new = [], row is not None and (self.held is None or self.held[0] != row["conv"])
        if self.held is not None:
            out.append((*self.held, row is None or new))
        if row is not None:
            self.after = END if new else self.after
            steps, after = row["steps"], self.after
            self.after = costs([steps[i : i + 4] for i in (0, 4, 8, 12)], after)
            self.held = (row["conv"], row["block"], list(after), new, self.after[0])
        return out


class _Forward:
    """Blocks in order with the states they end in -> which of its ways each takes."""

    def __init__(self):
        self.conv, self.state, self.last, self.fresh = None, 0, None, True

    def __call__(self, row):
        if row is None:
            return []
        if self.fresh or row["conv"] != self.conv:
            self.conv, self.state, self.last, self.fresh = row["conv"], 0, None, False
        broken = self.last is not None and (self.last, row["first"]) not in ((0, 1), (1, 2), (2, 1))
        at = self.state if len(row["ends"]) > 1 else 0
        self.state, self.last = row["ends"][at], row["last"]
        return [(row["conv"], row["block"], at, row["illegal"] + broken)]


def edits(found: DataFrame) -> DataFrame:
    """(conv, block, letters, states, illegal, cost) of each block; cost is the conversation's, at its first block, else 0."""
    way = T.ArrayType(T.StructType([T.StructField("letters", T.StringType()), T.StructField("states", T.StringType())]))
    after = {"block": T.LongType(), "after": _LONGS, "final": T.BooleanType(), "cost": T.LongType(), "opening": T.BooleanType()}
    backward = _by_conversation(found.select("conv", "block", "steps"), F.desc("block"), after, _Backward)
    joined = found.join(backward.drop("conv"), "block")
    schema = _schema(found, block=T.LongType(), ways=way, illegal=T.LongType(), first=T.IntegerType(), last=T.IntegerType(), cost=T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 1024):
            out = []
            for r in b.to_pylist():
                runs = [(x["symbol"], x["n"]) for x in r["runs"]]
                ways = unrolled(runs, tuple(r["after"]), range(1 if r["opening"] else 4), r["final"])
                out.append((r["conv"], r["block"], [{"letters": x, "states": s} for x, s in ways], r["illegal"], r["first"], r["last"], r["cost"] if r["opening"] else 0))
            yield _batch(schema, out, b.schema.field("conv").type)

    ways = joined.select("conv", "block", "runs", "after", "final", "opening", "illegal", "first", "last", "cost").mapInArrow(run, schema)
    ways = common.stored(ways, "ways")
    ends = F.transform("ways", lambda w: F.right(w["states"], F.lit(1)).cast("int")).alias("ends")
    taken = _by_conversation(ways.select("conv", "block", ends, "illegal", "first", "last"), F.asc("block"), {"block": T.LongType(), "at": T.IntegerType(), "illegal": T.LongType()}, _Forward)
    chosen = ways.select("conv", "block", "ways", "cost").join(taken.drop("conv"), "block").withColumn("way", F.get("ways", F.col("at")))
    return common.stored(chosen.select("conv", "block", "way.letters", "way.states", "illegal", "cost"), "edits")


def repaired(done: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv, place, sub, role, text) of repaired conversations, in order of place and sub; inserted rows have the place of the row after them."""
    schema = _schema(done, place=T.LongType(), sub=T.IntegerType(), new_role=T.StringType(), kept=T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, 1024):
            out = []
            for r in b.to_pylist():
                place, sub = r["block"], 0
                for letter, state in zip(r["letters"], r["states"]):
                    if letter != "D":
                        role = None if letter == "K" else "user" if state == "2" else "assistant"
                        out.append((r["conv"], place, sub, role, letter != "I"))
                    place, sub = (place, sub + 1) if letter == "I" else (place + 1, 0)
                if len(out) >= OUT:
                    yield _batch(schema, out, b.schema.field("conv").type)
                    out = []
            yield _batch(schema, out, b.schema.field("conv").type)

    made = done.select("conv", "block", "letters", "states").mapInArrow(run, schema)
    own = rows.select("place", F.lit(True).alias("kept"), "role", "text")
    joined = made.join(own, ["place", "kept"], "left")
    return joined.select("conv", "place", "sub", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


@dataclass
class Repair:
    rows: DataFrame  # (conv, turn, role, text, ..., place): the rows as they came, in order
    marks: DataFrame  # (conv, turn, place, kind, fault)
    edits: DataFrame  # (conv, block, letters, states, illegal, cost)
    repaired: DataFrame  # (conv, place, sub, role, text)


def repair(talks: DataFrame, conv: str = "conv_id", turn: str = "turn") -> Repair:
    """Conversations (conv, turn, role, text) repaired at the least cost."""
    rows = placed(talks, conv, turn)
    marks = common.stored(marked(rows), "marks")
    done = edits(blocks(marks))
    return Repair(rows, marks, done, repaired(done, rows))


def digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) over ``role:text`` of the rows of each conversation, newline-joined; texts pass one by one and are not brought together."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = _schema(rows, sha256=T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = sha = kind = None
        for b in batches:
            kind, out = b.schema.field(0).type, []
            for part in common.slices(iter([b])):
                for key, role, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if sha is None or key != conv:
                        if sha is not None:
                            out.append((conv, sha.hexdigest()))
                        conv, sha = key, hashlib.sha256()
                    else:
                        sha.update(b"\n")
                    sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield _batch(schema, out, kind)
        if sha is not None:
            yield _batch(schema, [(conv, sha.hexdigest())], kind)

    return rows.repartition(n, "conv").sortWithinPartitions("conv", "place", "sub").select("conv", "role", "text").mapInArrow(run, schema)


def damaged(talks: DataFrame) -> DataFrame:
    """The damage of the query's contract, told by the hash of conversation and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = talks.select("conv_id", "turn", kind.alias("kind"), said("role").alias("role"), said("text").alias("text")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(talks))
    count = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    stats = found.marks.groupBy("conv").agg(gaps, *map(count, FAULTS))
    pieces = F.array_sort(F.collect_list(F.struct("block", "letters")))
    audit = F.array_join(F.transform(pieces, lambda p: p["letters"]), "").alias("audit")
    done = found.edits.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit)
    out = talks.select("conv_id").distinct()
    for part in (stats, done, digests(found.repaired)):
        out = out.join(part, out["conv_id"].eqNullSafe(part["conv"]), "left").drop("conv")
    longs = ("gaps", *FAULTS, "illegal", "cost")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


def _sql_edit(letter: str, cost: str, rest: str, said: str = "") -> str:
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 's': {f'list_prepend({said}, {rest}.s)' if said else f'{rest}.s'}}}"


def _oracle_sql() -> str:
    """The same from the definition: rows from the last to the first, with the cheapest (cost, audit, repaired rows) from each state."""
    never, done = "{'c': 1000000000, 'a': '', 's': []::VARCHAR[]}", "{'c': 0, 'a': '', 's': []::VARCHAR[]}"
    user, assistant = (lambda rest, r=r: _sql_edit("I", "5", rest, f"'{r}:'") for r in ("user", "assistant"))
    keep = lambda rest: _sql_edit("K", "more", rest, "role || ':' || text")
    rerole = lambda rest, r: _sql_edit("R", "1 + more", rest, f"'{r}:' || text")
    delete = lambda rest: _sql_edit("D", "2", rest)

    def step(own: str, to: str, turn: str, also: str = "") -> str:
        ways = [delete(own), *([f"CASE WHEN alive AND kind = 's' THEN {keep(also)} ELSE {never} END"] if also else [])]
        ways += [f"CASE WHEN alive AND kind = '{turn[0]}' THEN {keep(to)} ELSE {never} END", f"CASE WHEN alive THEN {rerole(to, turn)} ELSE {never} END"]
        return f"least({', '.join(ways)})"

    closed = f"""SELECT * EXCLUDE (w0, w1, w2, w3, x2, x3), least(w0, {user("x2")}) AS v0, least(w1, {user("x2")}) AS v1, least(w2, {assistant("x3")}) AS v2, least(w3, {user("x2")}) AS v3
      FROM (SELECT *, least(w2, {assistant("w3")}) AS x2, least(w3, {user("w2")}) AS x3 FROM %s)"""
    bits = "list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(crc, byte))"
    return f"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT), lambda crc, byte: {bits}, 4294967295), 4294967295) % 20 AS h
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE h <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS kind, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    kind || lead(kind) OVER (PARTITION BY conv_id ORDER BY i) AS pair
  FROM numbered
), marked AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, fault IS NULL OR fault = 'truncated' AS alive FROM faults
), walk AS (
  SELECT DISTINCT conv_id, n + 1 AS i, {done} AS w0, {never} AS w1, {never} AS w2, {done} AS w3 FROM marked
  UNION ALL
  SELECT conv_id, i, {step("v0", "v2", "user", "v1")}, {step("v1", "v2", "user")}, {step("v2", "v3", "assistant")}, {step("v3", "v2", "user")}
  FROM ({closed % "(SELECT m.conv_id, m.i, role, text, kind, more, alive, w0, w1, w2, w3 FROM walk JOIN marked m ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND m.i = walk.i - 1)"})
), best AS (
  SELECT conv_id, v0.c AS cost, v0.a AS audit, sha256(array_to_string(v0.s, chr(10))) AS repaired_sha256 FROM ({closed % "walk"}) WHERE i = 1
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT c.conv_id, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("gaps", *FAULTS, "illegal", "cost"))}, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE_SQL = _oracle_sql()
