"""Chat formatting over reply trees.

Messages are nodes of trees (tree, node, parent). Self-joins that double the reach of each step give every node's
depth and the sum of scores up to its root in log2(depth of the deepest tree) rounds; nodes that reached it leave the
rounds. Ways that end in a leaf are branches, ranked by the mean score of their messages.

Only chosen branches are written out as paths: the same steps, taken from the longest to the shortest, halve each
branch until every part is one node. So no node ever carries its path, and a chain of n messages takes n log n small
rows, not n * n / 2. The rounds carry node numbers only; texts are joined once, to the chosen branches.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles and texts a backslash becomes
``\\b``, each control string gets ``\\-`` after its first character, and a line break inside a role becomes
``\\n``: every backslash of the output starts one of these marks, no control string is left inside, and
reading back is exact. The loss mask is a list of spans (in characters) over the texts of assistant turns.

Defined cases: null text is empty; null role is empty and has no loss; a null score counts as 0; equal
scores prefer the smaller leaf; rows with null tree are one tree of their own; rows with null node are left out, as
nothing can name them (``chain`` numbers all rows, so none has a null node there); a node whose parent is null or
missing is a root; nodes on a cycle of parents have no root and are left out; repeated rows of one turn stay, ordered
by role and text; an empty table gives no rows; a text of any length is one value of one row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: First characters of strings that models of several families read as control.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), CONTROL, r"$1\\-")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\-"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def chain(messages: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as trees: each message answers the one before it."""
    order = Window.partitionBy(tree).orderBy(F.col(turn).asc_nulls_last(), F.col("role"), F.col("text"))
    node = F.row_number().over(order).cast("long")
    own = messages.select(F.col(tree).alias("tree"), node.alias("node"), "role", "text")
    return own.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, at, node): the nodes of the ``top`` best branches of each tree; ``at`` counts from the root."""
    ids = nodes.where("node IS NOT NULL").select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = ids.select("tree", F.col("node").alias("parent")).distinct().withColumn("known", F.lit(True))
    up = F.when(F.col("known"), F.col("parent")).alias("up")
    ways = common.stored(ids.join(known, ["tree", "parent"], "left").select("tree", "node", up, "score", F.lit(1).cast("long").alias("n")), "ways")
    most = ways.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    done, going, steps = ways.where("up IS NULL"), ways.where("up IS NOT NULL"), []
    while not going.isEmpty():
        steps.append(going.select("tree", "node", "up"))
        if 1 << (len(steps) - 1) >= most:  # only nodes above a cycle are left
            break
        upper = done.unionByName(going).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("n").alias("n2"))
        ways = going.join(upper, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("n") + F.col("n2")).alias("n"))
        ways = common.stored(ways, "ways")
        done, going = done.unionByName(ways.where("up IS NULL")), ways.where("up IS NOT NULL")
    inner = ids.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = done.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("n")).alias("score"), "n")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    parts = leaves.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("node", F.col("leaf")).withColumn("last", F.col("n") - 1)
    for k in reversed(range(len(steps))):  # a part of n nodes, the lowest at place ``last``
        reach = F.lit(1 << k)
        parts = common.stored(parts, "parts")
        long = parts.where(F.col("n") > reach)
        far = long.join(steps[k], ["tree", "node"]).withColumn("node", F.col("up")).withColumn("last", F.col("last") - reach).withColumn("n", F.col("n") - reach)
        parts = parts.withColumn("n", F.least("n", reach)).unionByName(far.select(*parts.columns))
    return parts.select("tree", "leaf", "rank", "score", F.col("last").alias("at"), "node")


def format_branches(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss_spans): one row per chosen branch."""
    turns = chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), role, F.lit("\n"))).withColumn("body", escape(F.coalesce("text", F.lit(""))))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(CLOSE)))
    before = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    rows = F.array_sort(F.collect_list(F.struct("at", "turn", span.alias("span"))))
    whole = turns.groupBy("tree", "leaf", "rank", "score").agg(rows.alias("rows"))
    spans = F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull())
    return whole.select("tree", "leaf", "rank", "score", F.array_join(F.transform("rows", lambda r: r["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(nodes: DataFrame, top: int = 1) -> DataFrame:
    # In a struct, null trees are equal to each other and can be joined.
    nodes = common.stored(nodes.select(F.struct("tree").alias("tree"), "node", "parent", "role", "text", "score"), "nodes")
    return format_branches(nodes, branches(nodes, top)).withColumn("tree", F.col("tree.tree"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        cut = F.locate("\n", inner)
        role = F.replace(F.substring(inner, F.lit(1), cut - 1), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def _read_back(formatted: DataFrame) -> DataFrame:
    """With turns, their texts as one (``said``) and the text under the loss mask, all read from the output."""
    out = formatted.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    return out.withColumn("said", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(PROBE).alias("text"))
    return _read_back(format_chats(chain(talks.unionByName(probe)))).select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def reply_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best branches of each conversation as a tree in which its i-th message answers the one at i div 2.

    The tables hold linear conversations only; this rule gives each a branch for every other message. A message's score is
    its length, so branches are ranked by their mean length.
    """
    talks = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    parent, length = F.when(F.col("node") > 1, F.floor(F.col("node") / 2)), F.length(F.coalesce("text", F.lit("")))
    nodes = chain(talks).withColumn("parent", parent).withColumn("score", length.cast("double"))
    return _read_back(format_chats(nodes, top=2)).select(
        F.col("tree").alias("conv_id"), F.col("rank").cast("long").alias("branch"), "leaf", "score", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
    )


BRANCHES_SQL = """
WITH RECURSIVE nodes AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS node
  FROM conversations
), walk AS (
  SELECT conv_id, node AS leaf, node FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM nodes) WHERE 2 * node > n
  UNION ALL SELECT conv_id, leaf, node // 2 FROM walk WHERE node > 1
), branches AS (
  SELECT w.conv_id, w.leaf, CAST(sum(length(text)) AS DOUBLE) / count(*) AS score, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY w.node)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars
  FROM walk w JOIN nodes m ON w.node = m.node AND w.conv_id IS NOT DISTINCT FROM m.conv_id
  GROUP BY w.conv_id, w.leaf
)
SELECT conv_id, branch, leaf, score, n_turns, turns_sha256, loss_chars
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, leaf) AS branch FROM branches) WHERE branch <= 2
"""
