"""Benchmark decontamination: a prefix-filtered join of documents with benchmark windows, in DataFrame functions.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A window is ``WINDOW``
consecutive words of an item; a shorter item is one window. Containment must be whole, so the prefix that a
window has to share with a document is its rarest token; rarity is counted over all documents. Every word of a
document that is some window's rarest token gives a candidate place; places that do not fit between the
document's ends, or whose first or last word differs, fall away; the rest is compared word by word.

Texts stay where they are read: words are exploded, probed against the broadcast windows and compared in one
stage, and only places of occurrences are shuffled. The windows are broadcast while they are under
``broadcast_bytes``; larger benchmarks are joined by shuffling the words that begin some prefix, frequent ones dealt
over several tasks, and the places that fit are then compared with the document's words. Other words are dropped before
they move, by a broadcast of the prefix tokens while these are under ``broadcast_bytes``; beyond that all words move.

Defined cases: null and empty texts have no words and no hits; items without words have no window; equal windows
of several items count for each item; repeated rows give repeated rows; rows of one id with different texts are
judged each by its own text; empty tables give no hits or no rows; a text of any length is one row, read whole; other
columns are ignored, and pass through ``clean``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import common

WINDOW, BROADCAST_BYTES = 10, 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, items): distinct windows and the ids of the items that have them."""
    own = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    cut = own.select("item", F.explode(F.transform(starts, lambda s: F.slice("words", s, width))).alias("window"))
    return cut.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def with_prefix(found: DataFrame, docs: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(window, items, token, lead), each window's rarest token over all documents and its place; and (token, n).

    Windows with a token that no document has are left out: they cannot occur.
    """
    vocabulary = found.select(F.explode("window").alias("token")).distinct()
    spoken = docs.select(F.explode(words(F.col(text_col))).alias("token"))
    if _fits(vocabulary, broadcast_bytes):
        spoken = spoken.join(F.broadcast(vocabulary), "token", "left_semi")
    counts = common.stored(spoken.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token_counts")
    tokens = found.select("window", "items", F.posexplode("window").alias("lead", "token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "lead", "token")).alias("rarest")
    return tokens.groupBy("window", "items").agg(rarest).where("rarest.n > 0").select("window", "items", "rarest.token", "rarest.lead"), counts


def _fits(df: DataFrame, limit: int) -> bool:
    """Whether the rows, as text with 64 bytes each for themselves, are under the limit."""
    width = sum((F.size(c) * 8 + F.octet_length(F.concat_ws(" ", F.col(c).cast("array<string>"))) if t.startswith("array") else F.octet_length(F.col(c).cast("string")) for c, t in df.dtypes), F.lit(64))
    return (df.agg(F.sum(width)).first()[0] or 0) <= limit


def beginning(spoken: DataFrame, probes: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``spoken`` whose token is some window's rarest; all rows where those tokens are too many to broadcast."""
    tokens = common.stored(probes.select("token").distinct(), "prefix_tokens")
    return spoken.join(F.broadcast(tokens), "token", "left_semi") if _fits(tokens, broadcast_bytes) else spoken


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc, n_words, spans, items), a row for each input row.

    ``spans`` are (start, length) of the words of every occurrence, ``items`` the ids that occur.
    """
    probes, counts = with_prefix(common.stored(windows(items, "item_id", "text", width), "windows"), docs, text_col, broadcast_bytes)
    probes = common.stored(probes, "probes")
    small = _fits(probes, broadcast_bytes)
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), words(text).alias("words"))
    keys = ["doc", "h1", "h2", "n_words"]
    own = own.withColumn("n_words", F.size("words"))
    nothing = docs.sparkSession.range(1).select(F.lit(None).cast(probes.schema["window"].dataType).alias("window"), F.lit(None).cast(probes.schema["items"].dataType).alias("items"), F.lit("").alias("token"), F.lit(0).alias("lead"))
    start = F.col("at") - F.col("lead")
    fits = (start >= 0) & (start + F.size("window") <= F.col("n_words"))
    ends = (F.get("words", start) == F.get("window", F.lit(0))) & (F.get("words", start + F.size("window") - 1) == F.get("window", F.size("window") - 1))
    same = F.slice("words", start + 1, F.size("window")) == F.col("window")
    span = F.when(F.col("window").isNotNull(), F.struct(start.alias("start"), F.size("window").alias("length")))
    if small:
        # The empty token after the last word meets the empty probe: every row gets through, with or without hits.
        spoken = own.select(*keys, "words", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("at", "token"))
        met = spoken.join(F.broadcast(probes.unionByName(nothing)), "token").where(F.col("window").isNull() | (fits & ends & same))
        met = met.select(*keys, span.alias("span"), "items")
    else:
        spoken = beginning(own.select(*keys, F.posexplode("words").alias("at", "token")), probes, broadcast_bytes)
        places = common.spread_join(spoken, probes, "token", counts).where(fits).select(*keys, start.alias("start"), "window", "items")
        again = own.select("doc", "h1", "h2", "words").dropDuplicates(["doc", "h1", "h2"])
        joined = places.alias("p").join(again.alias("d"), F.col("p.doc").eqNullSafe(F.col("d.doc")) & (F.col("p.h1") == F.col("d.h1")) & (F.col("p.h2") == F.col("d.h2")))
        size = F.size("p.window")
        met = joined.where(F.slice("d.words", F.col("p.start") + 1, size) == F.col("p.window"))
        met = met.select(*(F.col(f"p.{k}") for k in keys), F.struct(F.col("p.start").alias("start"), size.alias("length")).alias("span"), F.col("p.items").alias("items"))
        nowhere = (F.lit(None).cast(met.schema[c].dataType).alias(c) for c in ("span", "items"))
        met = met.unionByName(own.select(*keys, *nowhere))
    found = met.groupBy(*keys).agg(
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.count_if(F.col("span").isNull()).alias("rows"),
    )
    return found.select("doc", "h1", "h2", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).drop("col")


def n_hit(spans: Column) -> Column:
    """Words covered by at least one of the sorted spans."""
    state = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))

    def step(so_far: Column, s: Column) -> Column:
        end = F.greatest(so_far["end"], (s["start"] + s["length"]).cast("long"))
        return F.struct((so_far["hit"] + end - F.greatest(so_far["end"], F.least(end, s["start"].cast("long")))).alias("hit"), end.alias("end"))

    return F.aggregate(spans, state, step, lambda last: last["hit"])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window occurs; columns stay."""
    found = occurrences(docs, items, id_col, text_col, broadcast_bytes=broadcast_bytes).where(F.size("spans") > 0)
    hit = common.fresh(docs.columns, "hit")
    bad = common.stored(found.select(F.struct("doc", "h1", "h2").alias(hit)).distinct(), "contaminated")
    if bad.count() * 64 <= broadcast_bytes:
        bad = F.broadcast(bad)
    text = F.col(text_col)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(f"{hit}.doc")) & (F.xxhash64(text) == F.col(f"{hit}.h1")) & (F.xxhash64(F.lit(1), text) == F.col(f"{hit}.h2"))
    return docs.join(bad, same, "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    hit = n_hit(F.col("spans"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS win, least(len(w), {WINDOW}) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""
