"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line (trimmed) counts once for each page that contains it; its pages divided
by the host's pages is its share. Lines whose share is over ``ratio`` are boilerplate of that host and are
taken out of its pages; the other lines stay as they are.

A line must be on two pages at least: on a host of under 1 / ``ratio`` pages one page alone is over the ratio, and a
line that is not repeated is no boilerplate.

Only keys of lines are shuffled, in counts that are added up before the shuffle; texts stay where they were
read. A host has at most (its lines per page / ratio) boilerplate lines, so their keys fit in one array per
host; the arrays are broadcast while their total is under ``broadcast_bytes`` and joined by host otherwise, with the
pages of large hosts dealt over several tasks.

Defined cases: null hosts form one host of their own; a null text stays null and an empty one empty, both
count as pages; blank lines are never taken out; a host of one page keeps it all; repeated rows are pages each; an
empty table gives no rows; a text of any length is one page and stays where it was read; other columns pass through
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import common

RATIO, MIN_PAGES, BROADCAST_BYTES = 0.1, 2, 32 << 20


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _key(line: Column) -> Column:
    """128 bits of the trimmed line, as text."""
    trimmed = F.trim(line)
    return F.concat(F.hex(F.xxhash64(trimmed)), F.lit("-"), F.hex(F.xxhash64(F.lit("line"), trimmed)))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys, n_pages): the keys of each host's boilerplate lines, for hosts that have any."""
    own = pages.select(host.alias("host"), text.alias("text"))
    totals = own.groupBy(F.col("host").alias("site")).agg(F.count(F.lit(1)).alias("n_pages"))
    lines = F.array_distinct(F.transform(F.split("text", "\n", -1), F.trim))
    keys = own.select("host", F.explode(lines).alias("line")).where("line <> ''").select("host", _key(F.col("line")).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    frequent = counts.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > ratio * F.col("n_pages"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.first("n_pages").alias("n_pages"))


def drop_boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with the boilerplate lines taken out of ``text_col``; rows, columns and their order stay."""
    found = common.stored(boilerplate(pages, host, F.col(text_col), ratio, min_pages), "boilerplate")
    size = found.agg(F.sum(F.size("keys") * 40 + 60)).first()[0] or 0
    site, held = (common.fresh(pages.columns, c) for c in ("site", "boilerplate"))
    key = lambda h: F.coalesce(F.concat(F.lit("="), h.cast("string")), F.lit("")).alias(site)
    found = found.select(key(F.col("host")), F.col("keys").alias(held))
    sited = pages.withColumn(site, key(host))
    if size <= broadcast_bytes:
        joined = sited.join(F.broadcast(found), site, "left")
    else:
        joined = common.spread_join(sited, found, site, sited.groupBy(site).agg(F.count(F.lit(1)).alias("n")), "left")
    keys = F.col(held)
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda line: ~F.array_contains(keys, _key(line))), "\n")
    return joined.withColumn(text_col, F.when(keys.isNull(), F.col(text_col)).otherwise(kept)).select(*(F.col(f"`{c}`") for c in pages.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = F.size(F.split("text", "\n", -1)).cast("long")
    cleaned = drop_boilerplate(docs.withColumn("n_lines", before), F.col("source"))
    kept = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    return cleaned.select("doc_id", "n_lines", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), kept.cast("long").alias("n_kept"))


def page_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on raw web pages: hosts from their addresses, lines being what stands between tags."""
    pages = common.table(spark, sf_dir, "pages")
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    cleaned = drop_boilerplate(pages.withColumn("before", F.col("text")), F.col("host"))
    n_lines = lambda c: F.size(F.filter(F.split(c, "\n", -1), lambda line: F.trim(line) != "")).cast("long")
    return cleaned.select("page_id", "host", n_lines("before").alias("n_lines"), n_lines("text").alias("n_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH host_pages AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
lines AS (SELECT DISTINCT doc_id, source, trim(line, ' ') AS line
          FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)),
bad AS (SELECT l.source, l.line FROM lines l JOIN host_pages h ON h.source = l.source
        WHERE l.line <> '' GROUP BY l.source, l.line, h.n_pages
        HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * h.n_pages),
sites AS (SELECT source, list(line) AS bad_lines FROM bad GROUP BY source),
cleaned AS (SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines,
                   CASE WHEN s.bad_lines IS NULL THEN d.text
                        ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(s.bad_lines, trim(x, ' '))), chr(10)) END AS text
            FROM documents d LEFT JOIN sites s ON s.source = d.source)
SELECT doc_id, n_lines, length(text)::BIGINT AS kept_chars, sha256(text) AS kept_sha256,
       CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_kept
FROM cleaned
"""

PAGES_SQL = f"""
WITH rows AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
                     string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)) AS lines FROM pages),
host_pages AS (SELECT host, count(*) AS n_pages FROM rows GROUP BY host),
each AS (SELECT r.host, unnest(list_distinct(list_transform(r.lines, lambda x: trim(x, ' ')))) AS line FROM rows r),
bad AS (SELECT e.host, e.line FROM each e JOIN host_pages h ON h.host IS NOT DISTINCT FROM e.host
        WHERE e.line <> '' GROUP BY e.host, e.line, h.n_pages
        HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * h.n_pages),
sites AS (SELECT host, list(line) AS bad_lines FROM bad GROUP BY host),
cleaned AS (SELECT r.page_id, r.host, r.lines,
                   list_filter(r.lines, lambda x: NOT coalesce(list_contains(s.bad_lines, trim(x, ' ')), false)) AS kept
            FROM rows r LEFT JOIN sites s ON s.host IS NOT DISTINCT FROM r.host)
SELECT page_id, host, len(list_filter(lines, lambda x: trim(x, ' ') <> ''))::BIGINT AS n_lines,
       len(list_filter(kept, lambda x: trim(x, ' ') <> ''))::BIGINT AS n_kept,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM cleaned
"""
