"""Registered queries of the motif engine, each with its DuckDB SQL where SQL can say it.

Reads are whole texts of ``documents`` with every other character as A, or 32 bases made from each key of ``part``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.operators import collapsed, neighbours, patterns, planted, verify, walk
from strandmill.operators.incremental import SupportTable
from strandmill.plans.motif import MotifQuery, search_files
from strandmill.sources import reads as R

L, D = 5, 1
WORD, LONG_WORD = "ACGTA", "ACGTACGT"


def text_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("sid"), S.text_as_read(F.col("text")).alias("seq"))


def key_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.col("p_partkey").alias("sid"), planted.random_bases(F.col("p_partkey")).alias("seq"))


def _count(name: str):
    return F.count(F.lit(1)).alias(name)


def encode_reads(spark, sf_dir):
    return text_reads(spark, sf_dir)


def line_filter(spark, sf_dir):
    """Lines of all documents as reads, by document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("raw")).select("doc_id", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line"))
    rows = lines.where((F.col("line") != "") & ~F.col("line").startswith(">"))
    return rows.groupBy("doc_id").agg(_count("n_reads"), F.sum(F.length("line")).alias("n_bases"))


def header_parse(spark, sf_dir):
    rows = key_reads(spark, sf_dir)
    line = F.concat(F.col("sid").cast("string"), F.lit(" Motif "), F.substring("seq", 1, 8), F.lit(" planted as "), F.substring("seq", 9, 9), F.lit(" at position "), (F.col("sid") % 500).cast("string"))
    return R.headers(rows.select(F.lit("part").alias("file"), F.col("sid").alias("line_no"), line.alias("raw"))).select("line_no", "motif", "edited", "pos")


def kmer_counts(spark, sf_dir):
    return neighbours.kmers(text_reads(spark, sf_dir), L).groupBy("x").agg(_count("n"))


def kmer_distinct_reads(spark, sf_dir):
    return neighbours.own_words(neighbours.numbered(text_reads(spark, sf_dir)), L).groupBy("x").agg(_count("n_reads"))


def _edits(make):
    def query(spark, sf_dir):
        words = neighbours.kmers(key_reads(spark, sf_dir), 8).distinct()
        made = neighbours.edits(words.select("x").distinct(), make)
        return made.groupBy("w").agg(_count("n"), F.count_distinct("x").alias("n_words"))

    return query


def _neighbourhood(d):
    def query(spark, sf_dir):
        words = neighbours.kmers(key_reads(spark, sf_dir), L, d).select("x").distinct()
        return neighbours.neighbourhood(words, L, d).groupBy("w").agg(_count("n_words"))

    return query


def _exact(l, d, quorum, source, strategy="rows"):  # noqa: E741
    def query(spark, sf_dir):
        return MotifQuery(l, d, quorum, strategy).run(source(spark, sf_dir)).select("motif", "n_reads")

    return query


def _words12(spark, sf_dir):
    return neighbours.distinct_kmers(key_reads(spark, sf_dir), 12)


def pack_2bit(spark, sf_dir):
    return _words12(spark, sf_dir).select("x", S.pack(F.col("x")).alias("code"))


def unpack_2bit(spark, sf_dir):
    codes = _words12(spark, sf_dir).select(S.pack(F.col("x")).alias("code"))
    return codes.select("code", S.unpack(F.col("code"), F.lit(12)).alias("x"), S.two_bits(F.col("code"), F.lit(2)).alias("third_last"))


def wildcard_mask(spark, sf_dir):
    patterns = _words12(spark, sf_dir).select(F.translate("x", "T", "*").alias("pattern"))  # other words, other patterns
    return patterns.select("pattern", S.wildcard_mask(F.col("pattern")).alias("mask"))


def edit_distance(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


def distance_annotation(spark, sf_dir):
    found = MotifQuery(L, D, 0.2).run(key_reads(spark, sf_dir), WORD)
    return found.select("motif", F.coalesce(F.col("distance").cast("string"), F.lit("N/A")).alias("distance"))


def found_in_seq(spark, sf_dir):
    return walk.best_distances(key_reads(spark, sf_dir), [LONG_WORD], 2, every=True).select("sid", F.col("distance").isNotNull().alias("found"))


def _thirds(spark, sf_dir):
    words = neighbours.kmers(key_reads(spark, sf_dir), 6)
    return [words.where(F.col("sid") % 3 == i).select(F.col("x").alias("w")).distinct() for i in range(3)]


def intersect_sorted(spark, sf_dir):
    return neighbours.intersection(_thirds(spark, sf_dir)).orderBy("w")


def merge_union(spark, sf_dir):
    """All rows in two sets: even keys, and the rest with null keys."""
    words = neighbours.kmers(key_reads(spark, sf_dir), 6)
    even = F.coalesce(F.col("sid") % 2 == 0, F.lit(False))
    return neighbours.merged([words.where(part).select(F.col("x").alias("w")).distinct() for part in (even, ~even)]).orderBy("w")


def kway_merge(spark, sf_dir):
    return neighbours.merged(_thirds(spark, sf_dir)).orderBy("w")


def plan_enumeration(spark, sf_dir):
    """For each plan of (5, 2): how many substrings of all reads it applies to."""
    reads = key_reads(spark, sf_dir)
    rows = [F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("q", "deletions", "substitutions", "insertions"), p))) for p in neighbours.plans(L, 2)]
    plans = reads.select(F.length("seq").alias("n"), F.explode(F.array(*rows)).alias("p")).select("n", "p.*")
    return plans.groupBy("q", "deletions", "substitutions", "insertions").agg(F.sum(F.greatest(F.lit(0), F.col("n") - L - F.col("q") + 1)).cast("long").alias("n_words"))


def ems2p_candidates(spark, sf_dir):
    return collapsed.candidates(key_reads(spark, sf_dir), L, 1).groupBy("w").agg(_count("n_reads"))


def ems2p_fold(spark, sf_dir):
    """(5, 1) over all reads, in order of key."""
    return collapsed.folded(key_reads(spark, sf_dir), L, 1).select(F.col("w").alias("motif"))


def ems2p_groups(spark, sf_dir):
    """(5, 1) over the reads of each nation's customers, in order of key: all folds side by side."""
    reads = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").alias("sid"), planted.random_bases(F.col("c_custkey")).alias("seq"))
    return collapsed.folded(reads, L, 1, "nation").select(F.col("group").alias("nation"), F.col("w").alias("motif"))


def planted_generate(spark, sf_dir):
    """Keys are dealt before they grow: millions of them may stand in one split."""
    keys = neighbours.spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))
    return planted.planted(keys, F.col("p_partkey"), LONG_WORD, 1)


def planted_motifs(spark, sf_dir):
    """What planting leaves behind: motifs in at least 90 % of the planted reads."""
    reads = planted_generate(spark, sf_dir)
    return MotifQuery(8, 1, 0.9, "rows").run(reads, LONG_WORD)


def decode_motif(spark, sf_dir):
    """Codes of several kinds: brands and keys of all parts."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    code = F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))
    return parts.select("p_partkey", code.alias("code"), S.decoded(code).alias("motif"))


def mask_bits(spark, sf_dir):
    """The bits of wildcard masks, by place."""
    masks = wildcard_mask(spark, sf_dir).select("pattern", "mask", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("place"))
    return masks.select("pattern", F.col("place").cast("long").alias("place"), S.bit(F.col("mask"), F.col("place")).alias("bit"))


def _nation_files(spark, sf_dir):
    """Lines of files written from all customers, one file a nation: a header and a read for each, in order of key."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("nation"), "c_custkey", planted.random_bases(F.col("c_custkey")).alias("seq"))
    header = F.concat(F.lit("> "), F.col("c_custkey").cast("string"), F.lit(" Motif "), F.lower(F.substring("seq", 1, 8)), F.lit(" planted as "), F.substring("seq", 9, 9), F.lit(" at position 3. "))
    pair = F.concat(header, F.lit("\n "), F.translate(F.lower("seq"), "t", "u"), F.lit("\t\n"))
    path = R.shared_folder(spark, "nations")
    people.repartition("nation").sortWithinPartitions("nation", "c_custkey").select("nation", pair.alias("value")).write.partitionBy("nation").text(path)
    return R.lines(spark, path).withColumn("nation", F.regexp_extract("file", r"nation=(\d+)", 1).cast("long"))


def read_file(spark, sf_dir):
    """Reads of text files, numbered by line."""
    lines = _nation_files(spark, sf_dir)
    files = lines.select("file", "nation").distinct()
    return R.reads(lines).join(files, "file").select("nation", "sid", "seq")


def file_consensus(spark, sf_dir):
    lines = _nation_files(spark, sf_dir)
    return R.consensus(lines).join(lines.select("file", "nation").distinct(), "file").select("nation", "consensus")


def result_sink(spark, sf_dir):
    """Motifs of all key reads, written as lines and read again with their places."""
    path = R.shared_folder(spark, "motifs")
    R.write_motifs(MotifQuery(L, D, Decimal("0.2")).run(key_reads(spark, sf_dir), WORD), path)
    return R.lines(spark, path).select((F.col("line_no") + 1).cast("long").alias("place"), F.col("raw").alias("line"))


def verify_candidates(spark, sf_dir):
    """Long words (16, 3), made from the names of nations, in all key reads."""
    words = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.substring(planted.random_bases(F.col("n_name")), 1, 16).alias("w"))
    return verify.supports(words, key_reads(spark, sf_dir), 16, 3).withColumnRenamed("w", "motif")


def best_distance(spark, sf_dir):
    """Words of 10 bases, made from the names of nations, in all key reads: the least distance up to 3, and where it first ends."""
    words = [r.w for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.substring(planted.random_bases(F.col("n_name")), 1, 10).alias("w")).distinct().collect()]
    return walk.best_distances(key_reads(spark, sf_dir), words, 3)


def file_motifs(spark, sf_dir):
    """Motifs of the files of all nations at once, near half of a file's reads; a file's l is 4 or 5 and its d 0 or 1, as its name says."""
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey", planted.random_bases(F.col("c_custkey")).alias("seq"))
    header = F.concat(F.lit("> "), F.col("c_custkey").cast("string"), F.lit(" Motif "), F.substring("seq", 1, 5), F.lit(" planted as ACGT at position 3"))
    name = F.concat(F.lit("nation_"), "c_nationkey", F.lit("_l"), 4 + F.col("c_nationkey") % 2, F.lit("_d"), F.floor(F.col("c_nationkey") / 2).cast("int") % 2)
    path = R.shared_folder(spark, "named")
    rows = people.select(name.alias("set"), "c_custkey", F.concat(header, F.lit("\n"), "seq").alias("value"))
    rows.repartition("set").sortWithinPartitions("set", "c_custkey").select("set", "value").write.partitionBy("set").text(path)
    found = search_files(R.lines(spark, path), Decimal("0.5"))
    return found.select(F.regexp_extract("file", r"nation_(\d+)_", 1).cast("long").alias("nation"), "l", "d", "reads", "motif", "n_reads", "distance")


def pattern_neighbourhood(spark, sf_dir):
    """Patterns of one edit, from all substrings of 4 to 6 bases of the key reads, and of how many words each comes."""
    words = neighbours.kmers(key_reads(spark, sf_dir), L, 1).select("x").distinct()
    return patterns.neighbourhood(words, L, 1).groupBy(patterns.to_text(F.col("p")).alias("pattern")).agg(_count("n_words"))


def pattern_words(spark, sf_dir):
    """The words that patterns of two edits stand for: the rows of neighborhood_d2."""
    words = neighbours.kmers(key_reads(spark, sf_dir), L, 2).select("x").distinct()
    return patterns.expanded(patterns.neighbourhood(words, L, 2), L, "x").groupBy("w").agg(_count("n_words"))


def pattern_intersect(spark, sf_dir):
    """Words of 9 bases near reads of suppliers and near reads of nations, by the patterns of both."""
    of = lambda table, key: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("sid"), planted.random_bases(F.col(key)).alias("seq"))
    near = [patterns.neighbourhood(neighbours.kmers(of(*t), 9, 1).select("x").distinct(), 9, 1).select("p").distinct() for t in (("supplier", "s_suppkey"), ("nation", "n_name"))]
    return patterns.expanded(patterns.intersection(*near, 9, 1), 9)


def incremental_supports(spark, sf_dir):
    """Supports at (5, 1) of all key reads, which come in three batches; the second comes twice."""
    reads, table = key_reads(spark, sf_dir), SupportTable(spark, R.shared_folder(spark, "supports"), L, 1)
    part = F.coalesce(F.col("sid") % 3, F.lit(0))
    for batch in (1, 2, 2, 3):
        table.add(batch, reads.where(part == batch - 1))
    return table.supports().select(F.col("w").alias("motif"), "n_reads")


def queries() -> dict:
    return {
        "motif_quorum": _exact(L, 1, 0.9, text_reads, "auto"),
        "encode_reads": encode_reads, "line_filter": line_filter, "header_parse": header_parse,
        "kmer_counts": kmer_counts, "kmer_distinct_reads": kmer_distinct_reads,
        "edits_del": _edits(neighbours.deletions), "edits_sub": _edits(neighbours.substitutions), "edits_ins": _edits(neighbours.insertions),
        "neighborhood_d1": _neighbourhood(1), "neighborhood_d2": _neighbourhood(2),
        "motif_exact_d0": _exact(2, 0, 0.8, key_reads), "motif_exact_d1": _exact(3, 1, 1.0, key_reads), "motif_exact_d2": _exact(4, 2, 1.0, key_reads),
        "bitmap_motifs": _exact(L, 1, 0.2, key_reads, "bitmap"), "row_motifs": _exact(L, 1, 0.2, key_reads, "rows"),
        "pack_2bit": pack_2bit, "unpack_2bit": unpack_2bit, "wildcard_mask": wildcard_mask,
        "edit_distance": edit_distance, "distance_annotation": distance_annotation, "found_in_seq": found_in_seq,
        "intersect_sorted": intersect_sorted, "merge_union": merge_union, "kway_merge": kway_merge,
        "plan_enumeration": plan_enumeration, "ems2p_candidates": ems2p_candidates, "ems2p_fold": ems2p_fold, "ems2p_groups": ems2p_groups,
        "planted_generate": planted_generate, "planted_motifs": planted_motifs,
        "decode_motif": decode_motif, "mask_bits": mask_bits, "read_file": read_file, "file_consensus": file_consensus,
        "result_sink": result_sink, "verify_candidates": verify_candidates,
        "walk_motifs": _exact(L, 1, 0.2, key_reads, "walk"), "frontier_motifs": _exact(L, 2, Decimal("0.99"), key_reads, "walk"),
        "best_distance": best_distance, "file_motifs": file_motifs, "incremental_supports": incremental_supports,
        "pattern_neighbourhood": pattern_neighbourhood, "pattern_words": pattern_words, "pattern_intersect": pattern_intersect,
    }


_BASES = "(VALUES ('A'), ('C'), ('G'), ('T')) AS b(b)"
_TEXT = "SELECT doc_id AS sid, regexp_replace(translate(upper(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]', 'A', 'g'), ' ')), 'U', 'T'), '[^ACGT]', 'A', 'g') AS seq FROM documents"
_KEYS = "SELECT p_partkey AS sid, translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM part"


def _sql_kmers(reads: str, least: int, most: int) -> str:
    """CTEs reads and kmers(sid, x), repeats included."""
    return f"""WITH reads AS ({reads}),
kmers AS (SELECT sid, substr(seq, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS x
          FROM (SELECT sid, seq, k, unnest(range(1, length(seq) - k + 2)) AS i
                FROM (SELECT sid, seq, unnest(range({max(1, least)}, {most} + 1)) AS k FROM reads) WHERE length(seq) >= k))"""


def _sql_universe(l: int) -> str:  # noqa: E741
    return f"universe AS (SELECT {' || '.join(f'b{i}.b' for i in range(l))} AS w FROM " + ", ".join(f"(VALUES ('A'), ('C'), ('G'), ('T')) AS b{i}(b)" for i in range(l)) + ")"


def _sql_supports(l: int, d: int, reads: str) -> str:  # noqa: E741
    """CTE supports(w, n_reads) from the definition: all words compared with all substrings."""
    return f"""{_sql_kmers(reads, l - d, l + d)}, {_sql_universe(l)},
own AS (SELECT DISTINCT sid, x FROM kmers),
near AS (SELECT w, x FROM universe, (SELECT DISTINCT x FROM own) WHERE levenshtein(w, x) <= {d}),
supports AS (SELECT w, count(DISTINCT sid) AS n_reads FROM near JOIN own USING (x) GROUP BY w)"""


def _sql_exact(l: int, d: int, quorum: float, reads: str) -> str:  # noqa: E741
    return f"{_sql_supports(l, d, reads)} SELECT w AS motif, n_reads FROM supports WHERE n_reads >= ceil({quorum} * (SELECT count(*) FROM reads))"


_PARTS_OF = {
    "del": "SELECT x, substr(x, 1, i - 1) || substr(x, i + 1) AS w FROM words, range(1, 9) AS r(i)",
    "sub": f"SELECT x, substr(x, 1, i - 1) || b || substr(x, i + 1) AS w FROM words, range(1, 9) AS r(i), {_BASES}",
    "ins": f"SELECT x, substr(x, 1, i) || b || substr(x, i + 1) AS w FROM words, range(0, 9) AS r(i), {_BASES}",
}


def _sql_edits(kind: str) -> str:
    made = _PARTS_OF[kind].replace(", i - 1)", ", CAST(i AS INTEGER) - 1)").replace(", i + 1)", ", CAST(i AS INTEGER) + 1)").replace(", 1, i)", ", 1, CAST(i AS INTEGER))")
    return f"{_sql_kmers(_KEYS, 8, 8)}, words AS (SELECT DISTINCT x FROM kmers), made AS ({made}) SELECT w, count(*) AS n, count(DISTINCT x) AS n_words FROM made GROUP BY w"


def _sql_neighbourhood(d: int) -> str:
    return f"{_sql_kmers(_KEYS, L - d, L + d)}, {_sql_universe(L)}, words AS (SELECT DISTINCT x FROM kmers) SELECT w, count(*) AS n_words FROM universe, words WHERE levenshtein(w, x) <= {d} GROUP BY w"


_W12 = f"{_sql_kmers(_KEYS, 12, 12)}, words AS (SELECT DISTINCT x FROM kmers)"
_CODE = " + ".join(f"((instr('ACGT', substr(x, {i}, 1)) - 1)::BIGINT << {2 * (12 - i)})" for i in range(1, 13))
_SIX = f"{_sql_kmers(_KEYS, 6, 6)}, sets AS (SELECT DISTINCT sid % 3 AS part, x AS w FROM kmers)"


_COLLAPSED = f"""{_sql_kmers(_KEYS, L - 1, L + 1)},
made AS (SELECT sid, substr(x, 1, CAST(i AS INTEGER)) || 'A' || substr(x, CAST(i AS INTEGER) + 1) AS w FROM kmers, range(0, {L}) AS r(i) WHERE length(x) = {L - 1}
         UNION SELECT sid, substr(x, 1, CAST(i AS INTEGER) - 1) || 'A' || substr(x, CAST(i AS INTEGER) + 1) FROM kmers, range(1, {L} + 1) AS r(i) WHERE length(x) = {L}
         UNION SELECT sid, substr(x, 2) FROM kmers WHERE length(x) = {L + 1})"""

_FOLD = f"""{_COLLAPSED.replace("WITH", "WITH RECURSIVE", 1)},
sets AS (SELECT row_number() OVER (ORDER BY reads.sid) AS i, coalesce(ws, []) AS ws
         FROM reads LEFT JOIN (SELECT sid, list(w) AS ws FROM made GROUP BY sid) m ON m.sid = reads.sid),
fold(i, ws) AS (SELECT i, ws FROM sets WHERE i = 1 UNION ALL
                SELECT s.i, CASE WHEN len(list_intersect(f.ws, s.ws)) > 0 THEN list_intersect(f.ws, s.ws) ELSE f.ws END FROM fold f JOIN sets s ON s.i = f.i + 1)
SELECT unnest(ws) AS motif FROM fold WHERE i = (SELECT max(i) FROM sets)"""


_GROUPS = (
    _COLLAPSED.replace(_KEYS, "SELECT c_custkey AS sid, translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM customer").replace("WITH", "WITH RECURSIVE", 1)
    + """,
sets AS (SELECT c_nationkey::BIGINT AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, coalesce(ws, []) AS ws
         FROM customer LEFT JOIN (SELECT sid, list(w) AS ws FROM made GROUP BY sid) m ON m.sid = c_custkey),
fold(nation, i, ws) AS (SELECT nation, i, ws FROM sets WHERE i = 1 UNION ALL
                SELECT s.nation, s.i, CASE WHEN len(list_intersect(f.ws, s.ws)) > 0 THEN list_intersect(f.ws, s.ws) ELSE f.ws END FROM fold f JOIN sets s ON s.nation = f.nation AND s.i = f.i + 1)
SELECT nation, unnest(ws) AS motif FROM (SELECT *, max(i) OVER (PARTITION BY nation) AS last FROM fold) WHERE i = last"""
)


def _sql_draw(name: str, below: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST(sid AS VARCHAR) || '{name}'), 1, 8))::BIGINT % greatest({below}, 1) AS INTEGER)"


#: One edit: a deletion, or an insertion, or a substitution by another base.
_PLANTED = f"""reads0 AS ({_KEYS}),
drawn AS (SELECT sid, seq, {_sql_draw("deletions", "2")} AS del, {_sql_draw("s0", "3")} AS s0, {_sql_draw("i0", "4")} AS i0 FROM reads0),
kinds AS (SELECT *, CASE WHEN del = 1 THEN 0 ELSE {_sql_draw("insertions", "2 - del")} END AS ins FROM drawn),
placed AS (SELECT *, {_sql_draw("at0", "8 + ins")} AS p FROM kinds),
changed AS (SELECT sid, seq, CASE WHEN del = 1 THEN substr('{LONG_WORD}', 1, p) || substr('{LONG_WORD}', p + 2)
                 WHEN ins = 1 THEN substr('{LONG_WORD}', 1, p) || substr('ACGT', i0 + 1, 1) || substr('{LONG_WORD}', p + 1)
                 ELSE substr('{LONG_WORD}', 1, p) || substr('ACGT', (instr('ACGT', substr('{LONG_WORD}', p + 1, 1)) + s0) % 4 + 1, 1) || substr('{LONG_WORD}', p + 2) END AS edited FROM placed),
planted AS (SELECT sid, edited, CAST({_sql_draw("pos", "32 - length(edited) + 1")} AS BIGINT) AS pos, seq FROM changed)"""
_PLANTED_READS = "SELECT sid, edited, pos, substr(seq, 1, pos::INTEGER) || edited || substr(seq, pos::INTEGER + length(edited)::INTEGER + 1) AS seq FROM planted"
_PLANTED_MOTIFS = f"""WITH {_PLANTED}, reads AS ({_PLANTED_READS}),
own AS (SELECT DISTINCT sid, substr(seq, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS x FROM reads, range(7, 10) AS r(k), range(1, 33) AS s(i) WHERE i + k <= 33),
made AS (SELECT sid, substr(x, 1, CAST(i AS INTEGER) - 1) || substr(x, CAST(i AS INTEGER) + 1) AS w FROM own, range(1, 10) AS r(i) WHERE length(x) = 9
         UNION SELECT sid, substr(x, 1, CAST(i AS INTEGER) - 1) || b || substr(x, CAST(i AS INTEGER) + 1) FROM own, range(1, 9) AS r(i), {_BASES} WHERE length(x) = 8
         UNION SELECT sid, substr(x, 1, CAST(i AS INTEGER)) || b || substr(x, CAST(i AS INTEGER) + 1) FROM own, range(0, 8) AS r(i), {_BASES} WHERE length(x) = 7)
SELECT w AS motif, count(*) AS n_reads, CAST(levenshtein(w, '{LONG_WORD}') AS BIGINT) AS distance FROM made GROUP BY w HAVING count(*) >= ceil(0.9 * (SELECT count(*) FROM reads))"""

_PEOPLE = "people AS (SELECT c_nationkey::BIGINT AS nation, c_custkey, translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer)"


_FILES = f"""WITH {_PEOPLE}, own AS (SELECT nation, seq, i, CAST(4 + nation % 2 AS INTEGER) AS l, CAST((nation // 2) % 2 AS INTEGER) AS d FROM people),
kmers AS (SELECT DISTINCT nation, i, l, d, substr(seq, CAST(s AS INTEGER), CAST(k AS INTEGER)) AS x FROM own, range(3, 7) AS r(k), range(1, 33) AS q(s) WHERE s + k <= 33 AND k BETWEEN l - d AND l + d),
universe AS (SELECT unnest([w, substr(w, 1, 4)]) AS w FROM (SELECT b0.b || b1.b || b2.b || b3.b || b4.b AS w FROM {", ".join(f"(VALUES ('A'), ('C'), ('G'), ('T')) AS b{i}(b)" for i in range(5))})),
near AS (SELECT w, x, l, d FROM (SELECT DISTINCT w FROM universe), (SELECT DISTINCT x, l, d FROM kmers) WHERE length(w) = l AND levenshtein(w, x) <= d),
totals AS (SELECT nation, count(*) AS reads, max(CASE WHEN i = 1 THEN substr(seq, 1, 5) END) AS consensus FROM own GROUP BY nation)
SELECT nation, l, d, reads, w AS motif, count(DISTINCT i) AS n_reads, CASE WHEN any_value(length(consensus)) = l THEN levenshtein(w, any_value(consensus)) END AS distance
FROM kmers JOIN near USING (x, l, d) JOIN totals USING (nation) GROUP BY nation, l, d, reads, w HAVING count(DISTINCT i) >= ceil(0.5 * reads)"""

_BEST = f"""WITH reads AS ({_KEYS}), words AS (SELECT DISTINCT substr(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 10) AS word FROM nation),
subs AS (SELECT sid, i + k - 1 AS "end", substr(seq, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS x FROM reads, range(7, 14) AS r(k), range(1, 33) AS q(i) WHERE i + k <= 33),
found AS (SELECT sid, word, levenshtein(word, x) AS distance, "end" FROM subs, words WHERE levenshtein(word, x) <= 3)
SELECT sid, word, CAST(distance AS BIGINT) AS distance, "end" FROM found QUALIFY row_number() OVER (PARTITION BY sid, word ORDER BY distance, "end") = 1"""

_ONE_EDIT = """SELECT x, substr(x, 1, CAST(i AS INTEGER) - 1) || substr(x, CAST(i AS INTEGER) + 1) AS p FROM words, range(1, 20) AS r(i) WHERE length(x) = {l} + 1 AND i <= length(x)
UNION SELECT x, substr(x, 1, CAST(i AS INTEGER) - 1) || '*' || substr(x, CAST(i AS INTEGER) + 1) FROM words, range(1, 20) AS r(i) WHERE length(x) = {l} AND i <= length(x)
UNION SELECT x, substr(x, 1, CAST(i AS INTEGER)) || '*' || substr(x, CAST(i AS INTEGER) + 1) FROM words, range(0, 20) AS r(i) WHERE length(x) = {l} - 1 AND i <= length(x)"""
_PATTERNS = f"{_sql_kmers(_KEYS, L - 1, L + 1)}, words AS (SELECT DISTINCT x FROM kmers), made AS ({_ONE_EDIT.format(l=L)}) SELECT p AS pattern, count(*) AS n_words FROM made GROUP BY p"


def _sql_near9(table: str, key: str) -> str:
    reads = f"SELECT {key} AS sid, translate(md5(CAST({key} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM {table}"
    return f"({_sql_kmers(reads, 8, 10)}, words AS (SELECT DISTINCT x FROM kmers), made AS ({_ONE_EDIT.format(l=9)}) SELECT DISTINCT replace(p, '*', b) AS w FROM made, {_BASES})"


def oracle_sql() -> dict[str, str]:
    return {
        "motif_quorum": _sql_exact(L, 1, 0.9, _TEXT),
        "encode_reads": _TEXT,
        "line_filter": "SELECT doc_id, count(*) AS n_reads, CAST(sum(length(line)) AS BIGINT) AS n_bases FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[ \\t\\x0B\\f\\r]+|[ \\t\\x0B\\f\\r]+$', '', 'g') AS line FROM documents) WHERE line <> '' AND NOT starts_with(line, '>') GROUP BY doc_id",
        "header_parse": f"WITH reads AS ({_KEYS}), h AS (SELECT sid, CAST(sid AS VARCHAR) || ' Motif ' || substr(seq, 1, 8) || ' planted as ' || substr(seq, 9, 9) || ' at position ' || CAST(sid % 500 AS VARCHAR) AS raw FROM reads) SELECT sid AS line_no, regexp_extract(raw, 'Motif ([ACGT]+) planted', 1) AS motif, regexp_extract(raw, 'as ([ACGT]+) at', 1) AS edited, CAST(regexp_extract(raw, 'position ([0-9]+)', 1) AS BIGINT) AS pos FROM h",
        "kmer_counts": f"{_sql_kmers(_TEXT, L, L)} SELECT x, count(*) AS n FROM kmers GROUP BY x",
        "kmer_distinct_reads": f"{_sql_kmers(_TEXT, L, L)} SELECT x, count(DISTINCT sid) AS n_reads FROM kmers GROUP BY x",
        "edits_del": _sql_edits("del"), "edits_sub": _sql_edits("sub"), "edits_ins": _sql_edits("ins"),
        "neighborhood_d1": _sql_neighbourhood(1), "neighborhood_d2": _sql_neighbourhood(2),
        "motif_exact_d0": _sql_exact(2, 0, 0.8, _KEYS), "motif_exact_d1": _sql_exact(3, 1, 1.0, _KEYS), "motif_exact_d2": _sql_exact(4, 2, 1.0, _KEYS),
        "bitmap_motifs": _sql_exact(L, 1, 0.2, _KEYS), "row_motifs": _sql_exact(L, 1, 0.2, _KEYS),
        "pack_2bit": f"{_W12} SELECT x, {_CODE} AS code FROM words",
        "unpack_2bit": f"{_W12} SELECT {_CODE} AS code, x, CAST(instr('ACGT', substr(x, 10, 1)) - 1 AS BIGINT) AS third_last FROM words",
        "wildcard_mask": f"{_W12}, p AS (SELECT DISTINCT translate(x, 'T', '*') AS pattern FROM words) SELECT pattern, " + " + ".join(f"(CASE WHEN substr(pattern, {i}, 1) = '*' THEN {1 << (12 - i)} ELSE 0 END)::BIGINT" for i in range(1, 13)) + " AS mask FROM p",
        "edit_distance": "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS BIGINT) AS distance FROM part",
        "distance_annotation": f"{_sql_supports(L, D, _KEYS)} SELECT w AS motif, CAST(levenshtein(w, '{WORD}') AS VARCHAR) AS distance FROM supports WHERE n_reads >= ceil(0.2 * (SELECT count(*) FROM reads))",
        "found_in_seq": f"{_sql_kmers(_KEYS, 6, 10)} SELECT sid, bool_or(levenshtein(x, '{LONG_WORD}') <= 2) AS found FROM kmers GROUP BY sid",
        "intersect_sorted": f"{_SIX} SELECT w FROM sets WHERE part = 0 INTERSECT SELECT w FROM sets WHERE part = 1 INTERSECT SELECT w FROM sets WHERE part = 2",
        "merge_union": f"{_SIX} SELECT w FROM sets WHERE part < 2 UNION SELECT w FROM sets WHERE part = 2",
        "kway_merge": f"{_SIX} SELECT DISTINCT w FROM sets",
        "ems2p_candidates": f"{_COLLAPSED} SELECT w, count(DISTINCT sid) AS n_reads FROM made GROUP BY w",
        "ems2p_fold": _FOLD, "ems2p_groups": _GROUPS,
        "planted_generate": f"WITH {_PLANTED} {_PLANTED_READS}",
        "planted_motifs": _PLANTED_MOTIFS,
        "decode_motif": "SELECT p_partkey, code, array_to_string(list_transform(string_split(code, ''), lambda c: CASE WHEN c IN ('0', '1', '2', '3') THEN substr('ACGT', c::INTEGER + 1, 1) WHEN c IN ('5', '6', '7', '8', '9') THEN '?' ELSE '*' END), '') AS motif FROM (SELECT p_partkey, p_brand || '-' || p_partkey AS code FROM part)",
        "mask_bits": f"{_W12}, p AS (SELECT DISTINCT translate(x, 'T', '*') AS pattern FROM words) SELECT pattern, i AS place, CASE WHEN substr(pattern, 12 - CAST(i AS INTEGER), 1) = '*' THEN 1 ELSE 0 END::BIGINT AS bit FROM p, range(0, 12) AS r(i)",
        "read_file": f"WITH {_PEOPLE} SELECT nation, 3 * i - 2 AS sid, seq FROM people",
        "file_consensus": f"WITH {_PEOPLE} SELECT nation, substr(seq, 1, 8) AS consensus FROM people WHERE i = 1",
        "result_sink": f"{_sql_supports(L, D, _KEYS)} SELECT row_number() OVER (ORDER BY w) AS place, w || chr(9) || 'Distance: ' || levenshtein(w, '{WORD}') AS line FROM supports WHERE n_reads >= ceil(0.2 * (SELECT count(*) FROM reads))",
        "verify_candidates": f"{_sql_kmers(_KEYS, 13, 19)}, words AS (SELECT DISTINCT substr(translate(md5(n_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 16) AS w FROM nation) SELECT w AS motif, count(DISTINCT sid) AS n_reads FROM words, kmers WHERE levenshtein(w, x) <= 3 GROUP BY w",
        "walk_motifs": _sql_exact(L, 1, 0.2, _KEYS), "frontier_motifs": _sql_exact(L, 2, 0.99, _KEYS),
        "best_distance": _BEST, "file_motifs": _FILES,
        "incremental_supports": f"{_sql_supports(L, 1, _KEYS)} SELECT w AS motif, n_reads FROM supports",
        "pattern_neighbourhood": _PATTERNS, "pattern_words": _sql_neighbourhood(2),
        "pattern_intersect": f"SELECT w FROM {_sql_near9('supplier', 's_suppkey')} INTERSECT SELECT w FROM {_sql_near9('nation', 'n_name')}",
        "plan_enumeration": f"WITH reads AS ({_KEYS}), plans AS (SELECT q, p AS deletions, 2 - 2 * p + q AS substitutions, p - q AS insertions FROM range(-2, 3) AS r(q), range(0, 3) AS s(p) WHERE p >= greatest(0, q) AND 2 * p <= 2 + q) SELECT q, deletions, substitutions, insertions, CAST(sum(greatest(0, length(seq) - {L} - q + 1)) AS BIGINT) AS n_words FROM plans, reads GROUP BY ALL",
    }
