"""Packing: Karmarkar-Karp multiway differencing into windows of a fixed capacity.

Each document becomes ids plus one end id. Whole windows are cut off first; what remains is cut into parts
of at most ``part`` ids. A task gathers parts until they fill ``group_windows`` windows, then deals them
into k = ceil(ids / capacity) windows: every part starts as a partial partition of its own, and the two
partial partitions of widest spread are merged again and again, the fullest windows of one meeting the
emptiest of the other. If a window exceeds the capacity, k rises and the group is dealt anew.

Groups never leave their task, so nothing is shuffled, a task holds one group at a time, and a task that
runs again after an executor is lost gives the same pieces and the same sequence ids.

Defined cases: a null text counts as empty and is packed as its end id alone; repeated rows are packed each
for itself; an empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import common
from strandmill.llm.tokens import BYTE_BPE_50K, encoder

END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Deal items into k windows by multiway differencing; gives the windows' sums and their items."""
    follower = np.full(len(sizes), -1)
    heap = []
    for item, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        first = np.full(k, -1)
        last = np.full(k, -1)
        sums[0], first[0], last[0] = size, item, item
        heap.append((-size if k > 1 else 0, item, sums, first, last))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, a_first, a_last = heapq.heappop(heap)
        _, _, b, b_first, b_last = heapq.heappop(heap)
        b, b_first, b_last = b[::-1], b_first[::-1], b_last[::-1]  # opposing imbalances meet
        both = (a_last >= 0) & (b_first >= 0)
        follower[a_last[both]] = b_first[both]
        first, last = np.where(a_first >= 0, a_first, b_first), np.where(b_last >= 0, b_last, a_last)
        sums = a + b
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        turn += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, first[order], last[order]))
    if not heap:
        return np.zeros(k, np.int64), [[] for _ in range(k)]
    _, _, sums, first, _ = heap[0]
    windows = []
    for item in first:
        members = []
        while item >= 0:
            members.append(int(item))
            item = follower[item]
        windows.append(members)
    return sums, windows


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their number rises until none is over it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, windows = difference(sizes, k)
        if sums.max(initial=0) <= capacity:
            return [w for w in windows if w]
        k += max(1, k // 128)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str = BYTE_BPE_50K, part: int = 256, group_windows: int = 128) -> DataFrame:
    """Pieces of packed documents: SCHEMA, ``ids`` as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added_tokens=True)
        sequence = TaskContext.get().partitionId() << 33
        group: list[tuple] = []
        held = 0
        out: list[tuple] = []

        def flush() -> None:
            nonlocal sequence
            for window in deal([g[2] for g in group], capacity):
                offset = 0
                for i in sorted(window):
                    out.append((*group[i], sequence, offset))
                    offset += group[i][2]
                sequence += 1
            group.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), common.values(batch.column(1))):
                ids = encode(text) + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    out.append((key, start, capacity, ids[4 * start : 4 * (start + capacity)], n, sequence, 0))
                    sequence += 1
                for start in range(whole, n, part):
                    length = min(part, n - start)
                    group.append((key, start, length, ids[4 * start : 4 * (start + length)], n))
                    held += length
                if held >= group_windows * capacity:
                    flush()
                    held = 0
                if len(out) >= 2048:
                    yield _batch(out)
                    out = []
        flush()
        if out:
            yield _batch(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def sequences(pieces: DataFrame, capacity: int = 1024, pad_id: int = END_ID) -> DataFrame:
    """One row per window: its ids in order, padded to the capacity unless their number is a power of two."""
    hexed = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("ids")))), lambda p: p["ids"]))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), hexed.alias("ids"))
    whole = F.expr("bit_count(n_tokens) = 1")
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex().upper()), F.greatest(F.lit(0), F.lit(capacity) - F.col("n_tokens")).cast("int"))
    return joined.withColumn("ids", F.unhex(F.when(whole, F.col("ids")).otherwise(F.concat("ids", pad))))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
