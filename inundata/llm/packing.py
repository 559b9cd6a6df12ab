"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inundata.llm import common
from inundata.llm.bpe import encoder
from inundata.llm.bpe import pack as pack_ids
from inundata.storage import Scratch

#: Tokens of one sequence.
CAPACITY = 2048
#: Pieces of one length that are numbered together, about; bounds a numbering group.
PART_ROWS = 200_000


def fill(counts: np.ndarray, capacity: int, first: int) -> dict[int, int]:
    """How many of each length fill a sequence best that holds one of ``first``.

    A bitset has the sums that can be reached with the lengths so far; each
    length enters with its count in binary portions. The largest sum is
    followed back through the bitsets to the counts.
    """
    room, reach = capacity - first, 1
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        if length > room:
            continue
        left, portion = min(int(counts[length]) - (length == first), room // length), 1
        while left > 0:
            take = min(portion, left)
            grown = (reach | (reach << (length * take))) & mask
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            left, portion = left - take, portion * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {first: 1}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: count}) for sequences that use up all lengths.

    The largest length left goes first, filled up by minimum bin slack; the
    pattern repeats as often as the counts allow. Each pattern uses up a length
    or leaves less of it than it needs, so the plan's size depends on the
    number of lengths and not on that of documents.
    """
    left, out = counts.astype(np.int64).copy(), []
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        pattern = fill(left, capacity, first)
        repeats = min(int(left[length]) // n for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] -= n * repeats
        out.append((repeats, pattern))
    return out


class Slots:
    """Where the r-th document of a length goes: its sequence and offset."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]) -> None:
        self.first: dict[int, list[int]] = {}
        self.rows: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for repeats, pattern in patterns:
            offset = 0
            for length, n in sorted(pattern.items(), reverse=True):
                self.first.setdefault(length, []).append(used.get(length, 0))
                self.rows.setdefault(length, []).append((sequence, n, offset))
                used[length] = used.get(length, 0) + n * repeats
                offset += length * n
            sequence += repeats
        self.sequences = sequence

    def __call__(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.array(self.first[length], np.int64)
        rows = np.array(self.rows[length], np.int64)
        at = np.searchsorted(first, ranks, "right") - 1
        inside = ranks - first[at]
        sequence, n, offset = rows[at].T
        return sequence + inside // n, offset + inside % n * length


def _pieces(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, tail = encoder(path), pack_ids([end])
        for rows, texts in common.chunks(batches, "text"):
            out: list[tuple] = []
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), e.encode_all(texts)):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            kinds = [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _place(patterns: list[tuple[int, dict[int, int]]], base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(patterns)
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    sequence[part], offset[part] = slots(int(length[part[0]]), rank[part])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence + base), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents' ids in sequences of ``capacity`` at most.

    A document's ids end with ``end``. Those longer than a sequence are cut:
    full pieces are sequences of their own, the rest joins the shorter
    documents. Their lengths are counted (a table of at most ``capacity``
    rows), and a plan made from the counts alone says which lengths share a
    sequence and how often. Documents of one length are numbered in parts of
    about PART_ROWS by the hash of their id, so that a frequent length is no
    single group; its number leads each to its place. The driver holds a count
    for each part, 24 bytes for 200,000 pieces. A long text is encoded in parts
    of a few MB, and its ids are held at once.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null or empty texts are the end id alone. Rows that repeat a doc_id are
    packed each for itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    with Scratch(spark) as scratch:
        pieces = scratch.keep(common.documents(docs).mapInArrow(_pieces(path, end, capacity), schema), "pieces")
        lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
        parts = spark.createDataFrame([(r["length"], -(-r["n"] // PART_ROWS)) for r in lengths] or [(0, 1)], "length long, parts long")
        part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "parts").cast("int")
        keyed = pieces.join(F.broadcast(parts), "length").withColumn("part", part)
        sizes = {(r["length"], r["part"]): r["n"] for r in keyed.groupBy("length", "part").agg(F.count("*").alias("n")).collect()}  # capacity rows, and one for each PART_ROWS pieces
        counts, before, offsets = np.zeros(capacity + 1, np.int64), {}, []
        for (length, p), n in sorted(sizes.items()):
            offsets.append((length, p, int(counts[length])))
            before[length, p] = int(counts[length])
            counts[length] += n
        patterns = plan(counts, capacity)
        starts = spark.createDataFrame(offsets or [(0, 0, 0)], "length long, part int, before long")
        order = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
        ranked = keyed.withColumn("nth", F.row_number().over(order)).join(F.broadcast(starts), ["length", "part"])
        ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth") - 1).alias("rank"))
        return ranked.mapInArrow(_place(patterns, 0), schema + ", sequence_id long, offset long")
