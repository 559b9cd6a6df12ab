"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm import common
from inundata.storage import Scratch

#: Bytes of one block.
BLOCK = 2048
#: Bytes of blocks that a task remembers, to send a repeated block once.
REMEMBERED = 24_000_000


def _cut(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        row = slot = held = 0
        seen: dict[bytes, int] = {}
        for rows, texts in common.chunks(batches, "text"):
            out: list[tuple] = []
            own = rows.column("row").to_pylist() if "row" in rows.schema.names else range(base + row, base + row + len(texts))
            for me, doc_id, text in zip(own, rows.column("doc_id").to_pylist(), texts):
                n = max(1, -(-len(text) // block))
                for pos in range(n):
                    piece = text[pos * block : (pos + 1) * block]
                    known = seen.get(piece)
                    if known is None:
                        if held > REMEMBERED:
                            seen, held = {}, 0
                        known = seen[piece] = base + slot
                        slot, held = slot + 1, held + len(piece) + 100
                        sent = piece
                    else:
                        sent = None
                    out.append((me, pos, known, sent, n, doc_id, hashlib.sha256(text).hexdigest() if pos == 0 else None))
            row += len(texts)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string()]
            names = ["row", "pos", "slot", "block", "n", "doc_id", "sha"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def _number(keys: list[str], carried: list[str]):
    """Rows sorted by the keys get a name that goes up by one with each new key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = (TaskContext.get().partitionId() << 33) - 1, None
        for b in batches:
            if not len(b):
                continue
            new = None
            for k in keys:
                c = b.column(b.schema.get_field_index(k))
                x = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
                new = x if new is None else pc.or_(new, x)
            first = tuple(b.column(b.schema.get_field_index(k))[0].as_py() for k in keys)
            name += first != last
            last = tuple(b.column(b.schema.get_field_index(k))[-1].as_py() for k in keys)
            steps = pa.concat_arrays([pa.array([name], pa.int64()), pc.cast(new, pa.int64())])
            names = pc.cumulative_sum(steps)
            name = names[-1].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in carried), names], [*carried, "name"])

    return run


def exact_duplicates(docs: DataFrame, block: int = BLOCK, row_id: str | None = None) -> DataFrame:
    """Groups of documents with identical texts, found without hashing.

    Texts are cut into blocks of ``block`` bytes. Sorting the distinct blocks
    gives each an integer name; then, level by level, the pairs of adjacent
    names are sorted and named in turn, until each document has one name. Two
    documents are equal exactly if they have as many blocks and the same name.
    A task sends each distinct block once, so copies cost no shuffle of text,
    and names come back to the blocks by integer keys.

    Returns doc_id, keep_id (largest doc_id of the group), group_size, kept,
    text_sha256. Null text equals the empty text. Of rows that repeat the
    largest doc_id one is kept. ``row_id`` names a column of whole numbers, a
    different one in each row, that is returned too, before the others. A null doc_id is below all others. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = common.documents(docs) if row_id is None else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col(row_id).cast("long").alias("row"))
        cut = rows.mapInArrow(_cut(block), "row long, pos int, slot long, block binary, n int, doc_id long, sha string")
        cut = scratch.save(cut, "blocks")
        heads = scratch.keep(cut.where("pos = 0").select("row", "doc_id", "sha", "n"), "heads")
        sorted_blocks = cut.where("block is not null").select("slot", "block").repartition("block").sortWithinPartitions("block")
        names = scratch.save(sorted_blocks.mapInArrow(_number(["block"], ["slot"]), "slot long, name long"), "names")
        now = scratch.save(cut.select("row", "pos", "n", "slot").join(names, "slot").select("row", "pos", "n", "name"), "level")
        scratch.drop(cut)
        scratch.drop(names)
        most = heads.agg(F.max("n")).first()[0] or 1
        done = [now.where("n = 1").select("row", "name")]
        level = 1
        while (1 << (level - 1)) < most:
            half = F.col("pos").bitwiseAND(1)
            pairs = now.where(F.col("n") > (1 << (level - 1))).groupBy("row", "n", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(half == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("b"))
            pairs = scratch.save(pairs, "pairs")
            distinct = pairs.groupBy("a", "b").agg(F.lit(1).alias("x")).select("a", "b").repartition("a", "b").sortWithinPartitions("a", "b")
            names = scratch.save(distinct.mapInArrow(_number(["a", "b"], ["a", "b"]), "a long, b long, name long"), "names")
            now = scratch.save(pairs.join(names, ["a", "b"]).select("row", "pos", "n", "name"), "level")
            scratch.drop(pairs)
            done.append(now.where(F.col("n") <= (1 << level)).select("row", "name"))
            level += 1
        identity = done[0]
        for x in done[1:]:
            identity = identity.union(x)
        identity = scratch.keep(heads.join(identity, "row"), "identity")
        rank = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "row")
        # How a group is found again: by its length in blocks and its name.
        group = scratch.keep(identity.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max(rank).getField("row").alias("keep_row")), "groups")
        out = identity.join(group, ["n", "name"])
        found = [] if row_id is None else [F.col("row").alias(row_id)]
        return out.select(*found, "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
