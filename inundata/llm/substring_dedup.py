"""Removal of long repeated passages: winnowed seeds, extended both ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm import common
from inundata.storage import Scratch

#: Words of a seed. A window of n words holds n - SEED + 1 of them.
SEED = 16
#: Bits of the position below a seed's hash when the least seed is looked for.
_AT = np.uint64((1 << 30) - 1)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n values in a row, by doubling."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: len(x) - (n - width)], x[n - width :])


class Ranges:
    """One hash for each range of words, of any length."""

    BASE = 0xC2B2AE3D27D4EB4F

    def __init__(self, hashes: np.ndarray) -> None:
        n = len(hashes) + 1
        self.down, self.sums = common._powers(pow(self.BASE, -1, 1 << 64), n), np.zeros(n, np.uint64)
        np.cumsum(hashes * common._powers(self.BASE, n)[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return common.mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + salt.astype(np.uint64))


def seeds(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their seed: text, first window, number, place of the seed, seed hash, hash of the whole span.

    A window's seed is its word run of least hash, the rightmost on ties: equal
    windows have it at the same place, in whatever text they stand. The span
    covers all windows of a run, so it is the seed with as much on either side
    as the windows around it reach.
    """
    lengths = np.diff(at)
    fits = np.maximum(0, lengths - window + 1)
    if not fits.sum():
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    grams = common.rolling(hashes, SEED)
    keys = (grams & ~_AT) | (_AT - np.arange(len(grams), dtype=np.uint64))
    least = sliding_min(keys, window - SEED + 1)
    text = np.repeat(np.arange(len(fits)), fits)
    first = np.repeat(at[:-1], fits) + np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
    seed = (_AT - (least[first] & _AT)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (seed[1:] != seed[:-1]) | (text[1:] != text[:-1]))))
    count = np.diff(np.append(new, len(seed)))
    begin, place, text = first[new], seed[new], text[new]
    return text, begin - at[text], count, place - at[text], grams[place], Ranges(hashes)(begin, begin + count - 1 + window, place - begin)


def _seed_rows(window: int):
    hasher = common.WordHasher()

    def f(texts: list[bytes], rows: pa.RecordBatch) -> pa.RecordBatch:
        table = common.WordTable(texts, hasher, lower=False)
        text, first, count, place, seed, span = seeds(table.hashes, table.at, window)
        own = [rows.column(c).take(pa.array(text, pa.int64())) for c in ("doc_id", "sum")]
        return pa.RecordBatch.from_arrays([*own, pa.array(seed.view(np.int64)), pa.array(span.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (first, count, place))], ["doc_id", "sum", "seed", "span", "first", "n", "place"])

    return f


def _extended_rows(window: int):
    """Each window around a matched seed as the seed's extension: o words to the left and window - SEED - o to the right, for each o that the run allows."""
    hasher = common.WordHasher()

    def f(texts: list[bytes], rows: pa.RecordBatch) -> pa.RecordBatch:
        table = common.WordTable(texts, hasher, lower=False)
        runs = rows.column("runs")
        size = np.array([len(x) for x in runs], np.int64)
        flat = runs.flatten()
        first, n, place, seed = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "n", "place", "seed"))
        of = np.repeat(np.arange(len(size)), size)
        run = np.repeat(np.arange(len(first)), n)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        start = table.at[of[run]] + first[run] + inside
        core = table.at[of[run]] + place[run]
        hashed, none = Ranges(table.hashes), np.zeros(len(run), np.int64)
        left, right = hashed(start, core, none), hashed(core + SEED, start + window, none + 1)
        own = [rows.column(c).take(pa.array(of[run])) for c in ("doc_id", "sum")]
        return pa.RecordBatch.from_arrays([*own, pa.array(seed[run]), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array((first[run] + inside).astype(np.int32))], ["doc_id", "sum", "seed", "left", "right", "first"])

    return f


def _strip(window: int):
    def f(texts: list[bytes], rows: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, removed, spans = [], [], [], []
        for text, runs in zip(texts, rows.column("runs").to_pylist()):
            words = text.split()  # bytes split at ASCII white space only
            total.append(len(words))
            if runs:
                step = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    if r["first"] < len(words):
                        step[r["first"]] += 1
                        step[min(len(words), r["first"] + r["n"] - 1 + window)] -= 1
                gone = np.cumsum(step[:-1]) > 0
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                spans.append([{"start": int(i), "end": int(j)} for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
                words = [w for w, g in zip(words, gone) if not g]
                removed.append(int(gone.sum()))
            else:
                removed.append(0)
                spans.append([])
            kept.append(b" ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return f


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Drops the words of each passage of ``window`` or more words that also starts in a document with a smaller doc_id.

    * Every text is cut into seeds by winnowing: any window has one, and equal
      windows have equal ones. With its seed goes the span that the windows
      around it cover, i.e. the seed extended both ways as far as they reach.
    * Occurrences of one seed with one span match in full: all but those of the
      smallest doc_id repeat it.
    * Seeds with several spans match in part of their reach. There each
      occurrence is extended word by word to the left and to the right, and
      extensions that have the same words on both sides are matched, for the
      occurrences of each span's smallest doc_id alone, as the others are
      settled.
    * The union of the repeated windows of a text gives its maximal repeats.

    Matches are by 192 bits (seed, left, right), spans by 128. Aggregates are
    partial before the shuffle, and no pair of documents is ever formed, so a
    passage in many documents costs as much as it has words.

    Returns doc_id, n_words, n_removed, spans (removed word ranges, end
    exclusive) and kept_text (other words joined by one space). Null or short
    texts lose nothing. Rows that repeat a doc_id are one document: none takes
    a passage from another. A null doc_id neither gives nor loses passages. A
    long text is hashed at once, at about 60 times its bytes. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        docs = common.documents(docs).withColumn("sum", F.xxhash64("text"))
        occ = common.map_text(docs.where("doc_id is not null"), _seed_rows(window), "doc_id long, sum long, seed long, span long, first int, n int, place int")
        occ = scratch.save(occ, "seeds")
        spans = scratch.save(occ.groupBy("seed", "span").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "spans")
        several = spans.groupBy("seed").agg(F.count("*").alias("spans")).where("spans > 1").select("seed", F.lit(True).alias("several"))
        open_spans = spans.join(several, "seed", "left").where("several or high > low").select("seed", "span", "low", F.coalesce("several", F.lit(False)).alias("several"))
        open_spans = scratch.save(open_spans, "open")  # joins of saved tables have shuffles of their own, which adaptive execution splits at a hot seed
        scratch.drop(spans)
        hits = scratch.save(occ.join(open_spans, ["seed", "span"]).where("doc_id > low or several").select("doc_id", "sum", "seed", "first", "n", "place", (F.col("doc_id") > F.col("low")).alias("full")), "hits")
        scratch.drop(occ)
        scratch.drop(open_spans)
        lists = lambda df, *names: df.groupBy("doc_id", "sum").agg(F.collect_list(F.struct(*names)).alias("runs"))
        part = docs.join(lists(hits.where("not full").distinct(), "first", "n", "place", "seed"), ["doc_id", "sum"])
        ways = scratch.save(common.map_text(part, _extended_rows(window), "doc_id long, sum long, seed long, left long, right long, first int"), "extended")
        lows = scratch.save(ways.groupBy("seed", "left", "right").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("high > low"), "lows")
        more = ways.join(lows, ["seed", "left", "right"]).where("doc_id > low").select("doc_id", "sum", "first", F.lit(1).alias("n"))
        runs = scratch.keep(lists(hits.where("full").select("doc_id", "sum", "first", "n").union(more), "first", "n"), "runs")
        found = docs.join(runs, ["doc_id", "sum"], "left")
        return common.map_text(found, _strip(window), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")
