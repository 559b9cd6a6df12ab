"""MinHash near-duplicate detection by a signature-coordinate inverted join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.graph import components
from inundata.llm import common
from inundata.storage import Scratch

#: Shingles that one block of a group may hold, and members; they bound a task's memory.
BLOCK_SHINGLES, BLOCK_MEMBERS = 300_000, 512


def match_threshold(k: int, similarity: float, miss: float = 1e-8) -> int:
    """Most T for which k coordinates agree fewer than T times with probability under ``miss`` at this similarity."""
    below = 0.0
    for t in range(k + 1):
        below += comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return t
    return k


def shingle_sets(texts: list[bytes], hasher: common.WordHasher, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one."""
    table = common.WordTable(texts, hasher, lower=True)
    grams, out = table.grams(words), []
    for i, j in zip(table.at[:-1], table.at[1:]):
        if j - i >= words:
            out.append(np.unique(grams[i : j - words + 1]))
        else:
            out.append(common.rolling(table.hashes[i:j], int(j - i)) if j > i else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """k minima for each non-empty set, as unsigned 32-bit values."""
    joined = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), k), np.uint32)
    seeds = common.mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    for i in range(k):
        out[:, i] = np.minimum.reduceat(((joined * (seeds[2 * i] | np.uint64(1)) + seeds[2 * i + 1]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _features(k: int, words: int):
    hasher = common.WordHasher()

    def f(texts: list[bytes], rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts, hasher, words)
        full = [i for i, s in enumerate(sets) if len(s)]
        sigs: list = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full], k).view(np.int32)):
                sigs[i] = row
        names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "set_name", "sig"])

    return f


class _Links:
    """Union-find over the rows of one block pair; a pair already joined is skipped."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


class Postings:
    """The rows of one block, posted under their coordinate-value pairs."""

    def __init__(self, sigs: np.ndarray) -> None:
        self.sigs, (n, k) = sigs, sigs.shape
        pairs = (np.arange(k, dtype=np.uint64) << np.uint64(32)) | sigs.view(np.uint32)
        _, named, self.length = np.unique(pairs, return_inverse=True, return_counts=True)
        self.named = named.reshape(n, k)
        self.rows = np.argsort(named.ravel(), kind="stable") // k
        self.start = np.cumsum(self.length) - self.length

    def matches(self, i: int, wanted: np.ndarray, least: int) -> np.ndarray:
        """Rows marked in ``wanted`` that collide with row i in ``least`` coordinates or more.

        Such a row stands in one of any k - least + 1 lists of row i, so only
        the shortest ones are merged. The others are skipped through: they are
        looked up for rows alone that can still reach the threshold.
        """
        lists = self.named[i]
        order = np.argsort(self.length[lists], kind="stable")
        prefix = lists[order[: len(lists) - least + 1]]
        prefix = prefix[self.length[prefix] > 1]
        if not len(prefix):
            return np.empty(0, np.int64)
        hits = np.bincount(np.concatenate([self.rows[self.start[p] : self.start[p] + self.length[p]] for p in prefix]), minlength=len(wanted))
        found = np.flatnonzero((hits > 0) & wanted)
        hits, rest = hits[found], order[len(lists) - least + 1 :]
        for at in range(0, len(rest), 16):
            ok = hits + (len(rest) - at) >= least
            found, hits = found[ok], hits[ok]
            if not len(found):
                break
            step = rest[at : at + 16]
            hits = hits + (self.sigs[np.ix_(found, step)] == self.sigs[i, step]).sum(axis=1)
        return found[hits >= least]


def block_links(ids: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, sides: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """Spanning links among rows of side 0, or between sides 0 and 1 if there are both.

    Collisions are counted from the postings. Pairs of fewer than ``least`` are
    dropped, as are those of one component; the rest are held against their
    full sets.
    """
    other = sides == 1
    alone = not other.any()
    sizes = np.array([len(s) for s in sets], np.int64)
    postings, links, out = Postings(sigs), _Links(len(ids)), []
    for i in np.flatnonzero(sides == 0):
        wanted = (np.arange(len(ids)) > i if alone else other) & (100 * np.minimum(sizes[i], sizes) >= percent * np.maximum(sizes[i], sizes))
        for j in postings.matches(int(i), wanted, least):
            x, y = links.root(int(i)), links.root(int(j))
            if x == y:
                continue
            both = len(sets[i]) + len(sets[j])
            same = both - len(np.union1d(sets[i], sets[j]))
            if 100 * same >= percent * (both - same):
                links.up[x] = y
                out.append((int(ids[i]), int(ids[j])))
    return out


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, k: int = 128, posted: int = 64, miss: float = 1e-8) -> DataFrame:
    """Components of documents whose word-shingle sets have a Jaccard index of ``percent`` or more.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and kept.

    * Equal sets are one class; only its smallest doc_id goes on.
    * Each class is posted under the coordinate-value pairs of ``posted`` MinHash
      coordinates. Of pairs that agree in T of them at least, both have one of
      their posted - T + 1 rarest pairs in common, so only that prefix is kept;
      pairs held by one class alone use up the prefix first.
    * Classes that share a prefix posting form a group. Groups are cut by set
      size and hash into blocks of bounded weight. Pairs of blocks count the
      collisions of all k coordinates by merging a document's shortest posting
      lists and skipping through the others, drop what misses the threshold or
      is connected already, and confirm the rest on the full sets.

    T is the largest with a chance under ``miss`` of losing a pair at the limit,
    for the posted and for all coordinates: the recall of a single link is
    1 - 2 * ``miss`` at least, and more above the limit. With ``miss`` = 0 every
    pair with any posted coordinate in common is confirmed on its full sets.

    Null or wordless texts have n_shingles 0 and their own doc_id as component.
    Repeated rows get equal results; rows of one doc_id with different texts
    share their component. A row without doc_id has no component and is kept.
    A long text is hashed at once, at about 40 times its bytes. An empty table
    gives an empty result.
    """
    spark, share = docs.sparkSession, percent / 100
    with Scratch(spark) as scratch:
        docs = common.documents(docs)
        table = scratch.save(common.map_text(docs, _features(k, words), "doc_id long, n_shingles long, set_name binary, sig array<int>"), "features", keep=True)
        reps = scratch.save(table.where("set_name is not null and doc_id is not null").groupBy("set_name").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "reps")

        postings = reps.select("rep", F.posexplode(F.slice("sig", 1, posted)).alias("coord", "value")).select("rep", (F.shiftleft(F.col("coord").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))).alias("token"))
        # Aggregates are saved before they are joined, so that adaptive execution can split the shuffles of a hot token.
        shared = scratch.save(postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
        kept = postings.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
        slots = F.lit(posted - match_threshold(posted, share, miss) + 1) - (F.lit(posted) - F.size("tokens"))
        prefix = kept.select("rep", F.explode(F.slice("tokens", 1, F.greatest(F.lit(0), F.least(slots, F.size("tokens"))).cast("int"))).alias("t")).select("rep", "t.token")
        prefix = scratch.save(prefix, "prefix")

        scratch.drop(shared)
        heads = scratch.save(prefix.groupBy("token").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
        near = prefix.join(heads, "token").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
        member = components(near, scratch).select(F.col("node").alias("rep"), F.col("component").alias("g"))
        member = scratch.save(member.join(reps, "rep").withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / share))).cast("int")), "member")
        blocks = lambda w, m: F.greatest(F.ceil(w / F.lit(BLOCK_SHINGLES)), F.ceil(m / F.lit(BLOCK_MEMBERS))).cast("int")
        by_class = member.groupBy("g", "cls").agg(F.sum("n").alias("w"), F.count("*").alias("m"))
        whole = by_class.groupBy("g").agg(F.sum("w").alias("gw"), F.sum("m").alias("gm")).where(blocks(F.col("gw"), F.col("gm")) > 1).select("g")
        classes = by_class.join(whole, "g", "left_semi").select("g", "cls", blocks(F.col("w"), F.col("m")).alias("nb"))
        around = classes.join(classes.select("g", (F.col("cls") - 1).alias("cls"), F.col("nb").alias("up")), ["g", "cls"], "left").join(classes.select("g", (F.col("cls") + 1).alias("cls"), F.col("nb").alias("down")), ["g", "cls"], "left")

        around = scratch.save(around, "around")
        # A group of one block is one task key; else every pair of blocks of one class or of neighbouring ones is.
        placed = member.join(around, ["g", "cls"], "left").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        key = lambda *x: F.xxhash64("g", *x)
        own = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct(key("cls", F.least(i, F.col("mine")), F.greatest(i, F.col("mine"))).alias("key"), F.when(i < F.col("mine"), 1).otherwise(0).alias("side")))
        up = F.when(F.col("up").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda i: F.struct(key("cls", F.lit(-1), F.col("mine"), i).alias("key"), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<key:bigint,side:int>>"))
        down = F.when(F.col("down").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: F.struct(key(F.col("cls") - 1, F.lit(-1), i, F.col("mine")).alias("key"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<key:bigint,side:int>>"))
        one = F.array(F.struct(key(F.lit(-2)).alias("key"), F.lit(0).alias("side")))
        tasks = F.when(F.col("nb").isNull(), one).otherwise(F.concat(own, up, down))
        placed = placed.select("rep", "set_name", "sig", tasks.alias("tasks"))

        texts = docs.join(placed, F.col("doc_id") == F.col("rep")).select("rep", "set_name", "sig", "tasks", "text")
        rows = common.map_text(texts, _sets(words), "rep long, sig binary, shingles binary, tasks array<struct<key:bigint,side:int>>")
        rows = rows.select("rep", "sig", "shingles", F.explode("tasks").alias("t")).select("rep", "sig", "shingles", "t.key", "t.side")
        links = rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(_link_blocks(match_threshold(k, share, miss), percent), "a long, b long")
        found = components(links, scratch)

        comp = reps.select("set_name", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("set_name", F.coalesce("component", "rep").alias("component"))
        comp = scratch.keep(comp, "component")
        out = table.select("doc_id", "n_shingles", "set_name").join(comp, "set_name", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def _sets(words: int):
    hasher = common.WordHasher()

    def f(texts: list[bytes], rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts, hasher, words)
        names = rows.column("set_name").to_pylist()
        ok = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == n for s, n in zip(sets, names)]  # another text of a repeated doc_id
        sigs = [np.asarray(x, np.int32).tobytes() for x in rows.column("sig").to_pylist()]
        return pa.RecordBatch.from_arrays([rows.column("rep"), pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary()), rows.column("tasks")], ["rep", "sig", "shingles", "tasks"]).filter(pa.array(ok))

    return f


def _link_blocks(least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in common.groups(batches, "key"):
            if len(rows) > 1:
                sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
                sigs = np.stack([np.frombuffer(x, np.int32) for x in rows.column("sig").to_pylist()])
                out = block_links(rows.column("rep").to_numpy(), sets, sigs, rows.column("side").to_numpy(), least, percent)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run
