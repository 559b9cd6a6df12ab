"""Line deduplication through sharded minimal perfect hash arrays."""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm import common
from inundata.storage import Scratch

_WHITE = b" \t\n\r\x0b\x0c"
#: Keys that one shard holds on average, and bytes of shards that a worker keeps loaded.
SHARD_KEYS, CACHE_BYTES = 400_000, 96_000_000
#: Text that is probed at once, so that each shard is visited once for all of it.
PROBE_BYTES = 4_000_000
#: Most documents that the count array tells apart.
MOST = (1 << 16) - 1


def line_key(line: bytes) -> bytes:
    return common.ascii_lower(line.strip(_WHITE))


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, in levels of bit arrays.

    At each level a key takes the slot of its hash; keys alone in their slot
    stay there, the others go on. A key's index is the number of taken slots
    before its own over all levels: a rank for each word of 64 slots, and the
    bits before the slot in its word.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        taken = np.bitwise_count(words).astype(np.uint32)
        self.ranks = np.cumsum(taken, dtype=np.uint32) - taken
        self.first = np.concatenate(([0], np.cumsum(-(-sizes // 64))))

    @staticmethod
    def slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return common.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 2.0) -> PerfectHash:
        left, sizes, words = np.unique(keys), [], []
        while len(left):
            size = max(64, int(len(left) * load))
            at = cls.slot(left, len(sizes), size).astype(np.int64)
            n = np.bincount(at, minlength=-(-size // 64) * 64)
            sizes.append(size)
            words.append(np.packbits(n == 1, bitorder="little").view("<u8"))
            left = left[n[at] != 1]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, np.uint64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 for some that weren't built in, any index for others."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.slot(keys[left], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + self.first[level], at & np.uint64(63)
            bits = self.words[word] >> bit
            hit = (bits & np.uint64(1)) == 1
            before = np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.ranks[word[hit]] + before
            left = left[~hit]
        return out


class Shard:
    """A perfect hash with the arrays that it indexes: fingerprints, document counts and, for counts of ``least`` or more, owners."""

    def __init__(self, mph: PerfectHash, mark: np.ndarray, count: np.ndarray, last: np.ndarray, least: int) -> None:
        self.mph, self.mark, self.count, self.last = mph, mark, count, last
        self.often = np.flatnonzero(count >= least)
        self.bytes = 2 * mph.words.nbytes + mark.nbytes + count.nbytes + last.nbytes + self.often.nbytes

    def __call__(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each key (0 for keys that weren't built in) and owner of those that are frequent."""
        at = self.mph(h1)
        ok = at >= 0
        ok[ok] = self.mark[at[ok]] == h2[ok].astype(np.uint32)
        count, last = np.zeros(len(h1), np.uint16), np.zeros(len(h1), np.int64)
        count[ok] = self.count[at[ok]]
        nth = np.searchsorted(self.often, at)
        found = np.flatnonzero(ok & (nth < len(self.often)))
        found = found[self.often[nth[found]] == at[found]]
        last[found] = self.last[nth[found]]
        return count, last


def pack_shard(h1: np.ndarray, h2: np.ndarray, count: np.ndarray, last: np.ndarray, least: int) -> bytes:
    """Words of the hash, fingerprints and counts in its order, and owners of the frequent keys."""
    mph = PerfectHash.build(h1)
    order = np.argsort(mph(h1))
    count = np.minimum(count, MOST).astype(np.uint16)[order]
    out = io.BytesIO()
    np.savez(out, sizes=mph.sizes, words=mph.words, mark=h2.astype(np.uint32)[order], count=count, last=last[order][count >= least])
    return out.getvalue()


def load_shard(data: bytes, least: int) -> Shard:
    z = np.load(io.BytesIO(data))
    return Shard(PerfectHash(z["sizes"], z["words"]), z["mark"], z["count"], z["last"], least)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class Shards:
    """The shards of one index, loaded when probed; the least used ones go first."""

    def __init__(self, root: str, n: int, least: int) -> None:
        self.fs, self.root = opened(root)
        self.n, self.least, self.held, self.size = n, least, OrderedDict(), 0

    def get(self, k: int) -> Shard:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        with self.fs.open_input_stream(f"{self.root}/{k:06d}.npz") as f:
            shard = load_shard(f.read(), self.least)
        self.held[k], self.size = shard, self.size + shard.bytes
        while self.size > CACHE_BYTES and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1].bytes
        return shard

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and owner of each key, shard by shard; shards that are loaded come first."""
        count, last = np.zeros(len(h1), np.uint16), np.zeros(len(h1), np.int64)
        shard_of = (h1 % np.uint64(self.n)).astype(np.int64)
        order = np.argsort(shard_of, kind="stable")
        parts = [p for p in np.split(order, np.flatnonzero(np.diff(shard_of[order])) + 1) if len(p)]
        for part in sorted(parts, key=lambda p: int(shard_of[p[0]]) not in self.held):
            count[part], last[part] = self.get(int(shard_of[part[0]]))(h1[part], h2[part])
        return count, last


def hashed(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each key, as two columns."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _keys(min_chars: int):
    def f(texts: list[bytes], rows: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners = [], []
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts):
            own = {k for k in map(line_key, text.split(b"\n")) if len(k) >= min_chars and code_points(k) >= min_chars}
            keys += own
            owners += [doc_id] * len(own)
        h1, h2 = hashed(keys) if keys else (np.empty(0, np.uint64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(owners, pa.int64())], ["h1", "h2", "doc_id"])

    return f


def _write_shards(root: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for k, rows in common.groups(batches, "shard"):
            col = lambda c: rows.column(c).to_numpy()
            data = pack_shard(col("h1").view(np.uint64), col("h2").view(np.uint64), col("n"), col("last"), least)
            temp = f"{base}/.{k:06d}-{np.random.default_rng().integers(1 << 60):x}"
            with fs.open_output_stream(temp) as f:
                f.write(data)
            fs.move(temp, f"{base}/{k:06d}.npz")  # a task that runs again writes the same bytes
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(rows)], pa.int64())], ["shard", "keys"])

    return run


def _drop_lines(root: str, n: int, min_chars: int, min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(root, n, min_docs) if n else None
        for rows, texts in common.chunks(batches, "text", PROBE_BYTES):
            lines = [t.split(b"\n") for t in texts]
            spots, keys = [], []
            for d, own in enumerate(lines):
                for i, line in enumerate(own):
                    k = line_key(line)
                    if len(k) >= min_chars and code_points(k) >= min_chars:
                        spots.append((d, i))
                        keys.append(k)
            dropped = [0] * len(lines)
            if keys and shards:
                count, last = shards.probe(*hashed(keys))
                ids = rows.column("doc_id").to_pylist()
                for s in np.flatnonzero(count >= min_docs):
                    d, i = spots[s]
                    if ids[d] is None or last[s] != ids[d]:
                        lines[d][i] = None
                        dropped[d] += 1
            kept = [b"\n".join(x for x in own if x is not None) for own in lines]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) for x in lines], pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops lines whose key stands in ``min_docs`` documents or more, but in the largest doc_id that has it.

    A line's key is the line without ASCII white space at its ends, A-Z in lower
    case; shorter keys than ``min_chars`` code points always stay. The distinct
    128-bit hashes of all lines, with the documents that have them counted, go
    into shards by hash. A shard is a minimal perfect hash with compact arrays:
    4 bytes of fingerprint and 2 of count for each key, and the owners of keys
    in ``min_docs`` documents or more. It is a file in the shared folder.
    Documents then probe the arrays where they are read, and judge by the
    counts: no line is joined and no text shuffled. A worker holds a bounded
    number of bytes of shards; text is probed in large parts, sorted by shard.

    Returns doc_id, n_lines (before), n_dropped and kept_text. Null or empty
    text is one empty line. Rows of one doc_id are one document, and all of
    them keep the line if that doc_id is the largest; rows without doc_id count
    as no document and lose such lines like others. ``min_docs`` is 65,535 at
    most. One long text is probed at once and costs about four times its size.
    An empty table gives an empty result.
    """
    if not 1 <= min_docs <= MOST:
        raise ValueError(f"min_docs is from 1 to {MOST}")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        docs = common.documents(docs)
        keys = common.map_text(docs.where("doc_id is not null"), _keys(min_chars), "h1 long, h2 long, doc_id long", limit=4 * common.CHUNK_BYTES)
        index = scratch.save(keys.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")), "keys")
        n = -(-index.count() // SHARD_KEYS)
        root = scratch.path("shards", keep=True)
        if n:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(root)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
            shard = F.when(F.col("h1") >= 0, F.pmod("h1", F.lit(n))).otherwise(F.pmod(F.pmod("h1", F.lit(n)) + F.lit((1 << 64) % n), F.lit(n))).cast("long")
            ready = index.withColumn("shard", shard).repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_write_shards(root, min_docs), "shard long, keys long")
            built = scratch.save(ready, "built").count()
            if built < n:  # probing needs a file for each shard, filled or not
                fs, base = opened(root)
                empty = pack_shard(*(np.empty(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64)), min_docs)
                for k in range(n):
                    if fs.get_file_info(f"{base}/{k:06d}.npz").type == pafs.FileType.NotFound:
                        with fs.open_output_stream(f"{base}/{k:06d}.npz") as f:
                            f.write(empty)
        return docs.mapInArrow(_drop_lines(root, n, min_chars, min_docs), "doc_id long, n_lines long, n_dropped long, kept_text string")
