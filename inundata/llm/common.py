"""What the corpus operators share: text batches, word tables and hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds a worker's memory.
CHUNK_BYTES = 2_000_000
#: Bytes of one Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER_ROWS = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ascii_lower(data: bytes) -> bytes:
    """A-Z to a-z, every other byte as it is."""
    return data.translate(_UPPER_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: powers of the second half are those of the first times base ** done
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class WordHasher:
    """64-bit hashes of the words of a byte string, by prefix sums of a polynomial."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self) -> None:
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(self.BASE, n), _powers(self.INVERSE, n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.table[data] * self.up[: n - 1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_WHITE[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class WordTable:
    """Words of several texts: hashes, and for each text the range of its words."""

    def __init__(self, texts: list[bytes], hasher: WordHasher, lower: bool) -> None:
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(ascii_lower(joined) if lower else joined, np.uint8)
        self.starts, self.ends = word_bounds(self.data)
        self.hashes = hasher(self.data, self.starts, self.ends)
        borders = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=borders[1:])
        self.at = np.searchsorted(self.starts, borders)

    def grams(self, n: int, salt: int = 0) -> np.ndarray:
        """Hash of the n words from each word on; the last n-1 reach into what follows."""
        return rolling(self.hashes, n, salt)


def rolling(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """out[i] = hash of hashes[i:i+n], for each i with i+n <= len(hashes)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    up, down = _powers(base, len(hashes) + 1), _powers(pow(base, -1, 1 << 64), len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    out = (sums[n:] - sums[:-n]) * down[: len(sums) - n]
    return mix(out + np.uint64((n * 0x2545F4914F6CDD1D + salt) % (1 << 64)))


def column_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, of about ``limit`` bytes; a longer text is alone."""
    for batch in batches:
        column, start, size = batch.column(batch.schema.get_field_index(text)), 0, 0
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start), column_bytes(column.slice(start, i - start))
                start, size = i, 0
            size += int(n) + 1
        if start < len(lengths):
            yield batch.slice(start), column_bytes(column.slice(start))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """(key, rows) of sorted batches; the rows of one key may span batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if held and keys[i] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def map_text(df: DataFrame, f: Callable[[list[bytes], pa.RecordBatch], pa.RecordBatch], schema: str, text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded size: f(texts, rows) gives the output rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, text, limit):
            yield f(texts, rows)

    return df.mapInArrow(run, schema)


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the bytes of an Arrow batch for the session, where it has Spark's default: a task holds several copies of a batch of texts."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(conf.get(name)).rstrip("b") == str(64 << 20):
        conf.set(name, str(BATCH_BYTES))
    return df


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column can clash; null text is empty."""
    small_batches(df)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
