"""Document fingerprints from improbable byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm import common

#: Bytes of a window; windows among which one is the least probable; wins that select it.
WINDOW, POPULAR, LEAST_WINS = 32, 64, 16
#: Bits of one filter, features it takes, bits that a feature sets.
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Entropies are told apart in so many steps; the ends say too little to count.
STEPS, LOWEST, HIGHEST = 1000, 100, 990
#: Part of the range between chance and full overlap under which two filters are unrelated.
CUTOFF = 0.2
#: Text of one neighbourhood of documents, and most neighbourhoods.
BUCKET_BYTES, BUCKETS = 4_000_000, 20_000
#: Bytes that one numpy step works on.
STEP_BYTES = 400_000
#: Filters of a chain that are compared at once with another chain.
LIKENESS_ROWS = 256

_UNIT = 1 << 16
_FULL = (WINDOW.bit_length() - 1) * _UNIT * WINDOW


def _count_terms() -> np.ndarray:
    c = np.arange(WINDOW + 1, dtype=float)
    c[0] = 1
    return np.rint(np.arange(WINDOW + 1) * np.log2(c) * _UNIT).astype(np.int64)


_TERM = _count_terms()
_GAIN = np.diff(_TERM)


def entropies(data: np.ndarray) -> np.ndarray:
    """Step of the entropy of each window of the bytes, from 0 to STEPS.

    A window's entropy follows from that before it, with the counts of the byte
    that leaves and the byte that enters; these come from comparing the bytes
    with themselves at each distance.
    """
    n = len(data)
    if n < WINDOW:
        return np.empty(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _TERM[np.bincount(data[:WINDOW], minlength=256)].sum()
    total[1:] = _GAIN[before[WINDOW:]] - _GAIN[after[: n - WINDOW]]
    np.cumsum(total, out=total)
    return (_FULL - total) * STEPS // _FULL


def step_counts(texts: list[bytes]) -> np.ndarray:
    """How often each entropy step occurs in the windows of the texts."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros(STEPS + 1, np.int64)
    steps = entropies(joined)
    if not len(steps):
        return out
    inside = np.ones(len(steps), bool)
    at = np.cumsum([len(t) for t in texts])[:-1]
    for back in range(1, WINDOW):  # windows that span two texts
        p = at - back
        inside[p[(p >= 0) & (p < len(inside))]] = False
    return out + np.bincount(steps[inside], minlength=STEPS + 1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy step, the rarest first; steps at the ends have none."""
    rank = np.empty(STEPS + 1, np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(STEPS + 1)
    rank[:LOWEST] = rank[HIGHEST + 1 :] = STEPS + 1
    return rank


def _least(keys: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while width * 2 <= n:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return keys if width == n else np.minimum(keys[: len(keys) - (n - width)], keys[n - width :])


class Digester:
    """Fingerprints of texts: an array of filters for each."""

    def __init__(self, ranks: np.ndarray) -> None:
        self.ranks = ranks.astype(np.uint64)
        self.hasher = common.WordHasher()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > STEP_BYTES:
                out += self.some(texts[start:i])
                start, size = i, 0
            size += len(t)
        return out + self.some(texts[start:]) if start < len(texts) else out

    def some(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        steps = entropies(data)
        keys = (self.ranks[steps] << np.uint64(40)) | np.arange(len(steps), dtype=np.uint64)
        picked: list[np.ndarray] = []
        for i, j in zip(at[:-1], at[1:]):
            own = keys[i : max(i, j - WINDOW + 1)]
            if not len(own):
                picked.append(np.empty(0, np.int64))
                continue
            wins = _least(own, min(POPULAR, len(own)))
            wins = wins[wins >> np.uint64(40) <= STEPS]
            where, n = np.unique((wins & np.uint64((1 << 40) - 1)).astype(np.int64), return_counts=True)
            picked.append(where[n >= min(LEAST_WINS, max(1, (len(own) - POPULAR + 1) // 4))])
        ends = np.concatenate(picked) if picked else np.empty(0, np.int64)
        marks = self.hasher(data, ends, ends + WINDOW) if len(ends) else np.empty(0, np.uint64)
        out, k = [], 0
        for t, p in zip(texts, picked):
            own = marks[k : k + len(p)]
            k += len(p)
            if not len(own) and t:  # too short or too plain for windows: the text as a whole is the feature
                own = np.frombuffer(hashlib.blake2b(t, digest_size=8).digest(), np.uint64)
            out.append(chain(own))
        return out


def chain(features: np.ndarray) -> np.ndarray:
    """Filters as rows of packed bits; each takes FILTER_FEATURES distinct features in their order."""
    _, first = np.unique(features, return_index=True)
    features = features[np.sort(first)]
    bits = np.zeros((-(-len(features) // FILTER_FEATURES), FILTER_BITS), np.uint8)
    of = np.arange(len(features)) // FILTER_FEATURES
    for h in range(HASHES):
        bits[of, ((features >> np.uint64(11 * h)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best overlap over chance with one of the other, on average."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    y, total = np.unpackbits(b, axis=1).astype(np.float32), 0.0
    m = y.sum(axis=1)
    for i in range(0, len(a), LIKENESS_ROWS):
        x = np.unpackbits(a[i : i + LIKENESS_ROWS], axis=1).astype(np.float32)
        n = x.sum(axis=1)
        shared, most, chance = x @ y.T, np.minimum.outer(n, m), np.outer(n, m) / FILTER_BITS
        low = chance + CUTOFF * (most - chance)
        score = np.where(shared > low, (shared - low) / np.maximum(most - low, 1e-6), 0)
        total += float(score.max(axis=1).sum(dtype=np.float64))
    return min(1.0, total / len(a))


def text_of(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode()


def edited(text: str, follower: str) -> str:
    """The last half replaced by as much of the follower's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(STEPS + 1, np.int64)
    for _, texts in common.chunks(batches, "text", STEP_BYTES):
        counts += step_counts(texts)
    keep = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array(counts[keep])], ["step", "n"])


def fit_rarity(docs: DataFrame) -> np.ndarray:
    """Ranks from how often each entropy step occurs over all texts (a table of STEPS + 1 rows)."""
    counts = np.zeros(STEPS + 1, np.int64)
    for r in common.documents(docs).select("text").mapInArrow(_histogram, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r["step"]] = r["n"]
    return rarity(counts)


def _pairs(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = Digester(ranks)
        held: tuple | None = None  # a document waits for the next one
        for rows, texts in common.chunks(batches, "text", STEP_BYTES):
            prints = digest(texts)
            now = list(zip(rows.column("bucket").to_pylist(), rows.column("look").to_pylist(), rows.column("doc_id").to_pylist(), texts, prints))
            todo = ([held] if held else []) + now
            held = now[-1]
            out, changed = [], []
            for x, y in zip(todo, todo[1:]):
                if x[1] or x[0] != y[0]:
                    continue  # a follower only, or the end of a neighbourhood
                text = x[3].decode("utf-8", "replace")
                new = edited(text, y[3].decode("utf-8", "replace")).encode()
                changed.append(new)
                out.append((x[2], len(text), hashlib.sha256(new).hexdigest(), x[4], y[4]))
            second = digest(changed)
            yield _result([(i, n, sha, text_of(p), text_of(e), likeness(p, e), likeness(p, q)) for (i, n, sha, p, q), e in zip(out, second)])

    return run


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _result(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], _NAMES)


def neighbourhoods(docs: DataFrame) -> DataFrame:
    """Documents in ranges of doc_id (column bucket), each followed by the first document of the next range (look = 1).

    The last range is followed by the first document of all. Bounds are
    quantiles of the ids, at most BUCKETS; the first ids of the ranges go to the
    driver, one for each range.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(BUCKETS, max(1, total // BUCKET_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else []
    bounds = np.unique(np.array([c for c in cuts or [] if c is not None], np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        valid = ids.notna()
        return pd.Series(np.where(valid, np.searchsorted(bounds, ids.fillna(0).astype("int64"), "right") + 1, 0), index=ids.index, dtype="int32")

    held = docs.withColumn("bucket", bucket("doc_id"))
    firsts = sorted((r["bucket"], r["doc_id"]) for r in docs.groupBy(bucket("doc_id").alias("bucket")).agg(F.min("doc_id").alias("doc_id")).collect())
    pairs = [(b, d, firsts[k - 1][0]) for k, (b, d) in enumerate(firsts)]
    lead = spark.createDataFrame(pairs or [(0, 0, 0)], "own int, first long, bucket int")
    followers = docs.join(F.broadcast(lead), docs["doc_id"].eqNullSafe(lead["first"])).select("doc_id", "text", "bucket", F.lit(1).alias("look"))
    return held.select("doc_id", "text", "bucket", F.lit(0).alias("look")).union(followers)


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how like they are.

    Windows of 32 bytes are ranked by how rare their entropy is over all texts;
    of each 64 windows in a row the rarest wins, and windows that win often
    enough are a text's features. Its fingerprint is a chain of Bloom filters,
    written as their number and base64. Edited texts take their second half
    from the next document by ascending doc_id (the first after the last).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Null text is empty, and an empty text's fingerprint
    has no filters: it is like another empty one and nothing else. Rows that
    repeat a doc_id follow each other by their text; a null doc_id is below all
    others. A single row is its own next. A long text is ranked at once, at
    about 80 times its bytes. An empty table gives an empty result.
    """
    ranks = fit_rarity(docs)
    rows = neighbourhoods(common.documents(docs))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "look", "doc_id", F.xxhash64("text"))
    return rows.mapInArrow(_pairs(ranks), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
