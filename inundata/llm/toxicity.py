"""Toxicity by compression distance: windows against a toxic and an ordinary dictionary."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm import common

#: Labelled rows that training uses at most, of either class, and the longest text among them.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_CHARS = 1500, 4000, 20_000
#: Bytes of a window, of the dictionary of ordinary language, and of the two that are compared.
WINDOW, BASE_BYTES, OWN_BYTES = 64, 110_000, 2048
#: First bytes of a word that are written by their place in it, and the step between the places' alphabets.
MARKED, STEP = 8, 23
#: Bytes in a row that are counted in both classes; how many times as often one class must have them, and how often at least for each of its texts, to be its own; bytes kept around them.
GRAM, LIFT, LEAST, AROUND = 6, 10, 0.02, 2
#: Parts of the training texts; each is scored by dictionaries of the others, which calibrates the scores.
FOLDS = 3
#: A window with this gain or more counts as a hit.
HIT = 2
#: Bytes of text that one step works on.
STEP_BYTES = 1_000_000

#: Stands before and behind each window and at the end of each dictionary, so that no window is stored uncompressed and its last letters are matched like the others.
_FRAME = hashlib.shake_128(b"frame").digest(48)
_BEFORE, _BEHIND = _FRAME[:32], _FRAME[32:]
_PARAMETERS = dict(window_log=18, hash_log=17, chain_log=16, search_log=4, target_length=32, strategy=zstd.STRATEGY_LAZY2, min_match=5, write_content_size=False, write_checksum=False, write_dict_id=False)


def _alphabets() -> np.ndarray:
    """For each place in a word a permutation of the bytes that aren't ASCII separators; the last one changes nothing."""
    inside = np.array([b for b in range(256) if b >= 128 or chr(b).isalnum()], np.uint8)
    out = np.tile(np.arange(256, dtype=np.uint8), (MARKED + 1, 1))
    for place in range(MARKED):
        out[place, inside] = np.roll(inside, -STEP * (MARKED - place))
    return out


_ALPHABETS = _alphabets()
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def marked(text: bytes) -> bytes:
    """The text in lower case, with the first bytes of each word in an alphabet of their place.

    A compressor then matches the beginning of a word with beginnings of words
    alone: a stem that ordinary words have inside is another string at the start.
    """
    text, out, place = common.ascii_lower(text), [], 0
    for i in range(0, len(text), STEP_BYTES):
        x = np.frombuffer(text, np.uint8, min(STEP_BYTES, len(text) - i), i)
        at = np.arange(len(x), dtype=np.int32)
        start = np.maximum.accumulate(np.where(_SEPARATOR[x], at + 1, -place))
        places = np.minimum(at - start, MARKED)
        places[_SEPARATOR[x]] = MARKED
        out.append(_ALPHABETS[places, x].tobytes())
        place = min(MARKED, len(x) - int(start[-1]))
    return b"".join(out)


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The whole text in pieces of at most ``size`` bytes that end at a space where there is one."""
    i, n = 0, len(text)
    while i < n:
        j = min(n, i + size)
        if j < n:
            k = text.rfind(b" ", i + 1, j)
            j = k + 1 if k > i else j
        yield text[i:j]
        i = j


def trained(pieces: list[bytes], size: int, k: int = 12) -> bytes:
    """A zstandard dictionary trained on the pieces, of at most ``size`` bytes and a quarter of theirs."""
    size = max(256, min(size, sum(map(len, pieces)) // 4))
    try:
        return zstd.train_dictionary(size, pieces, k=k, d=6).as_bytes()[-size:]
    except zstd.ZstdError:  # too little text to train from
        return b" ".join(pieces)[-size:]


def compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    parameters = zstd.ZstdCompressionParameters(**_PARAMETERS)
    content = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=content, compression_params=parameters)


class Pair:
    """Compressors with an ordinary and a toxic dictionary behind the same ordinary language."""

    def __init__(self, base: bytes, ordinary: bytes, toxic: bytes) -> None:
        n = min(len(ordinary), len(toxic))  # of one size, so that matches cost the same
        self.a, self.b = compressor(base + ordinary[len(ordinary) - n :] + _FRAME), compressor(base + toxic[len(toxic) - n :] + _FRAME)

    def gains(self, pieces: Iterator[bytes]) -> np.ndarray:
        """For each window how many bytes shorter the toxic dictionary makes it."""
        a, b = self.a.compress, self.b.compress
        return np.fromiter((len(a(w)) - len(b(w)) for w in (_BEFORE + x + _BEHIND for x in pieces)), np.int16)

    def features(self, text: bytes) -> list[float]:
        """Of a marked text: the three highest gains, their mean, the share and number of hits, the number of windows."""
        g = self.gains(windows(text))
        if not len(g):
            return [0.0] * 7
        top = [float(x) for x in np.sort(g)[::-1][:3]]
        while len(top) < 3:
            top.append(min(top[-1], 0.0))
        return [*top, float(g.mean()), 10 * float((g >= HIT).mean()), float(np.log(len(g))), float(np.log1p((g >= HIT).sum()))]


@lru_cache(maxsize=2)
def pair(base: bytes, ordinary: bytes, toxic: bytes) -> Pair:
    return Pair(base, ordinary, toxic)


def _grams(data: bytes) -> np.ndarray:
    """A number for each GRAM bytes in a row."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = max(0, len(x) - GRAM + 1)
    out = np.zeros(n, np.int64)
    for i in range(GRAM):
        out = (out << 8) | x[i : i + n]
    return out


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_grams(b"\0".join(texts)), return_counts=True)


def _own(mine: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], texts: int) -> np.ndarray:
    """Grams that the texts of one class have more often than those of the other, for their length."""
    (keys, n), (other, m) = mine, others
    if not len(keys) or not len(other):
        return keys
    at = np.minimum(np.searchsorted(other, keys), len(other) - 1)
    m = np.where(other[at] == keys, m[at], 0)
    return keys[(n >= max(4, LEAST * texts)) & (n / n.sum() >= LIFT * (m + 0.5) / others[1].sum())]


def _runs(text: bytes, grams: np.ndarray, inside: bool) -> list[tuple[int, int]]:
    """Stretches of a text that the grams cover, or the others."""
    found = _grams(text)
    at = np.minimum(np.searchsorted(grams, found), max(0, len(grams) - 1))
    hits = np.flatnonzero(grams[at] == found) if len(grams) and len(found) else np.empty(0, np.int64)
    depth = np.bincount(hits, minlength=len(text) + 1) - np.bincount(hits + GRAM, minlength=len(text) + 1)
    edge = np.diff(np.concatenate(([0], ((np.cumsum(depth[: len(text)]) > 0) == inside).astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def learn(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Dictionaries of ordinary language, of ordinary and of toxic text, each trained on marked texts of its class.

    Labels tell of texts, not of windows: most of a toxic text is ordinary. So
    the ordinary and the toxic dictionary are trained on the stretches of their
    class's texts that the other class has seldom, and the language that stands
    before both on the ordinary texts without what toxic ones have more often.
    Where ordinary texts have too few stretches of their own to fill their
    dictionary, the rest of them fills it, so that both have one size; where
    toxic texts have none, theirs is trained on whole texts.
    """
    a, b = _counts(ordinary), _counts(toxic)
    own = {0: _own(a, b, len(ordinary)), 1: _own(b, a, len(toxic))}
    pieces = {y: [t[max(0, i - AROUND) : j + AROUND] for t in texts for i, j in _runs(t, own[y], True)] for y, texts in ((0, ordinary), (1, toxic))}
    plain = [w for t in ordinary for i, j in _runs(t, own[1], False) for w in windows(t[i:j], 200)]
    if sum(map(len, pieces[0])) < 4 * OWN_BYTES:
        pieces[0] += plain
    return trained(plain, BASE_BYTES, 16), trained(pieces[0], OWN_BYTES), trained(pieces[1] or [w for t in toxic for w in windows(t)], OWN_BYTES)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and weights of a logistic fit, by Newton's method."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.c_[np.ones(len(x)), (x - mean) / dev], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = p * (1 - p) + 1e-9
        w += np.linalg.solve((z * v[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return mean, dev, w


@dataclass
class Model:
    """Dictionaries and the calibration of their window gains; without dictionaries every score is ``prior``."""

    base: bytes = b""
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray | None = None
    dev: np.ndarray | None = None
    weights: np.ndarray | None = None
    prior: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        own = pair(self.base, self.ordinary, self.toxic)
        x = np.array([own.features(marked(t)) for t in texts])
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.dev] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(toxic: list[bytes], ordinary: list[bytes], prior: float) -> Model:
    """Dictionaries and thresholds from labelled texts.

    How window gains become a score is calibrated by a logistic fit on gains
    that dictionaries of other texts give (FOLDS parts), and for the share of
    toxic rows ``prior``. With fewer than 2 * FOLDS texts of a class there is
    no model but the prior.
    """
    if min(len(toxic), len(ordinary)) < 2 * FOLDS:
        return Model(prior=prior)
    toxic, ordinary = [marked(t) for t in toxic], [marked(t) for t in ordinary]
    x, y = [], []
    for f in range(FOLDS):
        others = [[t for i, t in enumerate(texts) if i % FOLDS != f] for texts in (toxic, ordinary)]
        judge = Pair(*learn(*others))
        for texts, label in ((toxic, 1.0), (ordinary, 0.0)):
            x += [judge.features(t) for t in texts[f::FOLDS]]
            y += [label] * len(texts[f::FOLDS])
    mean, dev, weights = logistic(np.array(x), np.array(y))
    odds = lambda p: np.log(max(p, 1e-4) / max(1 - p, 1e-4))
    weights[0] += odds(prior) - odds(float(np.mean(y)))
    return Model(*learn(toxic, ordinary), mean, dev, weights, prior)


def fold(doc_id: str = "doc_id") -> F.Column:
    """Remainder by 5 of the CRC-32 of an id's text; rows with 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, ordinary: int = TRAIN_ORDINARY, chars: int = TRAIN_CHARS) -> Model:
    """Model from at most ``toxic`` + ``ordinary`` labelled rows of at most ``chars`` characters that aren't held out.

    The rows are picked by the hash of their id and, where rows repeat an id,
    of their text, so that neither order nor partitioning matters.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(fold() != 0)
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    texts = common.documents(docs).where(F.length("text") <= chars)
    rows: dict[int, list[bytes]] = {}
    for y, limit in ((1, toxic), (0, ordinary)):
        ids = known.where(F.col("y") == y).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        got = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(limit).collect()  # at most limit rows
        rows[y] = [r["text"].encode() for r in got]
    total = sum(counts.values())
    return train(rows[1], rows[0], counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Toxicity of whole texts: doc_id, held_out, score, predicted.

    Every window of a text is compressed with both dictionaries; the highest
    gains, their mean and the share of windows over a threshold make the score.
    Only the text enters it. No shuffle but for the bounded training sample.
    Null text is empty and has the score of no windows; a null doc_id is held
    out of nothing (held_out false). Without both labels all scores are the
    share of label 1. Every input row gives one row; equal texts have equal
    scores; an empty table gives none. A long text is read window by window:
    beside it there are a marked copy and two bytes for each window.
    """
    model = model or fit(docs, labels)

    def f(texts: list[bytes], rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.scores(texts), pa.float64())], ["doc_id", "score"])

    scored = common.map_text(common.documents(docs), f, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under 0.5.

    Null text counts as empty; repeated rows stay or go together; an empty
    table gives an empty one.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.chunks(batches, "text"):
            yield rows.filter(pa.array(model.scores(texts) < 0.5))

    return common.small_batches(docs).mapInArrow(run, docs.schema)
