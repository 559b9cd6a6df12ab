"""Secrets in texts: fixed patterns, and character Markov models for the rest."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inundata.llm import common

#: Kinds in their order, and patterns. All classes are ASCII, so bytes match as code points would.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Symbols of the models: 0 for a run's start, then the letters of a run.
ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(ALPHABET)] = np.arange(1, len(ALPHABET) + 1)
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

#: Documents whose words train the models, the longest text among them, and made-up strings of each alphabet.
TRAIN_DOCUMENTS, TRAIN_CHARS, TRAIN_STRINGS = 2000, 50_000, 2000
#: Shortest run that the models judge.
RUN_LEAST = 16


def runs(data: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes of at least this length."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = member[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= least
    return start[long], end[long]


@dataclass
class Model:
    """Log-likelihood ratio of one character after another, and the mean ratio from which a run is random."""

    ratio: np.ndarray
    threshold: float = 0.0

    def score(self, run: bytes) -> float:
        at = SYMBOL[np.frombuffer(run, np.uint8)]
        return float(self.ratio[np.concatenate(([0], at[:-1])), at].mean())


def _pairs(words: list[bytes]) -> np.ndarray:
    """Counts of one symbol after another."""
    n = len(ALPHABET) + 1
    data = np.concatenate([np.concatenate(([0], SYMBOL[np.frombuffer(w, np.uint8)])) for w in words]) if words else np.zeros(1, np.int64)
    pairs = data[:-1] * n + data[1:]
    return np.bincount(pairs[data[1:] > 0], minlength=n * n).reshape(n, n).astype(float)


def _logs(counts: np.ndarray) -> np.ndarray:
    counts = counts + 0.1
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def train(texts: list[bytes], seed: int = 7) -> Model:
    """Models from labelled samples: words of the texts, and secrets in them with made-up random strings.

    A run of the texts is labelled random if a fixed pattern finds it. What no
    pattern finds may be a secret all the same, if it is long enough to be
    judged: a first model, of shorter runs and made-up decimal numbers, tells
    which of these runs are ordinary and train the second. The threshold is a
    ratio of 0, where both are as likely; no unlabelled run moves it.
    """
    ordinary, open_, found = [], [], []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        touched = touching(base_spans(text))
        for i, j in zip(*(x.tolist() for x in runs(data, SYMBOL > 0, 3))):
            inside = touched(i, j)
            if j - i >= RUN_LEAST:
                (found if inside else open_).append(text[i:j])
            elif not inside:
                ordinary.append(text[i:j])
    rng = random.Random(seed)
    letters = ALPHABET.decode()
    draw = lambda *alphabets: ["".join(rng.choices(a, k=rng.randint(RUN_LEAST, 48))).encode() for a in alphabets for _ in range(TRAIN_STRINGS)]
    secret = _logs(_pairs(found + draw(letters[:62], letters[:64], letters[26:62], letters[:26] + letters[52:62], "0123456789abcdef")))
    sure = _pairs(ordinary + draw("0123456789"))
    first = Model(secret - _logs(sure))
    return Model(secret - _logs(sure + _pairs([w for w in open_ if first.score(w) <= first.threshold])))


def base_spans(text: bytes, data: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes of what the fixed patterns find, leftmost and non-overlapping for each kind."""
    out = []
    low = common.ascii_lower(text)
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(int(i), int(j), 2) for i, j in zip(*runs(np.frombuffer(text, np.uint8) if data is None else data, _HEX, HEX_LEAST))]
    return sorted(out)


def touching(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether any of the sorted spans overlaps a range."""
    starts, ends = [s for s, _, _ in spans], list(accumulate((e for _, e, _ in spans), max))

    def f(i: int, j: int) -> bool:
        before = bisect_left(starts, j)
        return before > 0 and ends[before - 1] > i

    return f


def scan(text: bytes, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, in bytes; the models add runs that no base span touches."""
    data = np.frombuffer(text, np.uint8)
    base, more = base_spans(text, data), []
    touched = touching(base)
    for i, j in zip(*(x.tolist() for x in runs(data, SYMBOL > 0, RUN_LEAST))):
        if not touched(i, j) and model.score(text[i:j]) > model.threshold:
            more.append((i, j, 3))
    return base, sorted(base + more)


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii() or not spans:
        return spans
    before = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=before[1:])
    return [(int(before[i]), int(before[j]), k) for i, j, k in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for i, j, k in spans)


def fit(docs: DataFrame, limit: int = TRAIN_DOCUMENTS, chars: int = TRAIN_CHARS) -> Model:
    """Model from the words of at most ``limit`` documents of at most ``chars`` characters.

    They are picked by the hash of their id and, where rows repeat an id, of
    their text, so that neither order nor partitioning matters.
    """
    docs = common.documents(docs)
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    some = docs.join(F.broadcast(ids), "doc_id").where(F.length("text") <= chars)
    rows = some.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(limit).select("text").collect()  # at most limit rows
    return train(sorted(r["text"].encode() for r in rows))


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Spans of secrets in whole texts: doc_id, n_assign, n_access, n_hex, base, spans.

    ``base`` lists what the fixed patterns find as kind:start:end in code
    points, ``spans`` the same with the runs that look random to the models:
    maximal runs of identifier letters whose mean log-likelihood ratio between
    random strings and ordinary identifiers is over the threshold. No shuffle.
    Null text is empty; every input row gives one row, equal texts equal ones.
    A long text is scanned at once, at about 20 times its bytes. An empty table
    gives an empty result.
    """
    model = model or fit(docs)

    def f(texts: list[bytes], rows: pa.RecordBatch) -> pa.RecordBatch:
        counts, base, spans = [], [], []
        for text in texts:
            own, every = scan(text, model)
            counts.append([sum(k == kind for *_, k in own) for kind in range(3)])
            base.append(joined(in_code_points(text, own)))
            spans.append(joined(in_code_points(text, every)))
        cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), *cols, pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return common.map_text(common.documents(docs), f, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every found span replaced by ``mark``; n_chars, if there, is counted anew.

    All columns and rows stay; null text stays null.
    """
    model = model or fit(docs)
    names, put = docs.columns, mark.encode()

    def clean(text: bytes) -> bytes:
        spans, out, at = scan(text, model)[1], [], 0
        for i, j, _ in spans:
            if j > at:
                out += [text[at : max(at, i)], put if i >= at else b""]
                at = j
        return b"".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in common.chunks(batches, "text"):
            null = rows.column("text").is_null().to_pylist()
            done = [None if n else clean(t) for t, n in zip(texts, null)]
            new = {"text": pa.array(done, pa.binary()).cast(pa.string())}
            if "n_chars" in names:
                kind = rows.column("n_chars").type
                new["n_chars"] = pa.array([old if d is None or d == t else len(d.decode("utf-8", "replace")) for d, t, old in zip(done, texts, rows.column("n_chars").to_pylist())], kind)
            yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in names], names)

    return common.small_batches(docs).mapInArrow(run, docs.schema)
