"""Byte-pair encoding by dynamic programming over word prefixes."""

from __future__ import annotations

import gc
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inundata.llm import common

#: Words that a worker remembers with their ids, and as many older ones; pairs of tokens that it remembers.
REMEMBERED, PAIRS = 250_000, 600_000
#: Letters below this code point are normalised here, texts with others by the library's normaliser.
PLAIN = 0x200
#: Bytes of a longer text that are encoded at a time; cut at white space, which no word reaches beyond.
PART_BYTES = 4_000_000

#: Fixed values of the vocabulary's format: how the file's words are split.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": None, "ignore_merges": None}

#: In place of the token before: a word's start, and a prefix without an encoding (yet).
START, OPEN = -1, -2
#: Bytes that the plain path leaves to the library: lead bytes from PLAIN on, a letter that grows in lower case, unusual white space, and the beginning of added tokens.
_ODD = re.compile(rb"[\xc8-\xff\x1c-\x1f]|\xc4\xb0|\xc2[\x85\xa0]|<\|")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def pack(ids: list[int]) -> bytes:
    """Unsigned 32-bit integers, little-endian."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class PairTable:
    """Which tokens may follow each other in an encoding.

    Tokens are strings of letters: a byte, or for a word's last byte 256 more.
    Each token but the single letters comes from one merge, whose place in the
    list is its rank. While two neighbouring tokens are built, the symbols at
    their border go through a chain: each exists from its own merge to that of
    the next in the chain. If a merge of the two border symbols comes first at
    any time, the border would vanish, and the pair can't occur.
    """

    def __init__(self, parts: dict[int, tuple[int, int]], rank: dict[int, int], merges: dict[tuple[int, int], int]) -> None:
        self.parts, self.rank, self.merges = parts, rank, merges
        self.chains: tuple[dict, dict] = ({}, {})

    def chain(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, rank of its merge) at the right (1) or left (0) end of a token, the newest first; letters have rank -1."""
        known = self.chains[side].get(token)
        if known is None:
            rest = self.chain(self.parts[token][side], side) if token in self.parts else []
            known = self.chains[side][token] = [(token, self.rank.get(token, -1)), *rest]
        return known

    def fits(self, left: int, right: int, until: float = float("inf")) -> bool:
        """Goes back in time from ``until``: the later born of the two border symbols falls into its parts."""
        xs, ys = self.chain(left, 1), self.chain(right, 0)
        get, i, j, x_end, y_end = self.merges.get, 0, 0, until, until
        while True:
            (x, x_born), (y, y_born) = xs[i], ys[j]
            at = get((x, y))
            if at is not None and at < x_end and at <= y_end and at < until:  # of equal merges the left one comes first
                return False
            if x_born < 0 and y_born < 0:
                return True
            if x_born >= y_born:
                i, x_end = i + 1, x_born
            if y_born >= x_born:
                j, y_end = j + 1, y_born


def _kinds() -> np.ndarray:
    """For each code point of at most two bytes 0 for white space, 1 for letters, 2 for numbers, 3 for others."""
    of = [next(k for k, p in enumerate((r"\s", r"\p{L}", r"\p{N}", r"(?s).")) if regex.match(p, chr(c))) for c in range(0x800)]
    return np.array(of, np.uint8)


_KIND = _kinds()
_ENDINGS = {1: (b"s", b"t", b"m", b"d"), 2: (b"re", b"ve", b"ll")}


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-case letters below PLAIN: the bytes without white space, where words start in them, and which bytes these are.

    Does what WORDS does: runs of letters, single numbers, runs of the rest,
    and an apostrophe alone with one of a few endings. The data end in three
    white bytes.
    """
    kind = _KIND[np.minimum(data, 0x7F)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        kind[lead] = kind[lead + 1] = _KIND[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    new = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= (kind == 2) & ((data & 0xC0) != 0x80)
    quote = np.flatnonzero((data[:-1] == 0x27) & new[:-1] & (kind[1:] == 1) & new[1:])
    for i in quote.tolist():
        for n, endings in _ENDINGS.items():
            if data[i + 1 : i + 1 + n].tobytes() in endings:
                new[i + 1] = False
                new[i + 1 + n] = True
                break
    solid = kind > 0
    return data[solid], np.flatnonzero(new[solid]), solid


class Encoder:
    """Exact ids of texts for one vocabulary file, word by word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_format(spec)
        vocab, added = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.value = value = {c: b for b, c in enumerate(byte_letters())}

        def letters(token: str) -> str:
            last = token.endswith(END)
            codes = [value[c] for c in (token[: -len(END)] if last else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * last)

        names = [""] * (1 + max([*vocab.values(), *added.values()]))
        for name, i in [*vocab.items(), *added.items()]:
            names[i] = name
        self.names = pa.array([f"{name} ".encode() for name in names], pa.binary())
        parts, rank, merges = {}, {}, {}
        for at, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            parts[z], rank[z], merges[x, y] = (x, y), at, at
        self.pairs = PairTable(parts, rank, merges)
        whole: dict[int, bool] = {}
        self.matcher, self.fitting, self.n_pairs = ahocorasick.Automaton(), [], 0
        for name, i in sorted(vocab.items(), key=lambda x: rank.get(x[1], -1)):
            if name in added:
                continue
            if i in parts:  # a token that its own letters don't encode to never occurs
                x, y = parts[i]
                whole[i] = whole[x] and whole[y] and self.pairs.fits(x, y, rank[i])
            else:
                whole[i] = True
            if whole[i]:
                fitting: dict[int, bool] = {START: True, OPEN: False}  # by the token before
                self.fitting.append(fitting)
                self.matcher.add_word(letters(name), (i, len(letters(name)), fitting))
        self.matcher.make_automaton()
        self.added = {k: pack([v]) for k, v in added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in added) + ")") if added else None
        self.path, self.library = path, None
        self.words = _Held(self.word, REMEMBERED)

    def word(self, data: bytes) -> bytes:
        """ids of one word (UTF-8), packed as little-endian unsigned 32-bit integers.

        ``last[e]`` is the last token of the encoding of the first e letters.
        It is unique: of the tokens that end there, only one fits the last
        token of the prefix before it. The ids follow from the whole word back.
        """
        letters = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        n = len(letters)
        last, sizes = [OPEN] * (n + 1), [0] * (n + 1)
        last[0] = START
        for end, (token, size, fitting) in self.matcher.iter(letters):
            end += 1
            if last[end] == OPEN:
                before = last[end - size]
                ok = fitting.get(before)
                if ok is None:
                    ok = self.fit(before, token, fitting)
                if ok:
                    last[end], sizes[end] = token, size
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= sizes[at]
        ids.reverse()
        return pack(ids)

    def fit(self, before: int, token: int, fitting: dict[int, bool]) -> bool:
        """Tests and remembers a pair; all are forgotten when there are too many."""
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            for f in self.fitting:
                f.clear()
                f[START], f[OPEN] = True, False
            self.n_pairs = 1
        ok = fitting[before] = self.pairs.fits(before, token)
        return ok

    def by_library(self, text: str) -> bytes:
        """ids of a text whose letters Unicode tables may disagree on: the library normalises and splits it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join(self.words[bytes(map(self.value.__getitem__, x))] for x, _ in parts)

    def odd(self, text: str) -> bytes:
        """ids of one text with added tokens, letters that tables may disagree on or unusual white space."""
        if self.split_added and "<|" in text:
            return b"".join(self.added.get(part) or (self.by_library(part) if part else b"") for part in self.split_added.split(text))
        return self.by_library(text)

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """ids of texts with letters below PLAIN alone. Each distinct word is looked up once, and its ids are gathered by number."""
        joined = b"\n".join(texts) + b"\n\n\n"
        joined = joined.lower() if joined.isascii() else joined.decode("utf-8").lower().encode("utf-8")  # as long as before
        letters, starts, solid = split_words(np.frombuffer(joined, np.uint8))
        if not len(starts):
            return [b""] * len(texts)
        offsets = np.append(starts, len(letters)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        ids = pa.array(map(self.words.__getitem__, coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        at, whole = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1], ids.buffers()[2].to_pybytes()
        first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        borders = np.cumsum([0, *np.add.reduceat(solid, first, dtype=np.int64)])
        cuts = at[np.searchsorted(starts, borders)].tolist()
        return [whole[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text (UTF-8)."""
        parts = [_parts(t) for t in texts]
        ids = iter([x for some in _batches([p for own in parts for p in own], PART_BYTES) for x in self.some(some)])
        return [b"".join(next(ids) for _ in own) for own in parts]

    def some(self, texts: list[bytes]) -> list[bytes]:
        ok = [not _ODD.search(t) for t in texts]
        plain = iter(self.plain([t for t, o in zip(texts, ok) if o]))
        return [next(plain) if o else self.odd(t.decode("utf-8", "replace")) for t, o in zip(texts, ok)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode()])[0]

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """Tokens joined by spaces, as the library does for a file without decoder (UTF-8)."""
        out: list[bytes] = []
        for group in _batches(ids):
            names = self.names.take(pa.array(np.frombuffer(b"".join(group), "<u4").astype(np.int32)))
            if not len(names):
                out += [b""] * len(group)
                continue
            at, whole = np.frombuffer(names.buffers()[1], np.int32)[: len(names) + 1], names.buffers()[2].to_pybytes()
            cuts = at[np.cumsum([0, *(len(x) // 4 for x in group)])].tolist()
            out += [whole[i : max(i, j - 1)] for i, j in zip(cuts, cuts[1:])]
        return out

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0].decode()


def _batches(items: list[bytes], limit: int = 4 * PART_BYTES) -> Iterator[list[bytes]]:
    """Runs of the items of about ``limit`` bytes; longer ones are alone."""
    some, size = [], 0
    for x in items:
        if some and size + len(x) > limit:
            yield some
            some, size = [], 0
        some.append(x)
        size += len(x)
    if some:
        yield some


def _parts(text: bytes) -> list[bytes]:
    """A text, if long in parts that begin at a space."""
    if len(text) <= PART_BYTES:
        return [text]
    out, at = [], 0
    while len(text) - at > PART_BYTES:
        cut = text.find(b" ", at + PART_BYTES)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def check_format(spec: dict) -> None:
    """Raises ValueError for a file whose normaliser, splitter, model or decoder isn't the one implemented here."""
    wanted = {"normalizer": NORMALIZER, "pre_tokenizer": SPLITTER, "decoder": None}
    for part, want in wanted.items():
        if spec.get(part) != want:
            raise ValueError(f"the vocabulary file's {part} isn't supported: {spec.get(part)}")
    for key, want in MODEL.items():
        if (spec["model"].get(key) or None) != want:
            raise ValueError(f"the vocabulary file's model has an unsupported {key}: {spec['model'].get(key)}")


class _Held(dict):
    """Results of ``f`` by text. When there are ``most``, they become the old ones, which are looked up once more before they go."""

    def __init__(self, f, most: int) -> None:
        super().__init__()
        self.f, self.most, self.old = f, most, {}

    def __missing__(self, text) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.f(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file; its tables are left out of garbage collection, which runs seldom."""
    made = Encoder(path)
    gc.collect()
    gc.freeze()
    gc.set_threshold(100_000, 50, 100)
    return made


def encode(docs: DataFrame, path: str) -> DataFrame:
    """ids and decoded text of whole texts: doc_id, n_tokens, ids (packed unsigned 32-bit, little-endian), decoded.

    ``path`` names a vocabulary file that every executor has. No shuffle; null
    text is empty and has no ids; every input row gives one row, whatever else
    it repeats. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for rows, texts in common.chunks(batches, "text"):
            ids = e.encode_all(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(e.decode_all(ids), pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return common.documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
