"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of leaves, one a symbol; leaf i holds rank * width + i for the pair that starts at
symbol i, so the root of the minimum tree is the leftmost pair of lowest rank. A merge changes three
leaves (the pair, its left neighbour, the symbol that went away), each in log(width) steps up the tree;
it ends when the root holds no pair. Words of one width go through these steps together as numpy rows.

Text is prepared as the vocabulary file says: parts equal to an added token are that token; the rest is
NFC, white space to blanks, lower case, split into words; a word is its UTF-8 bytes, the last one with
the end mark. Decoding joins the tokens by blanks, as a file without decoder asks.

Defined results: null text is empty: no ids, empty decoded text. Repeated rows are encoded each. Very
long words have a tree of their own width. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex
from tokenizers.normalizers import NFC
from tokenizers.pre_tokenizers import Split

NONE = np.iinfo(np.int64).max
CACHE_WORDS = 150_000
ROWS_AT_ONCE = 1 << 21
BLANKS = re.compile(r"[^\S\x1c-\x1f]+")
LETTER = regex.compile(r"[\p{L}\p{N}]").match
HAS_SEPARATOR = re.compile(r"[\x1c-\x1f]").search


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


class SegmentTreeBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.tokens = {i: t for t, i in (vocab | added).items()}
        self.part = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(pattern)
        # The file means the letters and digits of its own library; those of a newer Unicode are symbols.
        unsure = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and LETTER(c)]
        theirs = Split(Regex(r"[\p{L}\p{N}]+"), "removed", invert=True).pre_tokenize_str(" ".join(unsure))
        self.newer = frozenset(unsure).difference(*(part for part, _ in theirs))
        some = "".join(map(regex.escape, sorted(self.newer)))
        old = pattern.replace(r"[\p{L}]+", rf"[\p{{L}}--[{some}]]+").replace(r"[\p{N}]", rf"[\p{{N}}--[{some}]]")
        old = old.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{some}])+")
        self.old_word = regex.compile("(?V1)" + old) if some else self.word
        # Marks of a newer Unicode are no marks to the library: nothing is ordered or composed across them.
        marks = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c)]
        low, high = "\u0334", "\u0315"  # marks of the least class, and of a high one
        known = NFC()
        fixed = [c for c in marks if all(known.normalize_str(t) == t != unicodedata.normalize("NFC", t) for t in self._disordered(c, low, high))]
        self.fixed_marks = re.compile("([" + "".join(fixed) + "])") if fixed else None
        letters = byte_letters()
        self.first = np.array([vocab.get(c, -1) for c in letters], dtype=np.int64)
        self.last = np.array([vocab.get(c + self.end, -1) for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = max(self.tokens) + 2
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.id_text = {i: str(i) for i in self.tokens}
        # by word between blanks: ids and tokens, as blank-joined text
        self.ids_of: dict[str, str] = {}
        self.tokens_of: dict[str, str] = {}

    @staticmethod
    def _disordered(mark: str, low: str, high: str) -> list[str]:
        """Texts in which a mark of its class changes places with its neighbour."""
        own = unicodedata.combining(mark)
        texts = ["q" + mark + low] if own > unicodedata.combining(low) else []
        return texts + (["q" + high + mark] if own < unicodedata.combining(high) else [])

    def nfc(self, text: str) -> str:
        """Canonical composition as the library has it."""
        if self.fixed_marks is None or not self.fixed_marks.search(text):
            return unicodedata.normalize("NFC", text)
        return "".join([unicodedata.normalize("NFC", part) for part in self.fixed_marks.split(text)])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the vocabulary has no such merge or a side is missing (-1)."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], NONE)

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """ids: (words, width), width a power of two, -1 behind the end. Symbols that went away become -1."""
        n, width = ids.shape
        rows = np.arange(n)
        pos = np.arange(width)
        after = np.broadcast_to(pos + 1, (n, width)).copy()
        before = np.broadcast_to(pos - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        if width > 1:
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            tree[:, width : 2 * width - 1] = np.where(rank == NONE, NONE, rank * width + pos[:-1])
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = rows[tree[:, 1] != NONE] if width > 1 else rows[:0]
        while live.size:
            top = tree[live, 1]
            at, rank = top % width, top // width
            gone = after[live, at]
            ids[live, at] = self.merged[rank]
            ids[live, gone] = -1
            right = after[live, gone]
            after[live, at] = right
            inside = right < width
            before[live[inside], right[inside]] = at[inside]
            left = before[live, at]
            right_id = np.where(inside, ids[live, np.minimum(right, width - 1)], -1)
            left_id = np.where(left >= 0, ids[live, np.maximum(left, 0)], -1)
            here = self._rank(ids[live, at], right_id)
            there = self._rank(left_id, ids[live, at])
            nothing = np.full(live.size, NONE)
            self._set(tree, live, width, gone, nothing)
            self._set(tree, live, width, at, np.where(here == NONE, NONE, here * width + at))
            some = left >= 0
            value = np.where(there == NONE, NONE, there * width + left)
            self._set(tree, live[some], width, left[some], value[some])
            live = live[tree[live, 1] != NONE]
        return ids

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, width: int, at: np.ndarray, value: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def ids_of_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (white space inside is not expected)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(b) for b in raw], dtype=np.int64)
        out: list[list[int]] = [[] for _ in words]
        width_of = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        for width in np.unique(width_of):
            chosen = np.flatnonzero((width_of == width) & (length > 0))
            step = max(1, ROWS_AT_ONCE // int(width))
            for start in range(0, len(chosen), step):
                part = chosen[start : start + step]
                size = length[part]
                flat = np.frombuffer(b"".join(raw[i] for i in part), dtype=np.uint8)
                row = np.repeat(np.arange(len(part)), size)
                col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                ids = np.full((len(part), int(width)), -1, dtype=np.int64)
                ids[row, col] = self.first[flat]
                ids[np.arange(len(part)), size - 1] = self.last[flat[np.cumsum(size) - 1]]
                done = self._merge(ids)
                there = done >= 0
                flat, ends = done[there].tolist(), np.cumsum(there.sum(axis=1)).tolist()
                begin = 0
                for i, end in zip(part.tolist(), ends, strict=True):
                    out[i] = flat[begin:end]
                    begin = end
        return out

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens of a text; the latter start with a blank, which no word has."""
        if text.isalpha():
            low = text.lower() if text.isascii() else lower(self.nfc(text))
            if low.isalpha():
                return [low]
        parts = self.part.split(text) if self.part and "<" in text else [text]
        found: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                found.append(" " + part)
            else:
                clean = part.lower() if part.isascii() else lower(self.nfc(part))
                found += (self.word if clean.isascii() or self.newer.isdisjoint(clean) else self.old_word).findall(clean)
        return found

    def learn(self, words: set[str]) -> None:
        """Puts the ids and tokens of words without white space in the cache."""
        if len(self.ids_of) > CACHE_WORDS:
            self.ids_of.clear()
            self.tokens_of.clear()
        new = list(words.difference(self.ids_of))
        split = [self.pieces(w) for w in new]
        distinct = list({p for pieces in split for p in pieces if p[0] != " "})
        ids = dict(zip(distinct, self.ids_of_words(distinct), strict=True))
        for name, number in self.added.items():
            ids[" " + name] = [number]
        for word, pieces in zip(new, split, strict=True):
            own = ids[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids[p]]
            self.ids_of[word] = " ".join([self.id_text[i] for i in own])
            self.tokens_of[word] = " ".join([self.tokens[i] for i in own])

    def coded(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Decimal ids and decoded text of each text, both joined by blanks.

        No word, merge or added token spans white space, so what stands between is coded by itself.
        """
        # str.split() also parts at the four separators U+001C to U+001F, which are no white space here
        split = [(BLANKS.split(t) if HAS_SEPARATOR(t) else t.split()) if t else [] for t in texts]
        missing: set[str] = set()
        for words in split:
            missing.update(words)
        missing.discard("")
        self.learn(missing)
        ids_of, tokens_of = self.ids_of, self.tokens_of
        ids_of[""] = tokens_of[""] = ""
        for words in split:
            ids = " ".join(map(ids_of.__getitem__, words))
            tokens = " ".join(map(tokens_of.__getitem__, words))
            if "  " in ids or ids[:1] == " " or ids[-1:] == " ":  # a word without tokens
                ids = " ".join(ids.split())
                tokens = " ".join([x for x in map(tokens_of.__getitem__, words) if x])
            yield ids.encode(), tokens.encode()

    def encode(self, text: str | None) -> list[int]:
        ids, _ = next(self.coded([text]))
        return [int(x) for x in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


# Lower case of the letters that Unicode 16 added.
LOWER_16 = {0x10D50 + i: 0x10D70 + i for i in range(22)} | {0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0x1C89: 0x1C8A}


def lower(text: str) -> str:
    """Lower case letter by letter: unlike str.lower(), a final sigma is as any sigma."""
    low = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
    return low.translate(LOWER_16) if max(low) >= "\u1c89" else low


_coders: dict[str, SegmentTreeBPE] = {}


def coder(path: str) -> SegmentTreeBPE:
    if path not in _coders:
        _coders[path] = SegmentTreeBPE(path)
    return _coders[path]


def _slices(batch: pa.RecordBatch, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, most_rows):
        yield batch.slice(start, most_rows)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) as blank-joined text; one row a document."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for whole in batches:
            for batch in _slices(whole):
                done = list(own.coded(batch.column("text").to_pylist()))
                ids = [i for i, _ in done]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([i.count(b" ") + 1 if i else 0 for i in ids], pa.int64()),
                        pa.array([i.decode() for i in ids], pa.string()),
                        pa.array([d.decode() for _, d in done], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids string, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); digests are made where the ids are."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for whole in batches:
            for batch in _slices(whole):
                done = list(own.coded(batch.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([i.count(b" ") + 1 if i else 0 for i, _ in done], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i, _ in done]),
                        pa.array([hashlib.sha256(d).hexdigest() for _, d in done]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
