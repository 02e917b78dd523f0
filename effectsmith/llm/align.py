"""Alignment of the tokens of two tokenizers over the same bytes.

Both encode a blank and the text. Tokens are rows (document, place of the first byte, number); a batch of
documents is merged with ``pandas.merge_asof`` in both directions, keyed by document: each token start
finds the token of the other side that covers it. The union of both directions is all pairs of tokens that
overlap. Places where tokens of both sides end cut the tokens into groups.

How often a pair of ids is linked corpus-wide, in documents, needs one pass: each batch keeps its distinct
pairs with the number of its documents that hold them, so the shuffle carries distinct pairs of batches and
not links, whatever text is common. The counts go back to the batches by the same key; nothing is broadcast.
They meet the batch's documents as sorted rows, a batch at a time, so no task holds the lists of several batches.

Defined results: null and empty texts, and texts whose joined tokens are not the bytes of blank and text on
either side (U+2581 in a text, say), have no tokens: zeros and ''. Repeated rows are aligned each, and each
counts as a document. Only doc_id and text are read. A batch holds the tokens of its texts: memory goes
with the longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from effectsmith.functions.lineage import written
from effectsmith.llm.bpe import byte_letters

#: Rows and characters of a batch of documents.
BATCH_ROWS, BATCH_CHARS = 1000, 1_000_000
#: Batches of a row group of the table between the passes: a row has up to some hundred thousand links.
GROUP_BATCHES = 8
CACHE_SEGMENTS = 500_000
#: Texts of these characters have no white space but blank and line end. No token of either side goes on over the
#: place between another character and one of these two, or between a letter and a mark: the segments between
#: such places are encoded once. Other texts are encoded whole.
CUTTABLE = re.compile("[\n\x20-\x7e¡-ɏ]*")
SEGMENT = re.compile("[ \n]+(?:[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[,.!?:;*#%$&])|[^ \n]*)|[,.!?:;*#%$&][^ \n]*")


class Aligner:
    """Both vocabularies, and the segments encoded so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        entries = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.blank = self.b.piece_to_id("▁")
        # a token's text in a group's list, by what follows it: another token of its side, or the side's end
        names = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.names = [n + end for end in (b",", b"|", b";") for n in names]
        self.width = len(names)
        self.clear()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]  # of each segment, and behind the last
        self.fine = np.zeros(0, bool)

    def _encoded_a(self, segments: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, one after another, and how many each has. Those that start with a blank are
        encoded together: no token goes on from one to the next."""
        sizes = np.zeros(len(segments), np.int64)
        ids: list[np.ndarray] = []
        blank = np.array([s[0] in " \n" and CUTTABLE.fullmatch(s) is not None for s in segments], dtype=bool)
        together = np.flatnonzero(blank)
        got = self.a.encode_batch_fast(["".join([segments[i] for i in together]), *(segments[i] for i in np.flatnonzero(~blank))], add_special_tokens=False)
        first = np.array(got[0].ids, dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.a_size[first]), np.cumsum([len(raw[i]) for i in together]), side="right")
        sizes[together] = np.diff(ends, prepend=0)
        rest = [e.ids for e in got[1:]]
        sizes[~blank] = [len(x) for x in rest]
        # back to the order of the segments
        begin = np.zeros(len(segments), np.int64)
        begin[together] = ends - sizes[together]
        begin[~blank] = len(first) + np.cumsum(sizes[~blank]) - sizes[~blank]
        ids = np.concatenate([first, np.fromiter(chain.from_iterable(rest), np.int64, int(sizes[~blank].sum()))])
        inside = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return ids[np.repeat(begin, sizes) + inside], sizes

    def _encoded_b(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a blank is put in front: it stands for the segment's own; else a line end keeps it apart, and both go again
        got = self.b.encode([s[1:] if s[0] == " " else "\n" + s for s in segments], num_threads=1)
        got = [ids or [self.blank] if s[0] == " " else ids[2:] for s, ids in zip(segments, got, strict=True)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int64, int(sizes.sum())), sizes

    def learn(self, segments: set[str]) -> None:
        """Encodes the segments that are new."""
        new = list(segments.difference(self.number))
        if not new:
            return
        raw = [s.encode() for s in new]
        fine = np.ones(len(new), bool)
        for k, (table, (ids, sizes)) in enumerate(((self.a_bytes, self._encoded_a(new, raw)), (self.b_bytes, self._encoded_b(new)))):
            parts = list(map(table.__getitem__, ids.tolist()))
            if b"".join(parts) != b"".join(raw):
                ends = np.cumsum(sizes).tolist()
                fine &= [b"".join(parts[lo:hi]) == r for lo, hi, r in zip([0, *ends], ends, raw, strict=False)]
            self.flat[k] = np.concatenate([self.flat[k], ids])
            self.first[k] = np.concatenate([self.first[k], self.first[k][-1] + np.cumsum(sizes)])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.fine = np.concatenate([self.fine, fine])

    def tokens(self, texts: list[str | None]) -> list[pd.DataFrame]:
        """Tokens of side A and of side B: (doc, id, start) with the document's number and the token's first
        byte, counted over all documents of the batch that have tokens."""
        segments = [(SEGMENT.findall(" " + t) if CUTTABLE.fullmatch(t) else [" " + t]) if t else [] for t in texts]
        known = set(chain.from_iterable(segments))
        if len(known) + len(self.number) > CACHE_SEGMENTS:
            self.clear()
        self.learn(known)
        n_segments = np.fromiter(map(len, segments), np.int64, len(segments))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(segments)), np.int64, int(n_segments.sum()))
        doc = np.repeat(np.arange(len(texts)), n_segments)
        spoilt = np.unique(doc[~self.fine[at]])
        if len(spoilt):
            keep = ~np.isin(doc, spoilt)
            at, doc = at[keep], doc[keep]
        sides = []
        for k, size in ((0, self.a_size), (1, self.b_size)):
            first = self.first[k]
            n = first[at + 1] - first[at]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids = self.flat[k][np.repeat(first[at], n) + inside]
            end = np.cumsum(size[ids])
            sides.append(pd.DataFrame({"doc": np.repeat(doc, n), "id": ids, "start": end - size[ids], "end": end}))
        return sides

    @staticmethod
    def links(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers in ``a`` and in ``b`` of all pairs of tokens that overlap."""
        # the key is document and place; both sides start at a document's first byte, so none is left for another's token
        own_a, own_b = (pd.DataFrame({"key": t["doc"] * (1 << 40) + t["start"], name: np.arange(len(t))}) for t, name in ((a, "i"), (b, "j")))
        over_a = pd.merge_asof(own_a, own_b, on="key")["j"].to_numpy()
        over_b = pd.merge_asof(own_b, own_a, on="key")["i"].to_numpy()
        # tokens that start together are found both ways
        later = a["start"].to_numpy()[over_b] < b["start"].to_numpy()
        return np.concatenate([np.arange(len(a)), over_b[later]]), np.concatenate([over_a, np.flatnonzero(later)])

    @staticmethod
    def groups(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Whether a group ends with each token of ``a`` and of ``b``: tokens of both sides end there."""
        a_end, b_end = a["end"].to_numpy(), b["end"].to_numpy()
        if not len(a_end):
            return np.zeros(0, bool), np.zeros(0, bool)
        last_a = b_end[np.searchsorted(b_end, a_end)] == a_end
        last_b = a_end[np.searchsorted(a_end, b_end)] == b_end
        return last_a, last_b

    def group_texts(self, a: pd.DataFrame, b: pd.DataFrame, n: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each of ``n`` documents; empty without tokens."""
        last_a, last_b = self.groups(a, b)
        before_a, before_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b  # groups before each token
        # a token's place: own side's tokens before it, and the other side's of earlier groups (side B: of its own too)
        ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        of_b, of_a = np.concatenate([[0], ends_b]), np.concatenate([[0], ends_a])
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + of_b[before_a]] = a["id"].to_numpy() + self.width * last_a
        code[np.arange(len(b)) + of_a[before_b + 1]] = b["id"].to_numpy() + self.width * 2 * last_b
        ends = np.cumsum(np.bincount(a["doc"], minlength=n) + np.bincount(b["doc"], minlength=n)).tolist()
        code = code.tolist()
        return [b"".join(map(self.names.__getitem__, code[lo:hi]))[:-1] for lo, hi in zip([0, *ends], ends, strict=False)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows and, but for a longer text, BATCH_CHARS characters."""
    for whole in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(whole.column("text")), 0).to_numpy(zero_copy_only=False)).tolist()
        start = 0
        while start < whole.num_rows:
            limit = (sizes[start - 1] if start else 0) + BATCH_CHARS
            end = max(start + 1, min(start + BATCH_ROWS, int(np.searchsorted(sizes, limit, side="right"))))
            yield whole.slice(start, end - start)
            start = end


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, start, stop): every pair of overlapping tokens, by their numbers in the
    document, with the bytes of blank and text that both cover."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in _batches(batches):
            a, b = own.tokens(batch.column("text").to_pylist())
            i, j = own.links(a, b)
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            doc = a["doc"].to_numpy()
            base = a.groupby("doc")["start"].transform("min").to_numpy()
            at = [t.groupby("doc").cumcount().to_numpy() for t in (a, b)]
            low = np.maximum(a["start"].to_numpy()[i], b["start"].to_numpy()[j]) - base[i]
            high = np.minimum(a["end"].to_numpy()[i], b["end"].to_numpy()[j]) - base[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc[i])), *map(pa.array, (at[0][i], at[1][j], a["id"].to_numpy()[i], b["id"].to_numpy()[j], low, high))],
                ["doc_id", "a_at", "b_at", "a_id", "b_id", "start", "stop"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, a_at long, b_at long, a_id long, b_id long, start long, stop long")


def _batch_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a batch of documents: batch number, its documents with their figures and the number of their
    distinct pairs, the batch's distinct pairs of ids (``codes``) with the number of documents that hold each,
    and, document by document, the places of its pairs in ``codes`` and how many links each has."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        number = TaskContext.get().partitionId() << 36
        for batch in _batches(batches):
            number, n = number + 1, batch.num_rows
            a, b = own.tokens(batch.column("text").to_pylist())
            i, j = own.links(a, b)
            doc = a["doc"].to_numpy()[i]
            place, codes = pd.factorize(a["id"].to_numpy()[i] * own.width + b["id"].to_numpy()[j])
            which, pairs = pd.factorize(doc * max(1, len(codes)) + place)
            occurs = np.bincount(which, minlength=len(pairs))
            order = np.argsort(pairs)
            pairs, occurs = pairs[order], occurs[order]
            place_of, doc_of = pairs % max(1, len(codes)), pairs // max(1, len(codes))
            last_a, _ = own.groups(a, b)
            count = lambda x: pa.array(np.bincount(x, minlength=n), pa.int64())
            digest = [hashlib.sha256(t).hexdigest() if t else "" for t in own.group_texts(a, b, n)]
            fields = {
                "doc_id": batch.column("doc_id"), "n_a": count(a["doc"]), "n_b": count(b["doc"]), "n_groups": count(a["doc"].to_numpy()[last_a]),
                "n_links": count(doc), "groups_sha256": pa.array(digest, pa.string()), "n_pairs": count(doc_of),
            }
            table = pa.StructArray.from_arrays(list(fields.values()), list(fields))
            one = lambda x, kind=pa.int32(): pa.array([x], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table), one(codes, pa.int64()),
                    one(np.bincount(place_of, minlength=len(codes))), one(place_of), one(occurs),
                ],
                ["batch", "docs", "codes", "n_docs", "place_of", "occurs"],
            )

    each = f"doc_id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,n_pairs:bigint"
    lists = ", ".join(f"{c} array<int>" for c in ("n_docs", "place_of", "occurs"))
    return rows.mapInArrow(run, f"batch long, docs array<struct<{each}>>, codes array<long>, {lists}")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    A pair's count is the number of documents that hold it linked; ``n_best`` counts links whose count is the
    highest of their A id, ``count_sum`` adds the counts of all links.
    """
    batches = written(_batch_links(docs, a_path, b_path), "token-links", GROUP_BATCHES)
    width = aligner(a_path, b_path).width
    pairs = batches.select("batch", F.posexplode(F.arrays_zip("codes", "n_docs")).alias("place", "p")).select("batch", "place", "p.codes", "p.n_docs")
    counts = pairs.groupBy("codes").agg(F.sum("n_docs").alias("count"))
    of_a = Window.partitionBy(F.floor(F.col("codes") / width))  # at most as many pairs as B has pieces
    counts = counts.select("codes", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))
    looked = pairs.join(counts, "codes").select(F.col("batch").alias("of_batch"), "place", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sums(own: pa.Table, found: pa.Table) -> pa.Table:
        """Of one batch; ``found`` is empty where no document has a token."""
        flat = lambda t, c: t.column(c).combine_chunks()
        table, at, occurs = (flat(own, c).flatten() for c in ("docs", "place_of", "occurs"))
        at, occurs, place = at.to_numpy(), occurs.to_numpy(), flat(found, "place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = flat(found, "count").to_numpy()
        best[place] = flat(found, "best").to_numpy(zero_copy_only=False)
        ends = np.cumsum(table.field("n_pairs").to_numpy())
        add = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))
        out = {c: table.field(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(out | {"n_best": add(occurs * best[at]), "count_sum": add(occurs * count[at]), "groups_sha256": table.field("groups_sha256")})

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    own = batches.select("batch", "docs", "place_of", "occurs")
    return own.groupBy("batch").cogroup(looked.groupBy("of_batch")).applyInArrow(sums, schema)
