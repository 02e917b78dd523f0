"""Language of texts by a linear-chain conditional random field over words.

Each word gets a label. Emissions are sums of weights of hashed features: all character runs of one to
four letters of the word with its start and end marked (so affixes are features of their own) and the
word itself (the lexicon). Transitions between labels of neighbouring words are learned too.
Forward-backward gives each word's label probabilities, so switches inside a text show; a document's
language is the label with the greatest mean probability, which is its score.

Training: all windows of WINDOW words of the whole texts of at most DOCS_PER_LANGUAGE documents a language
(those of least hash of the id and text, a bound on rows). Every word of a window carries its document's
label; some windows are spliced from two languages, which teaches the transitions. Each round computes the
gradient of chunks of CHUNK windows in tasks, as whole multiples of 1 / STEPS, so the sum is the same in any order;
the driver gets at most PARTS gradients of bounded size and no text. Languages are those that occur in the
training rows and are taken to be few (their weights fit the driver).

Defined results: null text or text without letters: ``und`` with score 0, no labels; a text whose labels
tie gets the first language by name; repeated rows are labelled each; without any training row all texts
are ``und``; an empty table gives an empty result. Only doc_id, text and (for training) lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

DOCS_PER_LANGUAGE = 250
WINDOW = 24
#: Windows of a chunk, tasks of a round, and steps of a gradient from 0 to 1.
CHUNK = 4096
PARTS = 8
STEPS = float(1 << 32)
BUCKETS = 1 << 16
ROUNDS = 18
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; none where all of them are number signs such as fractions, which are no letters."""
    words = WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of every word, word numbers ascending in each order."""
    marked = "".join([f"\x02{w}\x03" for w in words])
    letter = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    rows, buckets = [], []
    run = np.zeros(len(letter), dtype=np.uint64)
    for k in range(1, 5):
        run = run[: len(letter) - k + 1] * PRIME + letter[k - 1 :]
        inside = owner[: len(run)] == owner[k - 1 :]
        rows.append(owner[: len(run)][inside])
        buckets.append(run[inside] + np.uint64(k))
    place = np.arange(len(letter)) - np.repeat(np.cumsum(size) - size, size)
    whole = np.add.reduceat(letter * (PRIME ** (place.astype(np.uint64) % np.uint64(61) + np.uint64(1))), np.cumsum(size) - size)
    rows.append(np.arange(len(words)))
    buckets.append(whole)
    mixed = np.concatenate(buckets) * PRIME
    mixed ^= mixed >> np.uint64(29)
    return np.concatenate(rows), ((mixed * PRIME) >> np.uint64(48)).astype(np.int64) % BUCKETS


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """(words, languages) summed weights."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    row, bucket = features(words)
    return np.column_stack([np.bincount(row, weights=weights[bucket, c], minlength=len(words)) for c in range(weights.shape[1])])


def forward_backward(e: np.ndarray, length: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities (steps, sequences, labels) from emissions of the same shape, and the expected
    transitions. ``length``: words of each sequence, in any order; what lies behind an end is zero."""
    steps, n, k = e.shape
    live = np.arange(steps)[:, None] < length[None, :]
    e = np.exp(np.clip(e - e.max(axis=2, keepdims=True), -50, 0))
    a = np.exp(transition - transition.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[0] = e[0] / e[0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[t - 1] @ a) * e[t]
        x /= x.sum(axis=1, keepdims=True)
        alpha[t] = x
    moves = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        inner = e[t + 1] * beta[t + 1]
        x = inner @ a.T
        x /= x.sum(axis=1, keepdims=True)
        # a sequence that ends here starts over: nothing follows its last word
        beta[t] = np.where(live[t + 1][:, None], x, 1.0)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    p *= live[:, :, None]
    if steps <= WINDOW:  # training only
        for t in range(steps - 1):
            pair = alpha[t][:, :, None] * a[None] * (e[t + 1] * beta[t + 1])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moves += (pair * live[t + 1][:, None, None]).sum(axis=0)
    return p, moves


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transition: np.ndarray

    def label(self, texts: list[str | None]) -> list[np.ndarray]:
        """Label probabilities of every word of every text."""
        split = [words_of(t) for t in texts]
        number: dict[str, int] = {}
        coded = [np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) for words in split]
        names = list(number)
        e = np.concatenate([emissions(names[i : i + 10_000], self.weights) for i in range(0, len(names), 10_000)] or [np.zeros((0, len(self.languages)))])
        e = e.astype(np.float32)
        out = [np.zeros((0, len(self.languages)), dtype=np.float32)] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(coded[i])), key=lambda i: len(coded[i]))
        start = 0
        while start < len(order):
            # sequences of like length together, at most about 200,000 words with filling
            end = start + 1
            while end < len(order) and end - start < 512 and (end - start + 1) * len(coded[order[end]]) <= 200_000:
                end += 1
            part = order[start:end]
            length = np.array([len(coded[i]) for i in part])
            grid = np.zeros((length.max(), len(part)), dtype=np.int64)
            for j, i in enumerate(part):
                grid[: length[j], j] = coded[i]
            p, _ = forward_backward(e[grid], length, self.transition.astype(np.float32))
            for j, i in enumerate(part):
                out[i] = p[: length[j], j]
            start = end
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [row[:2] for row in self.read(texts)]

    def read(self, texts: list[str | None]) -> list[tuple[str, float, int, str | None, float]]:
        """(language, score, switches, second language, its share) of every text: the language of the greatest mean
        probability, and of the words' own labels how often they change, the most frequent other language (the
        first by name of equal ones) and the share of words that have it; null and 0 where all words agree."""
        if not self.languages:
            return [(UNKNOWN, 0.0, 0, None, 0.0)] * len(texts)
        out: list[tuple[str, float, int, str | None, float]] = []
        for p in self.label(texts):
            if not len(p):
                out.append((UNKNOWN, 0.0, 0, None, 0.0))
                continue
            mean = p.mean(axis=0, dtype=np.float64)
            best = int(mean.argmax())
            words = p.argmax(axis=1)
            held = np.bincount(words, minlength=len(self.languages))
            held[best] = 0
            other = int(held.argmax())
            second = (self.languages[other], float(held[other]) / len(words)) if held[other] else (None, 0.0)
            out.append((self.languages[best], min(max(float(mean[best]), 0.0), 1.0), int((words[1:] != words[:-1]).sum()), *second))
        return out

    def spans(self, text: str | None) -> list[tuple[str, str]]:
        """(word, language) of a code-switched text."""
        (p,) = self.label([text])
        return [(w, self.languages[int(i)]) for w, i in zip(words_of(text), p.argmax(axis=1) if len(p) else [], strict=True)]


@dataclass
class Chunk:
    """Coded windows: ``grid`` the word numbers and ``gold`` the labels by (place, window), ``length`` the words of each
    window, ``size`` the features of each word and ``bucket`` these features, word by word."""

    grid: np.ndarray
    gold: np.ndarray
    length: np.ndarray
    size: np.ndarray
    bucket: np.ndarray

    def pack(self) -> list[bytes]:
        return [x.astype(t).tobytes() for x, t in zip((self.grid, self.gold, self.length, self.size, self.bucket), PACKED.values(), strict=True)]

    @classmethod
    def unpack(cls, packed: list[bytes]) -> Chunk:
        grid, gold, length, size, bucket = (np.frombuffer(x, dtype=t).astype(np.intp) for x, t in zip(packed, PACKED.values(), strict=True))
        return cls(grid.reshape(WINDOW, -1), gold.reshape(WINDOW, -1), length, size, bucket)

    def gradient(self, weights: np.ndarray, transition: np.ndarray) -> np.ndarray:
        """Gradient of the log-likelihood by the weights, then by the transitions, in steps."""
        k, n_words = len(transition), len(self.size)
        row = np.repeat(np.arange(n_words), self.size)
        live = np.arange(WINDOW)[:, None] < self.length[None, :]
        e = np.column_stack([np.bincount(row, weights=w.take(self.bucket), minlength=n_words) for w in weights.T.copy()])
        p, moves = forward_backward(e[self.grid], self.length, transition)
        seen = np.bincount((self.gold[:-1] * k + self.gold[1:])[live[1:]], minlength=k * k).reshape(k, k)
        off = (np.eye(k)[self.gold] - p)[live].T
        words = self.grid[live]
        by_word = [np.bincount(words, weights=x, minlength=n_words) for x in off]
        g = np.column_stack([np.bincount(self.bucket, weights=x.take(row), minlength=BUCKETS) for x in by_word])
        return np.rint(np.concatenate([g, seen - moves]) * STEPS).astype(np.int64)


#: A chunk's columns of bytes; a bucket is below 2^16.
PACKED = {"grid": np.int32, "gold": np.int32, "length": np.int32, "size": np.int32, "bucket": np.uint16}


def coded(windows: pa.Table, languages: list[str]) -> pa.Table:
    """One packed chunk of windows (at, lang, words, other, more): the first half of a window with ``more`` is followed by
    that of ``more``, which is in the language ``other``."""
    of = {lang: i for i, lang in enumerate(languages)}
    windows = windows.sort_by("at")
    n, half = windows.num_rows, WINDOW // 2
    grid, gold = np.zeros((WINDOW, n), dtype=np.int64), np.zeros((WINDOW, n), dtype=np.int64)
    length = np.zeros(n, dtype=np.int64)
    number: dict[str, int] = {}
    columns = [windows.column(c).to_pylist() for c in ("lang", "words", "other", "more")]
    for j, (lang, words, other, more) in enumerate(zip(*columns, strict=True)):
        parts = [(of[lang], words)] if more is None else [(of[lang], words[:half]), (of[other], more[:half])]
        flat = [(y, w) for y, ws in parts for w in ws]
        length[j] = len(flat)
        for t, (y, w) in enumerate(flat):
            grid[t, j], gold[t, j] = number.setdefault(w, len(number)), y
    row, bucket = features(list(number))
    packed = Chunk(grid, gold, length, np.bincount(row, minlength=len(number)), bucket[np.argsort(row, kind="stable")]).pack()
    return pa.table({"chunk": windows.column("chunk").slice(0, 1)} | {c: pa.array([x], pa.binary()) for c, x in zip(PACKED, packed, strict=True)})


def chunks(windows: DataFrame) -> tuple[DataFrame, list[str], int]:
    """(Packed chunks, languages, number) of the windows (lang, words) in the order of language and words."""
    spark = windows.sparkSession
    rows = windows.orderBy("lang", "words").withColumn("id", F.monotonically_increasing_id())
    rows = written(rows, "language-windows").withColumn("part", F.shiftright("id", 33))
    counts = sorted(rows.groupBy("part", "lang").agg(F.count("*").alias("n")).collect())  # by tasks of a sort and languages
    n, before = 0, {}
    for part, _, found in counts:
        before.setdefault(part, n)
        n += found
    languages = sorted({lang for _, lang, _ in counts})
    starts = spark.createDataFrame(list(before.items()), "part long, before long")
    rows = rows.join(F.broadcast(starts), "part").select((F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("at"), "lang", "words")
    # every third window is spliced with one from elsewhere
    elsewhere = F.when((F.col("at") % 3 == 0) & F.lit(n > 1), (F.col("at") * 7919 + 13) % max(n, 1))
    others = rows.select(F.col("at").alias("with"), F.col("lang").alias("other"), F.col("words").alias("more"))
    rows = rows.withColumn("with", elsewhere).join(others, "with", "left").withColumn("chunk", F.floor(F.col("at") / CHUNK)).drop("with")
    dealt = rows.repartitionByRange(PARTS, "chunk").groupBy("chunk")
    packed = dealt.applyInArrow(lambda table: coded(table, languages), "chunk long, " + ", ".join(f"{c} binary" for c in PACKED))
    return written(packed, "language-chunks"), languages, n


def summed_gradient(packed: DataFrame, weights: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The chunks' gradients, summed."""
    shared = packed.sparkSession.sparkContext.broadcast((weights, transition))  # BUCKETS x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            for row in range(batch.num_rows):
                own = Chunk.unpack([batch.column(c)[row].as_buffer() for c in PACKED]).gradient(*shared.value)
                total = own if total is None else total + own
        if total is not None:
            places = np.flatnonzero(total.any(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (places, total[places])], ["places", "gradient"])

    total = np.zeros((len(weights) + len(transition), len(transition)), dtype=np.int64)
    for row in packed.coalesce(PARTS).mapInArrow(run, "places binary, gradient binary").collect():  # at most PARTS rows of a bounded size
        total[np.frombuffer(row["places"], dtype=np.int32)] += np.frombuffer(row["gradient"], dtype=np.int64).reshape(-1, total.shape[1])
    shared.destroy()
    return total / STEPS


def train(windows: DataFrame, rounds: int = ROUNDS) -> Model:
    """Model from windows (lang, words): gradient of the log-likelihood, step sizes by Adagrad."""
    packed, languages, n = chunks(windows)
    k = len(languages)
    weights, transition = np.zeros((BUCKETS, k)), np.zeros((k, k))
    past_w, past_t = np.full_like(weights, 1e-6), np.full_like(transition, 1e-6)
    for _ in range(rounds if n else 0):
        g = summed_gradient(packed, weights, transition) / n
        g, gt = g[:BUCKETS] - 1e-6 * weights, g[BUCKETS:]
        past_w += g * g
        past_t += gt * gt
        weights += 0.3 * g / np.sqrt(past_w)
        transition += 0.3 * gt / np.sqrt(past_t)
    return Model(languages, weights, transition)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            words = words_of(text.as_py())
            found = [words[s : s + WINDOW] for s in range(0, len(words), WINDOW)]
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(found), pa.string()), pa.array(found, pa.list_(pa.string()))], ["lang", "words"])


def learned(docs: DataFrame, usable=None, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Model from a hash sample of ``docs`` (doc_id, text, lang); ``usable``: condition on rows to learn from."""
    rows = docs.filter("text is not null and lang is not null and doc_id is not null")
    rows = rows.filter(usable) if usable is not None else rows
    place = F.xxhash64("doc_id", "text", F.lit(7))
    ranked = rows.select("lang", "text", F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id")).alias("k"))
    picked = ranked.filter(F.col("k") <= docs_per_language).select("lang", "text")
    return train(written(picked.mapInArrow(_windows, "lang string, words array<string>"), "language-sample"))


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_switches, second_lang, second_share) of every row (``Model.read``)."""
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages weights
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "n_switches": pa.int64(), "second_lang": pa.string(), "second_share": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                found = own.read(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in found], t) for i, t in enumerate(kinds.values()))], ["doc_id", *kinds])

    columns = "lang_pred string, score double, n_switches long, second_lang string, second_share double"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")
