"""Language-model scores: a log-bilinear neural model trained by noise-contrastive estimation in numpy.

Tokens: ASCII-lower-cased words and one end. Counts of all training tokens come from one grouped sum.
The model's outputs are the WORDS commonest tokens and CLASSES classes of the others (by their last two
bytes); a token of a class has the class's probability times its smoothed share of the class. With
``q = C1 v(w1) + C2 v(w2)`` of the two tokens before, the score of output w is ``r(w) q + b(w)``.

Training: texts are coded once to output numbers and written (two bytes a token, long texts in chunks
that carry their two tokens before). A hash of each chunk deals it to one of ROUNDS rounds and, in the
round, to one of N / (ROUNDS * SHARD_TOKENS) shards, so rounds and shards follow the data and not its
partitions. A round starts all shards from the same weights and Adagrad sums, each shard passes over its
chunks in hash order with its own random numbers, and both are averaged by positions in grouped sums.
Every position of every training text is a target once.
Scoring normalises exactly: batched matrix products give the log normaliser of every context pair once.

Counts of the commonest tokens (at most HEAD rows) are broadcast; all other tokens of a
document are joined with the counts by a shuffle on the token, none of which is common.

Defined results: null text is empty and has the end alone; repeated rows are counted and scored each,
and null ids belong to no fold (they are learned from); without training rows counts are zero and
the model is uniform; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

HEAD = 200_000
WORDS, CLASSES, WIDTH = 448, 64, 24
OUTPUTS = WORDS + CLASSES
NOISE, BATCH, RATE, ROUNDS = 64, 512, 0.08, 4
SHARD_TOKENS, CHUNK = 250_000, 1 << 15
FLUSH, CACHE = 250_000, 200_000
END = b"\n"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens_of(text: str | None) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
    words.append(END)
    return words


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % CLASSES


def class_column(token: Column) -> Column:
    """``class_of`` as a column expression."""
    return F.pmod(F.crc32(F.when(F.length(token) < 2, token).otherwise(F.substring(token, F.length(token) - 1, F.lit(2)))), F.lit(CLASSES))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
        seen.clear()
        return batch

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(tokens_of(text))
            if len(seen) > FLUSH:
                yield out()
    if seen:
        yield out()


def vocabulary(training: DataFrame) -> DataFrame:
    """(token, c) of all training texts."""
    return training.select("text").mapInArrow(_counted, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Weights:
    """Parameters: input vectors (one more for the start), output vectors, biases, context matrices."""

    v: np.ndarray
    r: np.ndarray
    b: np.ndarray
    c1: np.ndarray
    c2: np.ndarray

    @staticmethod
    def shapes() -> list[tuple[int, ...]]:
        return [(OUTPUTS + 1, WIDTH), (OUTPUTS, WIDTH), (OUTPUTS,), (WIDTH, WIDTH), (WIDTH, WIDTH)]

    @classmethod
    def initial(cls, share: np.ndarray) -> Weights:
        g = np.random.default_rng(11)
        v, r = (g.normal(0, 0.1, s).astype(np.float32) for s in cls.shapes()[:2])
        eye = np.eye(WIDTH, dtype=np.float32)
        return cls(v, r, np.log(share).astype(np.float32), 0.6 * eye, 0.4 * eye)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.v, self.r, self.b, self.c1, self.c2)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Weights:
        parts, at = [], 0
        for shape in cls.shapes():
            n = math.prod(shape)
            parts.append(flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return cls(*parts)


def summed(rows: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """(size, width): sums of the rows of each index."""
    width = rows.shape[1]
    places = index[:, None] * width + np.arange(width)
    return np.bincount(places.ravel(), weights=rows.ravel(), minlength=size * width).reshape(size, width).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function, in the place of ``x``."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def nce_step(w: Weights, past: list[np.ndarray], target: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, rate: float) -> None:
    """One Adagrad step of noise-contrastive estimation on a minibatch with shared noise."""
    n = len(target)
    q = (w.v @ w.c1.T).take(one, axis=0)
    q += (w.v @ w.c2.T).take(two, axis=0)
    rt, rn = w.r.take(target, axis=0), w.r.take(noise, axis=0)
    bias = w.b - log_noise - np.float32(np.log(float(len(noise))))
    g_true = sigmoid(np.einsum("ij,ij->i", rt, q) + bias[target]) - 1
    false = q @ rn.T
    false += bias[noise]
    g_false = sigmoid(false)
    rt *= g_true[:, None]
    dq = g_false @ rn
    dq += rt
    both = np.concatenate([target, noise])
    dr = summed(np.concatenate([g_true[:, None] * q, g_false.T @ q]), both, len(w.r))
    db = np.bincount(both, weights=np.concatenate([g_true, np.ones(n, np.float32) @ g_false]), minlength=len(w.b))
    d1, d2 = summed(dq, one, len(w.v)), summed(dq, two, len(w.v))
    dv = d1 @ w.c1 + d2 @ w.c2
    for x, g, p in zip((w.v, w.r, w.b, w.c1, w.c2), (dv, dr, db.astype(np.float32), d1.T @ w.v, d2.T @ w.v), past, strict=True):
        g /= n
        p += g * g
        g *= np.float32(rate)
        g /= np.sqrt(p)
        x -= g


class Coder:
    """Output numbers of tokens: a word's own, or WORDS + its class. Seen tokens are kept in a bounded cache."""

    def __init__(self, words: list[bytes]) -> None:
        self.number = {t: i for i, t in enumerate(words)}
        self.seen = dict(self.number)

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        missing = set(tokens).difference(self.seen)
        if missing:
            if len(self.seen) > CACHE:
                self.seen = dict(self.number)
                missing = set(tokens).difference(self.seen)
            for t in missing:
                self.seen[t] = WORDS + class_of(t)
        return np.fromiter(map(self.seen.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def before(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each; OUTPUTS stands for the start."""
    start = np.full(2, OUTPUTS, dtype=np.int64)
    padded = np.concatenate([start, ids])
    return padded[1:-1], padded[:-2]


def coded(training: DataFrame, words: list[bytes]) -> DataFrame:
    """(place, ids): the output numbers of every training text in chunks, each after the two numbers before
    it; ``place`` is a hash of the chunk and its document."""
    shared = training.sparkSession.sparkContext.broadcast(words)  # WORDS tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                owner, at, ids = [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    numbers = np.concatenate([[OUTPUTS, OUTPUTS], code(tokens_of(text))]).astype("<i2")
                    for s in range(0, len(numbers) - 2, CHUNK):
                        owner.append(row)
                        at.append(s)
                        ids.append(numbers[s : s + CHUNK + 2].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(at, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "at", "ids"])

    rows = training.select("doc_id", "text")
    chunks = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, at long, ids binary")
    return chunks.select(F.xxhash64("doc_id", "at", "ids").alias("place"), "ids")


def train_shard(state: np.ndarray, share: np.ndarray, chunks: list[np.ndarray], seed: list[int]) -> tuple[int, np.ndarray]:
    """Positions and state (weights, then Adagrad sums) after one pass over the chunks of a shard."""
    half = len(state) // 2
    own, past = Weights.of(state[:half].copy()), Weights.of(state[half:].copy())
    sums = [past.v, past.r, past.b, past.c1, past.c2]
    g = np.random.default_rng(seed)
    log_noise, cumulative = np.log(share).astype(np.float32), np.cumsum(share)
    target, one, two = (np.concatenate([c[2 - k : len(c) - k] for c in chunks]).astype(np.int64) for k in range(3))
    order = g.permutation(len(target))
    for s in range(0, len(target), BATCH):
        pick = order[s : s + BATCH]
        noise = np.minimum(np.searchsorted(cumulative, g.random(NOISE) * cumulative[-1]), OUTPUTS - 1)
        nce_step(own, sums, target[pick], one[pick], two[pick], noise, log_noise, RATE)
    return len(target), np.concatenate([own.flat(), past.flat()])


def train_round(chunks: DataFrame, share: np.ndarray, state: np.ndarray, turn: int, shards: int) -> np.ndarray:
    """State after one round over its chunks, averaged over the shards by positions."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast((share, state))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, state = shared.value
        held: list[np.ndarray] = []
        shard = None

        def learned() -> pa.RecordBatch:
            n, after = train_shard(state, share, held, [turn, shard])
            return pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([n * after.astype(np.float64)], pa.list_(pa.float64()))], ["n", "w"])

        for batch in batches:
            for number, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if held and number != shard:
                    yield learned()
                    held = []
                shard = number
                held.append(np.frombuffer(ids, dtype="<i2"))
        if held:
            yield learned()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, w = 0.0, None
        for batch in batches:
            for m, x in zip(batch.column("n").to_pylist(), batch.column("w"), strict=True):
                x = x.values.to_numpy(zero_copy_only=False)
                n, w = n + m, x.copy() if w is None else w + x
        if w is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([w], pa.list_(pa.float64()))], ["n", "w"])

    dealt = chunks.filter(F.pmod("place", F.lit(ROUNDS)) == turn).select(F.pmod(F.shiftright("place", 8), F.lit(shards)).alias("shard"), "place", "ids")
    # a task takes its shards one after another, so their number is no number of tasks
    tasks = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(tasks, "shard").sortWithinPartitions("shard", "place", "ids")
    parts = written(dealt.mapInArrow(run, "n double, w array<double>"), "lm-shards")  # one row a shard
    parts = parts.repartition(math.isqrt(shards) + 1).mapInArrow(added, "n double, w array<double>")
    each = parts.select("n", F.posexplode("w").alias("place", "x"))
    mean = each.groupBy("place").agg((F.sum("x") / F.sum("n")).alias("x"))
    got = mean.orderBy("place").toPandas()  # one row a parameter
    return got["x"].to_numpy().astype(np.float32) if len(got) else state


class Scorer:
    """Log10 probabilities of outputs after every pair of outputs, from tables of fixed size (made once)."""

    def __init__(self, w: Weights) -> None:
        self.b = w.b.astype(np.float32)
        a1, a2 = w.v @ w.c1.T, w.v @ w.c2.T
        self.m1, self.m2 = w.r @ a1.T, w.r @ a2.T
        size = OUTPUTS + 1
        self.z = np.empty((size, size), dtype=np.float32)
        for one in range(size):  # a batch: all second contexts of one first context
            s = (a1[one] + a2) @ w.r.T + w.b
            top = s.max(axis=1, keepdims=True)
            self.z[one] = (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True)))[:, 0]

    def __call__(self, ids: np.ndarray) -> float:
        one, two = before(ids)
        s = self.b[ids] + self.m1[ids, one] + self.m2[ids, two] - self.z[one, two]
        return float(s.sum(dtype=np.float64)) / math.log(10)


@dataclass
class Model:
    """Scorer, words, HEAD counts and the classes' totals; N and V of the training tokens."""

    scorer: Scorer
    words: list[bytes]
    head: dict[bytes, int]
    class_total: np.ndarray
    n: int
    v: int


def head_count(vocab: DataFrame) -> float:
    """Least count such that at most HEAD tokens have it, to an eighth of a power of two.

    It comes from a histogram of some hundred rows: a sorted limit would send HEAD rows of every task to
    the driver.
    """
    steps = vocab.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n")).collect()
    held, least = 0, math.inf
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["n"]
        if held > HEAD:
            break
        least = 2 ** (row["step"] / 8) * (1 - 1e-9)
    return least


def learned(training: DataFrame, vocab: DataFrame) -> Model:
    """``vocab``: the written counts of ``training``."""
    first = vocab.filter(F.col("c") >= head_count(vocab)).toPandas()
    head = dict(sorted(((bytes(t), int(c)) for t, c in zip(first["token"], first["c"], strict=True)), key=lambda x: (-x[1], x[0])))
    words = list(dict.fromkeys([END, *list(head)[:WORDS]]))[:WORDS]
    total = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    per_class = {r["k"]: (r["c"], r["v"]) for r in vocab.groupBy(class_column(F.col("token")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    class_total = np.full(CLASSES, 0.5)
    for k, (c, v) in per_class.items():
        class_total[k] += c + 0.5 * v
    for t in words:
        class_total[class_of(t)] -= head.get(t, -0.5) + 0.5
    class_total = np.maximum(class_total, 0.5)
    share = np.concatenate([[head.get(t, 0) + 0.5 for t in words], np.full(WORDS - len(words), 1e-6), class_total])
    share = share / share.sum()
    first_weights = Weights.initial(share).flat()
    state = np.concatenate([first_weights, np.full_like(first_weights, 1e-4)])
    n = int(total["n"] or 0)
    if n:
        chunks = written(coded(training, words), "lm-ids")
        for turn in range(ROUNDS):
            state = train_round(chunks, share, state, turn, max(1, n // (ROUNDS * SHARD_TOKENS)))
    return Model(Scorer(Weights.of(state[: len(first_weights)])), words, head, class_total, n, int(total["v"]))


def scored(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    vocab = written(vocabulary(training), "lm-vocabulary")
    model = learned(training, vocab)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # HEAD counts and the scorer's tables: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        score, head, code = own.scorer, own.head, Coder(own.words)
        log_count = {t: math.log10(c + 0.5) for t, c in head.items()}
        log_class = np.log10(own.class_total)
        words, held, nan = code.number, log_count.get, math.nan
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                rows = []
                for text in batch.column("text").to_pylist():
                    tokens = tokens_of(text)
                    ids = code(tokens)
                    # nan: not in the head, its count comes by the join
                    logs = np.fromiter(map(held, tokens, repeat(nan)), dtype=np.float64, count=len(tokens))
                    unknown = np.isnan(logs)
                    tail = Counter([tokens[i] for i in np.flatnonzero(unknown).tolist()])
                    logs[unknown] = 0.0
                    base = float(logs.sum())
                    in_class = ids >= WORDS
                    # tokens of a class: share of the class; its count part is known here for head tokens
                    shares = float(logs[in_class].sum())
                    neural = score(ids) - float(log_class[ids[in_class] - WORDS].sum()) + shares
                    # the end's own share when no training row had one
                    rows.append((len(tokens), len(tokens) - sum(tail.values()), base, neural, [{"token": t, "n": n, "word": t in words} for t, n in tail.items()]))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kind = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int32()), ("word", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind), strict=True))],
                    ["doc_id", "row", "n_tokens", "n_head", "head_sum", "neural", "tail"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    schema = f"doc_id {kind}, row long, n_tokens long, n_head long, head_sum double, neural double, tail array<struct<token: binary, n: int, word: boolean>>"
    first = written(rows.mapInArrow(run, schema), "lm-rows")
    tail = first.select("row", F.inline("tail")).join(vocab, "token", "left")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    rest = tail.groupBy("row").agg(
        F.sum(F.col("n") * log_c).alias("tail_sum"),
        F.sum(F.when(~F.col("word"), F.col("n") * log_c)).alias("class_sum"),
        F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("n_tail"),
    )
    zero = F.lit(0.0)
    norm = math.log10(model.n + 0.5 * (model.v + 1))
    return first.drop("tail").join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", zero) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("neural") + F.coalesce("class_sum", zero)).alias("score"),
    )
