"""SimHash near duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half of the hashes of the text's three-word
shingles. Two fingerprints link when 2 bits or fewer differ, and documents that reach each other over
links are one component.

Keys: the 64 bits are cut into segments of 22, 21 and 21 bits. Two differing bits leave one of three
segments untouched (pigeonhole), and the segment after it differs in at most 2 bits. That one is padded
to 23 bits and decoded by the binary Golay code: as the code is perfect, every 23-bit word has one
nearest codeword, and two words at distance 2 or less have a word in common within distance 1 of both.
So the codewords of a word and of its 23 neighbours (1 or 6 different ones) always share one. A key is
the segment's number, the untouched segment and one codeword index, about 33 bits; fingerprints that
link share at least one key.

Only distinct fingerprints get keys, so thousands of copies are one row. A key held by a few
fingerprints is compared pair by pair. A key held by more than BUCKET is never compared pair by pair:
its fingerprints emit the 65 words within distance 1, and link when they share one that proves a
distance of 2 or less; the least holder of each word is a star's centre, so the number of links is
linear in the members and none is lost. Components come from repeated hooking on the least neighbour.

Defined results: null or wordless texts have fingerprint zero and link like any other; fewer than three
words are one shingle; rows with equal doc_id are one document each row with the same component; rows
with null doc_id keep their fingerprint, link, but never name a component (null if alone). Empty tables
give an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

SEED = 42
BUCKET = 12
#: The generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the (23, 12, 7) code.
GOLAY_POLYNOMIAL = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    n = len(words) - 2
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def golay_syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial (11 bits)."""
    left = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        left ^= np.where((left >> bit) & 1, GOLAY_POLYNOMIAL << (bit - 11), 0)
    return left


def golay_leaders() -> np.ndarray:
    """Error pattern of weight 3 or less for each of the 2048 syndromes."""
    one = 1 << np.arange(23, dtype=np.int64)
    two = (one[:, None] | one[None, :]).ravel()
    three = (two[:, None] | one[None, :]).ravel()
    patterns = np.unique(np.concatenate([[0], one, two, three]))
    leaders = np.zeros(2048, dtype=np.int64)
    leaders[golay_syndromes(patterns)] = patterns
    return leaders


_LEADERS = golay_leaders()


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 24) indices (12 bits) of the codewords nearest to each word and to its 23 neighbours."""
    ball = words.astype(np.int64)[:, None] ^ np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])
    return (ball ^ _LEADERS[golay_syndromes(ball)]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of signed 64-bit fingerprints; equal keys of one row appear once."""
    bits = fps.view(np.uint64) if fps.dtype == np.int64 else fps.astype(np.uint64)
    rows, keys = [], []
    for number, (low, size) in enumerate(SEGMENTS):
        next_low, next_size = SEGMENTS[(number + 1) % 3]
        same = ((bits >> np.uint64(low)) & np.uint64((1 << size) - 1)).astype(np.int64)
        near = ((bits >> np.uint64(next_low)) & np.uint64((1 << next_size) - 1)).astype(np.int64)
        index = np.sort(golay_indices(near), axis=1)
        new = np.ones(index.shape, dtype=bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, _ = np.nonzero(new)
        rows.append(row)
        keys.append((number << 34) | (same[row] << 12) | index[new])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            fps = batch.column("fp").to_numpy(zero_copy_only=False)[start : start + 4096]
            row, key = fuzzy_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(fps[row]), pa.array(key)], ["fp", "key"])


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links between distinct fingerprints (one column ``fp``) with the same components as all
    pairs at distance 2 or less: every link has distance 2 or less, and every such pair is connected."""
    keyed = fps.mapInArrow(_keys, "fp long, key long")
    held = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    held = written(held, "simhash-keys")
    two = held.filter("n = 2").select("a", "b").filter(differing(F.col("a"), F.col("b")) <= 2)
    # the planner takes the keys for as small as the fingerprints: the hint keeps them from being broadcast
    few = keyed.join(held.filter(f"n > 2 and n <= {BUCKET}").select("key").hint("shuffle_hash"), "key")
    groups = few.groupBy("key").agg(F.array_sort(F.collect_set("fp")).alias("fps"))
    pairs = groups.select(F.explode("fps").alias("a"), "fps").select(
        "a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & (differing(F.col("a"), b) <= 2))).alias("b")
    )
    crowded = keyed.join(held.filter(f"n > {BUCKET}").select("key").hint("shuffle_hash"), "key", "left_semi").select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(-(1 << 63) if i == 63 else 1 << i)) for i in range(64)])
    balls = crowded.select("fp", F.explode(near).alias("word"))
    centres = balls.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("word", "a")
    stars = balls.join(centres, "word").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return written(two.unionByName(pairs).unionByName(stars).distinct(), "simhash-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node of each component, by large-star and small-star steps until no change.

    Each step groups links by node, takes the least neighbour (partial minima first) and joins it back:
    no node's neighbours are ever gathered, and a hub is a skewed join side that adaptive execution splits.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = written(edges, "component-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "component-links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.count_distinct("u").alias("k")).first()
        if now == before or now["n"] == 0:
            break
        if now["n"] == now["k"] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    hashed = written(fingerprints(docs), "simhash-fingerprints")
    firsts = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-firsts")
    edges = links(firsts.select("fp"))
    roots = components(edges)
    # the least document of a component is the least first document of its fingerprints
    of_root = firsts.join(roots, firsts["fp"] == roots["node"]).groupBy("root").agg(F.min("first_id").alias("least_id"))
    own = firsts.withColumnRenamed("fp", "root").join(of_root, "root").select("root", F.least("first_id", "least_id").alias("least_id"))
    labelled = roots.join(own, "root").select(F.col("node").alias("fp"), "least_id").unionByName(own.withColumnRenamed("root", "fp"))
    labels = firsts.join(labelled, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return hashed.join(written(labels, "simhash-labels"), "fp")


# --- near copies: SimHash links, prefix-filter join on five-word runs, exact verification ---------------------------

SHINGLE, SIMILARITY = 5, 0.8
#: The order of runs: one in ORDER_PART texts is counted for it, at most COMMON runs come last.
ORDER_PART, COMMON = 8, 200_000
#: Work of crowded runs, never results: when and how often holders are compared with a few before with all.
FEW, CENTRES, TURNS = 4, 8, 2
#: Parity bits of a set's runs, in 64-bit columns.
WORDS_OF_BITS = 4
BITS = [f"bits{k}" for k in range(WORDS_OF_BITS)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def run_hashes(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Distinct 64-bit hashes of the runs of SHINGLE words of each text; fewer words are one run.

    A run's hash mixes the XXH64 of its words, each different word hashed once; no word is hash zero.
    """
    number: dict[bytes, int] = {}
    place = number.setdefault
    pad = [b""]  # no text has an empty word
    lists = [words + pad * (SHINGLE - len(words)) if words else words for words in texts]
    size = np.array([len(words) for words in lists], dtype=np.int64)
    codes = np.array([place(w, len(number)) for words in lists for w in words], dtype=np.int64)
    value = np.fromiter(map(xxhash.xxh64_intdigest, number, repeat(SEED)), dtype=np.uint64, count=len(number))
    word = value[codes] if len(number) else np.zeros(0, dtype=np.uint64)
    n = max(len(word) - SHINGLE + 1, 0)
    run = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[k : k + n]
    run = (run ^ (run >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    run ^= run >> np.uint64(32)
    first = np.cumsum(size) - size
    return [np.unique(run[f : f + m - SHINGLE + 1]) if m else run[:0] for f, m in zip(first.tolist(), size.tolist(), strict=True)]


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    return run_hashes([words])[0]


def sets_of(texts: list[str | None]) -> list[tuple[bytes, np.ndarray]]:
    """Name (128 bits) and runs of each text; texts with equal sets of runs have one name."""
    return [(xxhash.xxh3_128_digest(own.tobytes()), own) for own in run_hashes([words_of(t) for t in texts])]


def names_of(texts: pa.Array) -> list[bytes]:
    return [name for start in range(0, len(texts), 500) for name, _ in sets_of(texts.slice(start, 500).to_pylist())]


def node_of(name: bytes) -> int:
    """The name's first 64 bits, signed: for keys alone, links are verified by whole names."""
    return int.from_bytes(name[:8], "big", signed=True)


def prefix_length(n: int, similarity: float) -> int:
    """Sets this similar have a run in common among the first so many of each, in any order of all runs."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def parities(own: np.ndarray) -> np.ndarray:
    """WORDS_OF_BITS * 64 bits: whether an odd number of the set's runs falls on each. Two sets differ in at most as
    many bits as in runs."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) % (64 * WORDS_OF_BITS), minlength=64 * WORDS_OF_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names: list[bytes] = []
        bits: list[np.ndarray] = []
        fps: list[int] = []
        for start in range(0, batch.num_rows, 500):
            texts = batch.column("text").slice(start, 500).to_pylist()
            fps += map(fingerprint, texts)
            for name, own in sets_of(texts):
                names.append(name)
                bits.append(parities(own))
        nodes = pa.array([node_of(n) for n in names], pa.int64())
        table = np.array(bits, dtype=np.int64).reshape(len(names), WORDS_OF_BITS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(names, pa.binary()), nodes, pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(WORDS_OF_BITS))],
            ["doc_id", "set_id", "node", "fp", *BITS],
        )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            sets = sets_of(batch.column("text").slice(start, 500).to_pylist())
            lists = pa.array([own.view(np.int64) for _, own in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in sets], pa.binary()), lists], ["set_id", "shingles"])


def _order_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            sets = dict(sets_of(batch.column("text").slice(start, 500).to_pylist()))
            held = [own for name, own in sets.items() if name[-1] % ORDER_PART == 0]
            if held:
                key, c = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c)], ["key", "c"])


def common_runs(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most COMMON runs that many texts hold, ascending, and their counts.

    They fix only the order of runs, so that passages of many texts are no keys; links do not depend on it.
    """
    counts = rows.select("text").mapInArrow(_order_counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).filter("c > 2")
    counts = written(counts, "near-common")
    held, least = 0, math.inf
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n")).collect()  # some hundred rows
    for row in sorted(steps, key=lambda r: -r["step"]):
        held += row["n"]
        if held > COMMON:
            break
        least = 2 ** (row["step"] / 8) * (1 - 1e-9)
    got = counts.filter(F.col("c") >= least).toPandas()
    keys = got["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got["c"].to_numpy(dtype=np.int64)[order]


def prefix_keys(own: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first ``prefix_length`` runs of a set: uncommon ones by hash, then common ones by count and hash."""
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.lexsort((own, np.where(common[at] == own, counts[at], 0)))]
    return own[: prefix_length(len(own), similarity)]


def set_keys(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, place): every run of every set's prefix, once, with the set's size and its place."""
    shared = rows.sparkSession.sparkContext.broadcast(common_runs(rows))  # at most COMMON runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                sets = dict(sets_of(batch.column("text").slice(start, 500).to_pylist()))
                named = [(node_of(name), len(own), prefix_keys(own, common, counts, similarity)) for name, own in sets.items() if len(own)]
                if named:
                    long = np.array([len(k) for _, _, k in named])
                    columns = [np.concatenate([k for _, _, k in named]).view(np.int64), np.repeat(np.array([x[0] for x in named], dtype=np.int64), long)]
                    columns += [np.repeat(np.array([x[1] for x in named], dtype=np.int32), long), np.concatenate([np.arange(x, dtype=np.int32) for x in long])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "n", "place"])

    keyed = rows.select("text").mapInArrow(run, "key long, node long, n int, place int")
    return keyed.repartition("key").groupBy("key", "node").agg(F.first("n").alias("n"), F.first("place").alias("place"))


def may_link(a: str, b: str, similarity: float) -> Column:
    """Whether two sets whose first common run stands at these places (of these sizes) can be this similar."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    rest = F.least(na - F.col(f"{a}place"), nb - F.col(f"{b}place"))
    return rest >= F.lit(similarity / (1 + similarity)) * (na + nb) - 1e-9


def may_be_alike(a: str, b: str, similarity: float) -> Column:
    """Whether the parity bits of two sets let them be this similar: sets of a similarity s differ in at most
    (1 - s) / (1 + s) of both their runs. Without bits they may."""
    differ = F.lit(0)
    for c in BITS:
        differ = differ + F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")))
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{a}n") + F.col(f"{b}n")) + 1e-9
    return F.coalesce(differ <= most, F.lit(True))


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) nodes whose SimHash fingerprints link: by op9's Golay keys, a star within each fingerprint and a pair for
    each link between two, so thousands of near copies are a row a member. ``sets``: node and fp."""
    firsts = written(sets.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    within = sets.join(firsts, "fp").select(F.col("first").alias("x"), F.col("node").alias("y"))
    end = lambda c, n: firsts.select(F.col("fp").alias(c), F.col("first").alias(n))
    between = links(firsts.select("fp")).join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    both = within.unionByName(between).filter("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_links(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of set names with the same components as all pairs of at least this similarity.

    SimHash gives the first pairs (``fingerprint_pairs``), verified like all others. At this similarity fingerprints may
    differ in more bits than they link at, so the runs give the pairs that are left. Two such sets share a run of their prefixes, and at the first they share the rest of both is long enough
    (``may_link``). First every set is compared with one holder of each of its keys. Keys whose holders are
    still in several components go on: while they would give more than FEW pairs a row, their sets are
    compared with CENTRES other holders (at most TURNS times); at last all pairs across components are. So a
    group of thousands of near copies costs a few rows a member, and no pair across components goes untested:
    a pair is left out only where the places of the run or the sets' parity bits show that it is not similar.
    """
    keyed = set_keys(named, similarity)  # dealt by key once: counts and the join below stay where the rows are
    shared = keyed.groupBy("key").agg(F.count("*").alias("holders"), F.min(F.struct("node", "n", "place")).alias("c")).filter("holders > 1")
    held = written(keyed.join(shared.select("key", "holders", F.col("c.node").alias("cnode"), F.col("c.n").alias("cn"), F.col("c.place").alias("cplace")), "key"), "near-keys")
    stars = held.filter((F.col("node") != F.col("cnode")) & may_link("", "c", similarity)).select(F.col("cnode").alias("a"), F.col("node").alias("b"))
    near = written(fingerprint_pairs(sets), "near-simhash")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    done = written(near.unionByName(stars), "near-stars")
    edges = found = verified(named, sets, done, similarity)
    # with two holders the pair is compared; later turns only see keys that were mixed before
    undecided = held.filter("holders > 2").select("key", "node", "n", "place")
    bits = sets.groupBy("node").agg(*[F.when(F.count("*") == 1, F.first(c)).alias(c) for c in BITS])
    for turn in range(1, TURNS + 1):
        roots = components(edges)
        of = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").groupBy("node").agg(F.min(F.coalesce("root", "set_id")).alias("root"))
        rooted = undecided.join(written(of, "near-roots"), "node").repartition("key")
        several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        mixed = written(rooted.join(several, "key").join(bits, "node"), "near-mixed")
        undecided = mixed.select("key", "node", "n", "place")
        columns = ("node", "n", "place", "root", *BITS)
        side = lambda c, rows: rows.select("key", *[F.col(x).alias(f"{c}{x}") for x in columns])
        parts = mixed.groupBy("key", "root").agg(F.count("*").cast("double").alias("m")).groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"))
        left = parts.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs")).first()
        last = turn == TURNS or (left["pairs"] or 0) <= FEW * (left["rows"] or 0) or found.isEmpty()
        others = mixed
        if not last:  # one holder of every key in each of CENTRES parts, the same ones of the keys that a group shares
            part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(CENTRES))
            others = mixed.groupBy("key", part.alias("part")).agg(F.min(F.struct(F.xxhash64("node", F.lit(-turn)).alias("h"), *columns)).alias("c")).select("key", "c.*").drop("h")
        fits = (F.col("xroot") != F.col("yroot")) & may_link("x", "y", similarity) & may_be_alike("x", "y", similarity)
        across = side("x", mixed).join(side("y", others).withColumnRenamed("key", "ykey"), (F.col("key") == F.col("ykey")) & fits & ((F.col("xnode") < F.col("ynode")) if last else F.lit(True)))
        pairs = across.select(F.least("xnode", "ynode").alias("a"), F.greatest("xnode", "ynode").alias("b"))
        pairs = written(pairs.distinct().join(done, ["a", "b"], "left_anti"), "near-pairs")
        found = verified(named, sets, pairs, similarity)
        edges, done = edges.unionByName(found), done.unionByName(pairs)
        if last:
            break
    return edges


def verified(named: DataFrame, sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) set names of those pairs of nodes whose whole sets are this similar."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = sets.join(nodes, "node", "left_semi").select(F.col("first_id").alias("doc_id")).distinct()
    lists = named.join(texts, "doc_id", "left_semi").mapInArrow(_shingle_sets, "set_id binary, shingles array<long>").dropDuplicates(["set_id"])
    lists = written(lists.join(sets.select("set_id", "node"), "set_id"), "near-shingles")
    side = lambda c: lists.select(F.col("node").alias(c), F.col("set_id").alias(f"{c}_set"), F.col("shingles").alias(f"{c}_runs"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("a_runs", "b_runs"))
    alike = both.filter(common >= F.lit(similarity) * (F.size("a_runs") + F.size("b_runs") - common))
    return written(alike.select(F.col("a_set").alias("a"), F.col("b_set").alias("b")), "near-links")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, set_id, root, component_id) of every row: exact copies and texts whose sets of five-word
    runs have a Jaccard similarity of at least ``similarity`` are linked. The join is exact: every such pair
    is connected (``near_links``), and every link is verified on the whole sets. ``set_id`` names the text's
    set, ``root`` the set that names the component.

    Case is folded and white space is one blank, so texts that differ in these alone are exact copies.
    Wordless texts are copies of each other. Rows without doc_id link exactly, and never name a component.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    described = written(rows.mapInArrow(_described, f"doc_id {kind}, set_id binary, node long, fp long, " + ", ".join(f"{c} long" for c in BITS)), "near-rows")
    sets = written(described.groupBy("set_id", "node").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in BITS]), "near-sets")
    roots = components(near_links(rows.filter("doc_id is not null"), sets.filter("first_id is not null"), similarity))
    rooted = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root"))
    rooted = written(rooted, "near-rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(least, "root").select("set_id", "root", "component_id")
    return described.select("doc_id", "set_id").join(written(labels, "near-labels"), "set_id").select("doc_id", "set_id", "root", "component_id")


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("copy_set", pa.array(names_of(batch.column("text")), pa.binary()))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs``, all columns: one of each group of copies (``near_copies``), the one with the least
    (doc_id, set of runs); of rows equal in both, the first by their JSON text.

    Rows without doc_id cannot be named; all of them stay. Rows of one doc_id with different texts are
    different documents.
    """
    found = written(near_copies(docs, similarity), "copies").filter("doc_id is not null")
    chosen = written(found.groupBy("root").agg(F.min(F.struct("doc_id", "set_id")).alias("r")).select("r.doc_id", "r.set_id"), "copies-chosen")
    repeated = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "copies-ids")
    named = docs.filter("doc_id is not null")
    single = named.join(chosen.join(repeated, "doc_id", "left_anti"), "doc_id", "left_semi").select(*docs.columns)
    # ids of several rows: their texts decide, by the set
    struct = F.struct(*docs.columns)
    several = named.join(repeated, "doc_id", "left_semi").select("doc_id", "text", struct.alias("row"))
    several = several.mapInArrow(_named, several.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",copy_set:binary")
    several = several.join(chosen.select("doc_id", F.col("set_id").alias("copy_set")), ["doc_id", "copy_set"], "left_semi")
    several = several.groupBy("doc_id", "copy_set").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return single.unionByName(several).unionByName(docs.filter("doc_id is null"))
