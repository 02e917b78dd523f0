"""Toxicity by a weighted finite-state pattern grammar.

A text becomes symbols, word by word: insult (with its learned weight), threat, target, negation,
reporting word, clause end, or other. Four transducers read the symbols and are composed into one
machine:

* negation marks insults and threats within three words after it as negated,
* reported speech marks those in the rest of its clause as reported,
* insult emits the weight of an insult by its marks, and more with a target in its clause, before or
  after it,
* threat emits a threat by its marks when a target is in its clause, at the later of the two.

What waits for its target is kept in the state with its marks; a clause end brings every transducer back
to its start. A clause weighs the sum of what the machine emits in it, so matched clauses count and not
words by themselves; a fitted logistic curve over the clause weights gives a score from 0 to 1.

The insult lexicon is learned: from a sample of at most PER_CLASS labelled documents of each class (a
bound on rows, by hash of the id), words, word beginnings and word endings that stand in toxic texts and
hardly in others are chosen by greedy cover until each toxic text of the sample holds NEED of them. Each
choice serves 1/200 of the toxic sample, so there are at most 200 * NEED.

Defined results: null, empty or wordless texts match nothing and get the curve's least score; repeated
rows are scored each, and a sample id with several texts gives the least of them by hash; without labels
of both classes the grammar has only its fixed words; an empty table gives an empty result. Only doc_id
and text are read of documents, doc_id and toxic of labels.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

PER_CLASS = 1500
NEED = 4
THRESHOLD = 0.3
MIN_ODDS = 2.8
MAX_CLEAN = 0.005
CACHE_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+|[.!?;:“”\"«»]")
AFFIXES = (3, 4, 5, 6, 7)

# Closed-class words of the grammar in four languages.
TARGETS = frozenset("you your yours yourself u ur they them their he him his she her hers tu toi vous votre eux elles du dich dir dein deine ihr euch euer usted ustedes tú ti vosotros ellos ellas".split())
NEGATIONS = frozenset("not no never nor neither isn aren wasn weren don doesn didn won cannot without ne pas jamais nicht kein keine nie niemals nunca jamás tampoco".split())
REPORTS = frozenset("said says wrote writes called claimed claims reported quoted according alleged dit disait écrit sagte sagt schrieb laut dijo dice escribió según".split())
THREATS = frozenset("kill murder strangle slaughter behead stab shoot bomb lynch tuer égorger assassiner umbringen töten erschießen matar asesinar degollar".split())
INSULTS = frozenset("idiot moron imbecile scum asshole bastard dumbass retard dickhead motherfucker connard salope abruti arschloch wichser hurensohn gilipollas cabrón imbécil".split())
FIXED_WEIGHT = 2.0

OTHER, TARGET, NEGATION, REPORT, END = "otnr."
#: Threats and insults by their marks: plain, negated, reported, both.
THREATS_BY_MARK, INSULTS_BY_MARK = "0123", "4567"
THREAT, INSULT = "0", "4"
NEGATED, REPORTED, TARGETED = 0.4, 0.6, 0.5
FACTORS = (1.0, NEGATED, REPORTED, NEGATED * REPORTED)
ALPHABET = OTHER + TARGET + NEGATION + REPORT + END + THREATS_BY_MARK + INSULTS_BY_MARK
FIRST_LEARNED = 0xE000
FIRST_MARK = chr(FIRST_LEARNED)
BUCKETS = 1 << 20


@dataclass(frozen=True)
class Transducer:
    """States from 0; ``arcs[state, symbol] = (next state, output symbol, insult, threat)``: factors by
    which the arc adds the weights of the last insult and threat read. A symbol without arc goes through
    unchanged, adds nothing and leaves the state as it is."""

    states: int
    arcs: dict[tuple[int, str], tuple[int, str, float, float]]

    def step(self, state: int, symbol: str) -> tuple[int, str, float, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0, 0.0))


def compose(first: Transducer, second: Transducer, symbols: str = ALPHABET) -> Transducer:
    """The transducer that reads with ``first`` and feeds its output to ``second``; what both add adds up."""
    arcs = {}
    for a in range(first.states):
        for b in range(second.states):
            for s in symbols:
                next_a, out, i, t = first.step(a, s)
                next_b, out, j, u = second.step(b, out)
                arcs[a * second.states + b, s] = (next_a * second.states + next_b, out, i + j, t + u)
    return Transducer(first.states * second.states, arcs)


def _marked(symbol: str, mark: int) -> str:
    """The threat or insult with one more mark."""
    family = THREATS_BY_MARK if symbol in THREATS_BY_MARK else INSULTS_BY_MARK
    return family[family.index(symbol) | mark]


def negation_transducer(reach: int = 3) -> Transducer:
    """State: how many of the next words are still negated."""
    arcs = {}
    for state in range(reach + 1):
        arcs[state, NEGATION] = (reach, NEGATION, 0.0, 0.0)
        arcs[state, END] = (0, END, 0.0, 0.0)
        if state:
            for s in OTHER + TARGET + REPORT:
                arcs[state, s] = (state - 1, s, 0.0, 0.0)
            for s in THREATS_BY_MARK + INSULTS_BY_MARK:
                arcs[state, s] = (state - 1, _marked(s, 1), 0.0, 0.0)
    return Transducer(reach + 1, arcs)


def report_transducer() -> Transducer:
    """States: nothing reported, the rest of the clause is."""
    arcs = {(0, REPORT): (1, REPORT, 0.0, 0.0), (1, END): (0, END, 0.0, 0.0)}
    for s in THREATS_BY_MARK + INSULTS_BY_MARK:
        arcs[1, s] = (1, _marked(s, 2), 0.0, 0.0)
    return Transducer(2, arcs)


def insult_transducer() -> Transducer:
    """States: nothing, target seen, or an insult with marks waits for its target (2 to 5)."""
    arcs = {(0, TARGET): (1, TARGET, 0.0, 0.0)}
    for state in range(1, 6):
        arcs[state, END] = (0, END, 0.0, 0.0)
    for mark, s in enumerate(INSULTS_BY_MARK):
        arcs[1, s] = (1, s, FACTORS[mark] * (1 + TARGETED), 0.0)
        for state in (0, 2, 3, 4, 5):
            arcs[state, s] = (2 + mark, s, FACTORS[mark], 0.0)
        arcs[2 + mark, TARGET] = (1, TARGET, FACTORS[mark] * TARGETED, 0.0)
    return Transducer(6, arcs)


def threat_transducer() -> Transducer:
    """States: nothing, target seen, or a threat with marks waits for its target (2 to 5)."""
    arcs = {(0, TARGET): (1, TARGET, 0.0, 0.0)}
    for state in range(1, 6):
        arcs[state, END] = (0, END, 0.0, 0.0)
    for mark, s in enumerate(THREATS_BY_MARK):
        arcs[1, s] = (1, s, 0.0, FACTORS[mark])
        for state in (0, 2, 3, 4, 5):
            arcs[state, s] = (2 + mark, s, 0.0, 0.0)
        arcs[2 + mark, TARGET] = (1, TARGET, 0.0, FACTORS[mark])
    return Transducer(6, arcs)


def grammar() -> Transducer:
    whole = negation_transducer()
    for part in (report_transducer(), insult_transducer(), threat_transducer()):
        whole = compose(whole, part)
    return whole


@dataclass
class Grammar:
    """Learned insult patterns, the composed transducer and the curve from clause weights to score."""

    patterns: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.0)

    def __post_init__(self) -> None:
        self.machine = grammar()
        self.start()

    def __getstate__(self) -> dict:
        return {"patterns": self.patterns, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.machine = grammar()
        self.start()

    def start(self) -> None:
        self.cache: dict[str, str] = {}
        self.weight_of = {THREAT: FIXED_WEIGHT, INSULT: FIXED_WEIGHT}
        self.mark_of = {}
        for i, (pattern, weight) in enumerate(self.patterns.items()):
            mark = chr(FIRST_LEARNED + i)
            self.mark_of[pattern], self.weight_of[mark] = mark, weight
        self.strong = re.compile("[" + THREAT + INSULT + "".join(map(re.escape, self.mark_of.values())) + "]")

    def symbol(self, word: str) -> str:
        best = max((p for p in affixes(word) if p in self.mark_of), key=self.patterns.__getitem__, default=None)
        if best is not None:
            return self.mark_of[best]
        for words, s in ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            if word in words:
                return s
        return OTHER

    def symbols(self, raw: str) -> str:
        """Symbols of a stretch without white space."""
        found = WORD.findall(raw)
        return "".join([(REPORT if w in "“”\"«»" else END) if not w[0].isalpha() else self.symbol(w) for w in found])

    def clauses(self, text: str | None) -> list[float]:
        """Weights of the clauses with a match, in text order."""
        if not text:
            return []
        cache = self.cache
        raw = text.lower().replace("\n", " . ").split()
        missing = set(raw).difference(cache)
        if missing:
            if len(cache) > CACHE_WORDS:
                cache.clear()
                missing = set(raw)
            for w in missing:
                cache[w] = self.symbols(w)
        line = "".join(map(cache.__getitem__, raw))
        if not self.strong.search(line):
            return []
        out: list[float] = []
        step, held = self.machine.step, self.weight_of
        # only stretches with an insult or threat add weight, and the machine stands at its start after END
        for clause in line.split(END):
            if not self.strong.search(clause):
                continue
            state, weight, last_insult, last_threat = 0, 0.0, 0.0, 0.0
            for s in clause + END:
                if s >= FIRST_MARK or s == INSULT:
                    last_insult, s = held[s], INSULT
                elif s == THREAT:
                    last_threat = held[s]
                state, _, insult, threat = step(state, s)
                weight += insult * last_insult + threat * last_threat
            if weight > 0:
                out.append(weight)
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Sum of the clauses' weights, and the heaviest clause."""
        weights = self.clauses(text)
        return (sum(weights), max(weights)) if weights else (0.0, 0.0)

    def score(self, text: str | None) -> float:
        total, most = self.features(text)
        bias, a, b = self.curve
        return 1.0 / (1.0 + math.exp(-min(max(bias + a * total + b * most, -30.0), 30.0)))


def affixes(word: str) -> list[str]:
    """The word itself (``=word``), its beginnings (``word*``) and endings (``*word``)."""
    found = ["=" + word]
    for k in AFFIXES:
        if k <= len(word):
            found += [word[:k] + "*", "*" + word[-k:]]
    return found


def choose_patterns(toxic: list[set[str]], clean: list[set[str]], need: int = NEED) -> dict[str, float]:
    """Greedy cover of the toxic word sets by patterns that the clean ones hardly hold."""
    least = max(3, len(toxic) // 200)
    # upper bounds of the patterns' document counts, in a fixed number of buckets: only patterns that may
    # stand in enough texts get an entry of their own
    bound = np.zeros(BUCKETS, dtype=np.int32)
    for words in toxic:
        bound[list({hash_word(p) % BUCKETS for w in words for p in affixes(w)})] += 1
    may = bound >= least
    once: dict[str, list[int]] = defaultdict(list)
    twice: dict[str, list[int]] = defaultdict(list)
    words_with: Counter[str] = Counter()
    for i, words in enumerate(toxic):
        held = Counter(p for w in words for p in affixes(w) if may[hash_word(p) % BUCKETS])
        words_with.update(held)
        for p, n in held.items():
            once[p].append(i)
            if n > 1:
                twice[p].append(i)
    once = {p: d for p, d in once.items() if len(d) >= least}
    clean_once, clean_twice, clean_words = Counter(), Counter(), Counter()
    for words in clean:
        held = Counter(p for w in words for p in affixes(w) if p in once)
        clean_words.update(held)
        clean_once.update(held.keys())
        clean_twice.update(p for p, n in held.items() if n > 1)
    total, other = len(toxic) + 1.0, len(clean) + 1.0

    def odds(n: int, against: int) -> float:
        return math.log((n + 0.5) / total) - math.log((against + 0.5) / other)

    good: dict[str, tuple[np.ndarray, int]] = {}
    for p, d in once.items():
        pairs = twice.get(p, [])
        if odds(len(d), clean_once[p]) > MIN_ODDS and clean_once[p] / other < MAX_CLEAN:
            good[p] = np.array(d), 1
        elif len(pairs) >= least and odds(len(pairs), clean_twice[p]) > MIN_ODDS and clean_twice[p] / other < 2 * MAX_CLEAN:
            good[p] = np.array(pairs), 2
    weight = {p: min(odds(words_with[p], clean_words[p]), 6.0) for p in good}
    left = np.full(len(toxic), need)
    queue = [(-len(d), -weight[p], p) for p, (d, _) in good.items()]
    heapq.heapify(queue)
    chosen: dict[str, float] = {}
    while queue:
        gain, _, p = heapq.heappop(queue)
        d, credit = good[p]
        now = int((left[d] > 0).sum())
        if now < least:
            continue
        if now < -gain:
            heapq.heappush(queue, (-now, -weight[p], p))
            continue
        chosen[p] = weight[p]
        left[d] -= credit
    return {p: w for p, w in chosen.items() if w > 0.5}


def fit_curve(points: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve over the features by gradient steps with a small ridge; slopes stay >= 0."""
    x = np.column_stack([np.ones(len(points)), points / 6.0])
    w = np.array([-3.0, 1.0, 0.0])
    past = np.full(3, 1e-6)
    for _ in range(1500):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - label) / len(x) + 2e-4 * w * [0, 1, 1]
        past += g * g
        w = np.maximum(w - 0.5 * g / np.sqrt(past), [-30.0, 0.0, 0.0])
    return float(w[0]), float(w[1] / 6.0), float(w[2] / 6.0)


def word_set(text: str | None) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", (text or "").lower()))


def learned(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, usable=None) -> Grammar:
    """The grammar learned from a sample of labelled documents.

    ``usable``: condition on doc_id of the labels that may be learned from. The sample is the
    ``per_class`` labelled ids of least hash in each class, so the broadcast side has a fixed bound.
    """
    marks = labels.filter("doc_id is not null and toxic is not null")
    marks = marks.filter(usable) if usable is not None else marks
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    parts = [marks.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "toxic", "t.text")
    texts = written(texts, "toxic-sample")  # at most 2 * per_class rows
    words = texts.select("doc_id", "toxic", "text").mapInArrow(_word_sets, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, toxic int, words array<string>")
    got = written(words, "toxic-words").toPandas()  # different words only, however long a text is
    if not len(got) or got["toxic"].nunique() < 2:
        return Grammar()
    # near copies say the same thing: one text for each four least word hashes
    got["key"] = [str(sorted(map(hash_word, w))[:4]) for w in got["words"]]
    got = got.sort_values(["key", "doc_id"]).drop_duplicates(["key", "toxic"])
    is_toxic = got["toxic"].to_numpy() == 1
    own = Grammar(choose_patterns(*[[set(w) for w in got["words"][is_toxic == c]] for c in (True, False)]))
    points = {r["doc_id"]: (r["total"], r["most"]) for r in _featured(texts.select("doc_id", "text"), own).collect()}
    own.curve = fit_curve(np.array([points[i] for i in got["doc_id"]]), is_toxic.astype(float))
    return own


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([sorted(word_set(t)) for t in batch.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), words], ["doc_id", "toxic", "words"])


def _featured(texts: DataFrame, model: Grammar) -> DataFrame:
    """(doc_id, total, most) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))], ["doc_id", "total", "most"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, total double, most double")


def hash_word(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def scored(docs: DataFrame, model: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    rows = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 200 * NEED patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column("text")
            score = [own.score(t) for start in range(0, len(texts), 1000) for t in texts.slice(start, 1000).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())],
                ["doc_id", "score", "predicted"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
