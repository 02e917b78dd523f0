"""Personal data by a semi-Markov conditional random field over bounded entities.

Four patterns with checks (mail address, IPv4 address, card number by Luhn, phone number) give the base spans of a
text. What they swallow or miss (a phone number that runs into a card number, a mail address written out, numbers
with other separators) is left to the field: in the regions around digits and @ every segment of at most MAX_TOKENS
tokens that could be an entity is a candidate of its type, scored by features of the whole span (shape, lengths of
its digit groups, separators, Luhn, octets, what stands before and behind). Texts outside regions hold no candidate.
A dynamic program over candidates chooses boundaries and types together; an added span does not overlap a base span
and has a probability of at least MIN_PROBABILITY by forward-backward.

The weights are learned on the base spans: a sample of at most PER_CLASS regions with each type and without any,
least hashes first, and the same spans rewritten: two in a row, other separators, no plus sign, written-out signs,
and numbers that fail a check, which are no entity.

Defined results: null and empty texts have no spans. Repeated rows are judged each. Offsets count code points.
Regions are cut from whole texts; the work grows with their length only. Without regions to learn from the field
adds nothing. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effectsmith.functions.lineage import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Regions learned from for each type and for none; the sample's only bound.
PER_CLASS = 150
MAX_TOKENS = 40
#: Characters that a region goes beyond its digits or sign on either side, at most.
REACH = 256
#: Regions of more characters are searched, but not learned from.
MAX_LEARNED = 300
MIN_PROBABILITY = 0.6
ROUNDS, RATE, RIDGE = 60, 0.5, 0.002

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]*+")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, leftmost and non-overlapping for each; matches that fail their check are
    dropped. In the order of start and kind."""
    found: list[Span] = []
    if "@" in text:
        low = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, EMAIL, m.end()))
                low = m.end()
    if "." in text:
        found += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if _octets(m.group().split("."))]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            matched = m.group().rstrip(" ().-")
            if 9 <= len(_NOT_DIGIT.sub("", matched)) <= 15:
                found.append((m.start(), PHONE, m.start() + len(matched)))
    return sorted(found)


# --- regions and candidates -----------------------------------------------------------------------

_ANCHOR = re.compile(r"[0-9@]+")
_DOT = re.compile(r"(?i)(?<![A-Za-z])dot(?![A-Za-z])")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s|.", re.S)
_BLANK = re.compile(r"\s")
_AT_SIGN = r"(?: ?@ ?| ?[\[({] ?(?i:at) ?[\])}] ?| (?i:at) )"
_DOT_SIGN = r"(?:\.| ?[\[({] ?(?i:dot) ?[\])}] ?| (?i:dot) )"
_SHAPES = (
    re.compile(rf"[A-Za-z0-9._%+-]++{_AT_SIGN}[A-Za-z0-9-]++(?:{_DOT_SIGN}[A-Za-z0-9-]++)+"),
    re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot ) ?[0-9]{1,3}){3}"),
    re.compile(r"[0-9]+(?:[ ._/-]{1,3}[0-9]+)*"),
    re.compile(r"(?:\+ ?)?\(?[0-9][ ()./0-9-]*[0-9]"),
)
_DIGIT_RANGE = {CARD: (12, 19), PHONE: (7, 15)}


def regions(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the words with digits or @ and one word on either side; three words before a spelled-out
    dot. Regions that touch are one."""
    anchors = [(m.start(), m.end(), 1) for m in _ANCHOR.finditer(text)]
    if "dot" in text.lower():
        anchors = sorted(anchors + [(m.start(), m.end(), 3) for m in _DOT.finditer(text)])
    done, start, end = 0, -1, -1
    for low, high, words in anchors:
        if high <= end and words == 1:
            continue
        left, least = low, max(low - REACH, done)
        for k in range(words + 1):
            while left > least and not _BLANK.match(text, left - 1):
                left -= 1
            if k < words and left > least:
                left -= 1
        right, most = high, min(high + REACH, len(text))
        for k in range(2):
            while right < most and not _BLANK.match(text, right):
                right += 1
            if k < 1 and right < most:
                right += 1
        if end >= 0 and left <= end:
            start, end = min(start, left), max(end, right)
        else:
            if end >= 0:
                yield start, end
                done = end
            start, end = max(left, done), right
    if end >= 0:
        yield start, end


def _class(c: str) -> str:
    return "" if not c else "9" if c in "0123456789" else "a" if c.isalpha() else " " if c.isspace() else c


def candidates(text: str, start: int, end: int, fixed: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every segment of the region that has the shape of a type and overlaps no fixed span."""
    edges = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
    taken = sorted((s, e) for s, _, e in fixed if s < end and e > start)
    found = []
    stop = next_taken = 0
    for n, low in enumerate(edges[:-1]):
        c = text[low]
        if not (c in "+(" or c.isalnum()) or not c.isascii():
            continue
        while next_taken < len(taken) and taken[next_taken][1] <= low:
            next_taken += 1
        stop = edges[min(n + MAX_TOKENS, len(edges) - 1)]
        if next_taken < len(taken):
            if taken[next_taken][0] <= low:
                continue
            stop = min(stop, taken[next_taken][0])
        whole = [shape.match(text, low, stop) for shape in _SHAPES]
        most = [m.end() if m else low for m in whole]
        for k in range(n + 1, min(n + MAX_TOKENS, len(edges) - 1) + 1):
            high = edges[k]
            if high > max(most):
                break
            if not text[high - 1].isalnum():
                continue
            for kind, shape in enumerate(_SHAPES):
                if high <= most[kind] and shape.fullmatch(text, low, high):
                    if kind in _DIGIT_RANGE:
                        n_digits = len(_NOT_DIGIT.sub("", text[low:high]))
                        if not _DIGIT_RANGE[kind][0] <= n_digits <= _DIGIT_RANGE[kind][1]:
                            continue
                    found.append((low, high, kind))
    return found


def features(text: str, low: int, high: int, kind: int) -> list[str]:
    """Features of a whole span as its type, with what stands on both sides."""
    span = text[low:high]
    before, after = text[max(low - 24, 0) : low], text[high : high + 24]
    near = (before.rstrip()[-1:], after.lstrip()[:1])
    out = [
        "", f"left {_class(before[-1:])}", f"right {_class(after[:1])}", f"near {_class(near[0])} {_class(near[1])}",
        f"right2 {_class(after[:1])}{_class(after[1:2])}",
    ]
    groups = re.findall("[0-9]+", span)
    if kind == EMAIL:
        local, sign, domain = re.split(f"({_AT_SIGN})", span, maxsplit=1)
        dots = set(re.findall(_DOT_SIGN, domain))
        last = re.split(_DOT_SIGN, domain)[-1]
        out += [f"at {sign.lower()}", *(f"dot {d.lower()}" for d in dots), f"tld {last.isalpha()} {min(len(last), 7)}", f"local {min(len(local), 8)}", f"local end {_class(local[-1:])}"]
    else:
        digits = "".join(groups)
        separators = sorted(set(re.split("[0-9]+", span)) - {""})
        sizes = [len(g) for g in groups]
        out += [f"n {len(digits)}", f"groups {min(len(groups), 9)}", f"sep {'|'.join(separators)[:12]}", f"sizes {'-'.join(map(str, sizes))[:16]}"]
        if kind == CARD:
            fine = luhn(digits)
            even = len(groups) == 1 or set(sizes[:-1]) == {4}
            out += [f"luhn {fine}", f"luhn even {fine} {even}", f"luhn one {fine} {len(separators) < 2}"]
        elif kind == IP:
            fine = _octets(groups)
            out += [f"octets {fine}", f"octets sep {fine} {len(separators)}", f"zero {any(g[0] == '0' and len(g) > 1 for g in groups)}"]
        else:
            plus = span[0] == "+" or span.startswith("00")
            paren = "(" in span and ")" in span
            out += [f"plus {plus}", f"paren {paren} {span.count('(') == span.count(')')}", f"plus sizes {plus} {'-'.join(map(str, sizes))[:16]}", f"bare {plus or paren or bool(separators)}"]
    return [f"{kind} {f}" for f in out]


# --- the field ------------------------------------------------------------------------------------


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def posterior(cands: list[tuple[int, int, int]], scores: list[float]) -> tuple[list[float], float]:
    """Probability of each candidate segment, and the log of the sum over all segmentations.

    Places between segments score nothing, so only the candidates' edges are steps of the program.
    """
    edges = sorted({p for c in cands for p in c[:2]})
    at = {p: i for i, p in enumerate(edges)}
    ending: list[list[int]] = [[] for _ in edges]
    for k, (_, high, _) in enumerate(cands):
        ending[at[high]].append(k)
    forward = [0.0] * len(edges)
    for i in range(1, len(edges)):
        forward[i] = forward[i - 1]
        for k in ending[i]:
            forward[i] = _log_add(forward[i], forward[at[cands[k][0]]] + scores[k])
    backward = [0.0] * len(edges)
    starting: list[list[int]] = [[] for _ in edges]
    for k, (low, _, _) in enumerate(cands):
        starting[at[low]].append(k)
    for i in range(len(edges) - 2, -1, -1):
        backward[i] = backward[i + 1]
        for k in starting[i]:
            backward[i] = _log_add(backward[i], backward[at[cands[k][1]]] + scores[k])
    total = forward[-1]
    return [math.exp(forward[at[low]] + s + backward[at[high]] - total) for (low, high, _), s in zip(cands, scores, strict=True)], total


def best_segments(cands: list[tuple[int, int, int]], scores: list[float]) -> list[int]:
    """Numbers of the candidates of the best segmentation; of equal ones the one that chooses later segments last."""
    edges = sorted({p for c in cands for p in c[:2]})
    at = {p: i for i, p in enumerate(edges)}
    ending: list[list[int]] = [[] for _ in edges]
    for k, (_, high, _) in enumerate(cands):
        ending[at[high]].append(k)
    best, chosen = [0.0] * len(edges), [-1] * len(edges)
    for i in range(1, len(edges)):
        best[i] = best[i - 1]
        for k in ending[i]:
            score = best[at[cands[k][0]]] + scores[k]
            if score > best[i]:
                best[i], chosen[i] = score, k
    out, i = [], len(edges) - 1
    while i > 0:
        if chosen[i] < 0:
            i -= 1
        else:
            out.append(chosen[i])
            i = at[cands[chosen[i]][0]]
    return out[::-1]


class Field:
    """Weights by feature; without weights nothing is added."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def score(self, text: str, cands: list[tuple[int, int, int]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in features(text, *c)]) for c in cands]

    def added(self, text: str, base: list[Span]) -> list[tuple[int, int, int, float]]:
        """(start, kind, end, probability) of the spans that the field adds to the base spans."""
        out = []
        if not self.weights:
            return out
        for start, end in regions(text):
            cands = candidates(text, start, end, base)
            if cands:
                scores = self.score(text, cands)
                sure, _ = posterior(cands, scores)
                out += [(cands[k][0], cands[k][2], cands[k][1], sure[k]) for k in best_segments(cands, scores) if sure[k] >= MIN_PROBABILITY]
        return out


def fitted(examples: list[tuple[str, list[Span]]]) -> Field:
    """Weights by gradient steps with step sizes by AdaGrad on the likelihood of the examples' segmentations."""
    number: dict[str, int] = {}
    flat: list[int] = []
    sizes: list[int] = []
    cases: list[tuple[list[tuple[int, int, int]], list[float], int]] = []
    for text, gold in examples:
        cands = candidates(text, 0, len(text), [])
        if cands:
            true = {(s, e, k) for s, k, e in gold}
            first = len(sizes)
            for c in cands:
                own = [number.setdefault(f, len(number)) for f in features(text, *c)]
                flat += own
                sizes.append(len(own))
            cases.append((cands, [float(c in true) for c in cands], first))
    if not cases:
        return Field({})
    index, ends = np.array(flat), np.cumsum(sizes)
    starts = ends - np.array(sizes)
    w, squares = np.zeros(len(number)), np.full(len(number), 1e-6)
    of_candidate = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(ROUNDS):
        scores = np.add.reduceat(w[index], starts).tolist()
        change = np.zeros(len(sizes))
        for cands, true, first in cases:
            sure, _ = posterior(cands, scores[first : first + len(cands)])
            change[first : first + len(cands)] = np.subtract(true, sure)
        gradient = np.bincount(index, change[of_candidate], minlength=len(w)) - RIDGE * w * len(cases)
        squares += gradient * gradient
        w += RATE * gradient / np.sqrt(squares)
    return Field({f: float(w[i]) for f, i in number.items()})


# --- learning -------------------------------------------------------------------------------------


def _rewritten(kind: int, span: str, r: random.Random) -> tuple[str, bool]:
    """Another writing of a span, and whether it is still an entity."""
    if kind == EMAIL:
        local, domain = span.split("@")
        at, dot = r.choice([(" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", "."), (" (at) ", " (dot) ")])
        return local + at + domain.replace(".", dot), True
    if kind == IP:
        parts = span.split(".")
        if r.random() < 0.4:
            parts[r.randrange(4)] = str(r.randint(256, 999))
            return ".".join(parts), False
        return r.choice(["[.]", "(.)", " . ", "[dot]"]).join(parts), True
    digits = _NOT_DIGIT.sub("", span)
    if kind == CARD:
        if r.random() < 0.5:
            i = r.randrange(len(digits))
            digits = digits[:i] + str((int(digits[i]) + r.randint(1, 9)) % 10) + digits[i + 1 :]
            return digits, luhn(digits)
        return r.choice([" ", "-", ".", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4)), True
    choice = r.randrange(6)
    if choice == 0:
        return digits[: r.randint(5, 8)], False
    if choice == 1:
        return digits, False
    if choice == 2:
        return "00" + r.choice([" ", ""]) + span.removeprefix("+"), True
    if choice == 3:
        return span[span.find("(") :] if "(" in span else span.removeprefix("+"), "(" in span
    if choice == 4:
        return "+" + r.choice(["-", ".", " "]).join([digits[:-10] or digits[:1], digits[-10:-7], digits[-7:-4], digits[-4:]]), True
    return r.choice(["-", "."]).join([digits[-10:-7], digits[-7:-4], digits[-4:]]), True


def examples(sample: list[tuple[str, list[Span]]]) -> list[tuple[str, list[Span]]]:
    """The sampled regions, and those with one span again with it rewritten and with another one behind it."""
    r = random.Random(0)
    single = [(t, g[0]) for t, g in sample if len(g) == 1]
    pool = [(k, t[s:e]) for t, (s, k, e) in single]
    out = list(sample)
    for text, (s, kind, e) in single:
        new, real = _rewritten(kind, text[s:e], r)
        gold = [(s, kind, s + len(new))] if real else []
        out.append((text[:s] + new + text[e:], gold))
        other, more = r.choice(pool)
        joined = text[s:e] + " " + more
        out.append((text[:s] + joined + text[e:], [(s, kind, e), (e + 1, other, s + len(joined))]))
    return out


def _clear(text: str, start: int, end: int, spans: list[Span]) -> bool:
    """Whether the base spans are all there is to a region: nothing with many digits or an @ is left."""
    rest = list(text[start:end])
    for s, _, e in spans:
        rest[s - start : e - start] = " " * (e - s)
    left = "".join(rest)
    return "@" not in left and not any(luhn(d) for d in re.findall("[0-9]{12,19}", left)) and (not spans or len(_NOT_DIGIT.sub("", left)) < 7)


def _sampled(docs: DataFrame, per_class: int) -> DataFrame:
    """(kind, hash, region, spans) of regions: a task keeps at most ``per_class`` of each type, least hashes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in range(-1, 4)}
        seen: dict[int, set] = {k: set() for k in range(-1, 4)}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text or not _ANCHOR.search(text):
                    continue
                base = base_spans(text)
                for start, end in regions(text):
                    inside = [b for b in base if start <= b[0] and b[2] <= end]
                    if end - start > MAX_LEARNED or any(b[2] > c[0] for b, c in zip(inside, inside[1:], strict=False)) or not _clear(text, start, end, inside):
                        continue
                    kind = inside[0][1] if inside else -1
                    region = text[start:end]
                    code = xxhash.xxh64_intdigest(region) >> 1
                    heap = held[kind]
                    if code in seen[kind] or len(heap) == per_class and -heap[0][0] <= code:
                        continue
                    if not inside and not candidates(region, 0, len(region), []):
                        continue
                    seen[kind].add(code)
                    entry = (-code, region, ",".join(f"{k}:{s - start}:{e - start}" for s, k, e in inside))
                    if len(heap) < per_class:
                        heapq.heappush(heap, entry)
                    else:
                        seen[kind].discard(-heapq.heappushpop(heap, entry)[0])
        rows = [(k, -c, t, s) for k, heap in held.items() for c, t, s in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.string()))], ["kind", "hash", "region", "spans"])

    return docs.select("text").mapInArrow(run, "kind int, hash long, region string, spans string")


def learned(docs: DataFrame, per_class: int = PER_CLASS) -> Field:
    """The field, learned on the base spans of ``docs``; at most 5 * ``per_class`` regions come to the driver."""
    rows = written(_sampled(docs, per_class), "pii-regions").dropDuplicates(["kind", "hash"])
    sample = []
    for kind in range(-1, 4):
        for row in rows.filter(F.col("kind") == kind).orderBy("hash", "region").limit(per_class).collect():
            spans = [tuple(map(int, s.split(":"))) for s in row["spans"].split(",")] if row["spans"] else []
            sample.append((row["region"], [(s, k, e) for k, s, e in spans]))
    return fitted(examples(sample)) if any(g for _, g in sample) else Field({})


# --- results --------------------------------------------------------------------------------------


def spans(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, kind, start, stop, text, added, probability) of every span; base spans have no probability."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                base = base_spans(text) if text else []
                more = field.added(text, base) if text else []
                for s, k, e, p in sorted([*((s, k, e, None) for s, k, e in base), *more], key=lambda x: x[:3]):
                    at.append(n)
                    found.append((KINDS[k], s, e, text[s:e], p is not None, p))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array([f[i] for f in found], t) for i, t in enumerate(kinds))],
                ["doc_id", "kind", "start", "stop", "text", "added", "probability"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kind string, start long, stop long, text string, added boolean, probability double")


def _listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def digests(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document: numbers and digest
    of its base spans, all spans as text, and how many the field added."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, listed, n_added = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = [x[:3] for x in field.added(text, base)] if text else []
                for k, column in enumerate(counts):
                    column.append(sum(b[1] == k for b in base))
                digest.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(sorted(base + more)))
                n_added.append(len(more))
            numbers = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *numbers, pa.array(digest, pa.string()), pa.array(listed, pa.string()), pa.array(n_added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    numbers = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {numbers}, base_sha256 string, spans string, n_added long")
