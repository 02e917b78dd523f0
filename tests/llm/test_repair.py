import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from effectsmith.llm import repair
from effectsmith.llm.registry import QUERIES

COLUMNS = "conv_id long, turn long, role string, text string"
WHOLE = re.compile("(s?(ua)+)?")


def cheapest(rows, faults):
    """(cost, audit) by search over all edit strings, least cost first and then by ASCII."""
    heap, least = [(0, "", 0, "")], {}

    def push(cost, audit, i, out):
        if re.fullmatch("s?(ua)*u?", out) and len(out) < len(rows) + 4:
            heapq.heappush(heap, (cost, audit, i, out))

    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if i == len(rows) and WHOLE.fullmatch(out):
            return cost, audit, out
        if least.setdefault((i, out[-1:]), cost) < cost:  # the same is to be had for less
            continue
        for role in "ua":
            push(cost + 2, audit + "I", i, out + role)
        if i < len(rows):
            initial, fault = rows[i][0][:1], faults[i]
            push(cost + 3, audit + "D", i + 1, out)
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if initial:
                    push(cost + cut, audit + "K", i + 1, out + initial)
                for role in "ua":
                    push(cost + 2 + cut, audit + "R", i + 1, out + role)
    raise AssertionError


def brute(rows):
    """The contract's columns of one conversation; rows (turn, role, text) after damage, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = cheapest([(r, t) for _, r, t in rows], faults)
    lines, i, at = [], 0, 0
    for letter in audit:
        if letter in "KR":
            role = rows[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[out[at]]
            lines.append(f"{role}:{rows[i][2]}")
        elif letter == "I":
            lines.append({"u": "user", "a": "assistant"}[out[at]] + ":")
        at += letter != "D"
        i += letter != "I"
    return gaps, *(faults.count(f) for f in repair.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    """Rows of one conversation (conv_id, turn, role, text), damaged and in order."""
    out = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        n = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def some_conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for conv_id in range(n):
        for turn in range(r.randint(1, 7)):
            rows.append((conv_id, turn + (r.random() < 0.1) if r.random() > 0.05 else None, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(["a.", "b!", "c", " ", "", None, "a. \n", "d?"])))
    return rows


def expected(rows):
    ids = dict.fromkeys(r[0] for r in rows)
    return {i: brute(damaged([r for r in rows if r[0] == i])) for i in ids}


@pytest.mark.parametrize("block_bytes", [100, repair.BLOCK_BYTES])
def test_audits_equal_search(spark, block_bytes):
    rows = [*some_conversations(5, 250), (None, 0, "user", "x."), (None, 1, "assistant", "y.")]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.audited(repair.damaged(frame), block_bytes).collect()}
    assert got == expected(rows)


def test_query_equals_search(spark, tmp_path):
    rows = some_conversations(8, 120)
    spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' as n", "1 as gone").write.parquet(str(tmp_path / "conversations.parquet"))
    found = QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == expected(rows)
    assert len(found) == 120


def test_repaired_rows_are_a_conversation(spark):
    rows = some_conversations(9, 60)
    out = repair.repaired(spark.createDataFrame(rows, COLUMNS), block_bytes=50).orderBy("conv_id", "place").collect()
    for conv_id in {r["conv_id"] for r in out}:
        kept = [r for r in out if r["conv_id"] == conv_id and r["edit"] != "D"]
        assert WHOLE.fullmatch("".join(r["role"][0] for r in kept))
        assert [r["place"] for r in out if r["conv_id"] == conv_id] == list(range(sum(r["conv_id"] == conv_id for r in out)))


def test_dropped_giant_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "a.")], COLUMNS)
    assert tuple(repair.audited(repair.damaged(frame)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.audited(repair.damaged(frame.limit(0))).count() == 0
    n = 30_000  # over several Arrow batches and blocks
    giant = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id, '.') as text")
    row = repair.audited(giant.repartition(6), block_bytes=20_000).first()
    assert (row["cost"], row["audit"]) == (0, "K" * n)
    whole = "\n".join(f"{'assistant' if i % 2 else 'user'}:text {i}." for i in range(n))
    assert row["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


def test_one_shuffle(spark):
    frame = spark.createDataFrame(some_conversations(1, 5), COLUMNS)
    plan = repair.audited(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1
