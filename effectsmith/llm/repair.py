"""Repair of conversations whose turns are missing, blank, repeated, cut off or out of order.

A conversation should be an optional system turn and then pairs of a user and an assistant turn. Edits: Keep a
row (0), Rerole it to user or assistant (2), Delete it (3; blank and repeated rows must go), Insert an empty
turn (2); a cut-off row that stays costs 1 more. The cheapest edits are found by a dynamic program over four
states (nothing yet, after system, after user, after assistant).

Rows are dealt by conversation and sorted by turn, the last turn first, and stream through ``mapInPandas``: the
costs to the end of the conversation are carried from batch to batch, and each row leaves one byte, the best edit
from each state. At the conversation's first row these bytes are walked forward, which gives the least edits, of
equal costs those whose initials come first in ASCII. Rows and bytes of a giant conversation go to a temporary
file of the task in blocks; a block is what is held in memory. The file goes away with the conversation.

Whether a row repeats an earlier one is found before, by a window in the same partitions.

Defined results: a null text or role is one blank; a null conv_id is a conversation, a null turn comes before all
others. Rows of one turn are taken by role and text; equal rows stand side by side. A role counts by its initial;
one that is not s, u or a fits nowhere. Other columns are not read. An empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of rows that a conversation holds in memory before they go to its file.
BLOCK_BYTES = 8_000_000
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. Where a kept initial, and where an insertion or a new role leads.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
FORCED = [2, 2, 3, 2]
ROLE_OF = ["user", "user", "assistant", "user"]
LETTERS = "DIKR"
FAULTS = ("blank", "duplicate", "truncated")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs to the end behind the last row: a user turn lacks its answer, a system turn a pair.
AT_END, END_EDITS = (0, 2 * INSERT, INSERT, 0), (-1, 1, 1, -1)

_steps: dict[tuple, tuple[tuple, int, int]] = {}


def step(costs: tuple, initial: str, fault: int) -> tuple[tuple, int, int]:
    """Costs before a row from the costs behind it: (costs less the least one, the least one, edits as a byte).

    Costs are kept without their least one, so only few of them exist and each step is worked out once.
    """
    key = (costs, initial if initial in "sua" else "", fault)
    done = _steps.get(key)
    if done is None:
        options = []
        for state in range(4):
            each = {0: DELETE + costs[state]}
            if fault not in (BLANK, DUPLICATE):
                cut = CUT if fault == TRUNCATED else 0
                if initial in NEXT[state]:
                    each[2] = KEEP + cut + costs[NEXT[state][initial]]
                each[3] = REROLE + cut + costs[FORCED[state]]
            options.append(each)
        best = [min(each.values()) for each in options]
        for _ in range(3):
            best = [min(best[q], INSERT + best[FORCED[q]]) for q in range(4)]
        byte = 0
        for q in range(4):
            letters = [k for k, c in options[q].items() if c == best[q]] + [1] * (INSERT + best[FORCED[q]] == best[q])
            byte |= min(letters) << 2 * q
        least = min(best)
        done = _steps[key] = (tuple(c - least for c in best), least, byte)
    return done


class Tape:
    """Rows of one conversation, last one first, with their bytes; read back first row first."""

    def __init__(self, block_bytes: int = BLOCK_BYTES) -> None:
        self.block_bytes = block_bytes
        self.rows: list[tuple[str, str]] = []
        self.edits = bytearray()
        self.held = 0
        self.places: list[int] = []
        self.file = None

    def add(self, role: str, text: str, edits: int) -> None:
        self.rows.append((role, text))
        self.edits.append(edits)
        self.held += len(text) + 64
        if self.held > self.block_bytes:
            self.file = self.file or tempfile.TemporaryFile()
            self.places.append(self.file.tell())
            pickle.dump((self.rows, bytes(self.edits)), self.file, protocol=pickle.HIGHEST_PROTOCOL)
            self.rows, self.edits, self.held = [], bytearray(), 0

    def __iter__(self) -> Iterator[tuple[str, str, int]]:
        yield from ((*row, edits) for row, edits in zip(reversed(self.rows), reversed(self.edits), strict=True))
        for place in reversed(self.places):
            self.file.seek(place)
            rows, edits = pickle.load(self.file)
            yield from ((*row, e) for row, e in zip(reversed(rows), reversed(edits), strict=True))

    def close(self) -> None:
        if self.file:
            self.file.close()


class Conversation:
    """What is known of a conversation while its rows come, the last one first."""

    def __init__(self, conv_id, block_bytes: int = BLOCK_BYTES) -> None:
        self.conv_id = conv_id
        self.tape = Tape(block_bytes)
        self.costs, self.paid = AT_END, 0
        self.faults = [0, 0, 0, 0]
        self.n_rows = self.illegal = self.distinct = 0
        self.most = self.least = None
        self.later_initial: str | None = None

    def add(self, turn: int | None, role: str, text: str, repeats: bool) -> None:
        end = text.rstrip(BLANKS)
        fault = BLANK if not end else DUPLICATE if repeats else TRUNCATED if end[-1] not in ".!?" else FINE
        initial = role[:1]
        self.costs, least, edits = step(self.costs, initial, fault)
        self.paid += least
        self.tape.add(role, text, edits)
        self.faults[fault] += 1
        self.n_rows += 1
        if self.later_initial is not None and initial + self.later_initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.later_initial = initial
        if turn is not None and turn != self.least:
            self.distinct += 1
            self.least = turn
            self.most = turn if self.most is None else self.most

    @property
    def gaps(self) -> int:
        return self.most - self.least + 1 - self.distinct if self.distinct else 0

    @property
    def cost(self) -> int:
        return self.paid + self.costs[0] if self.n_rows else 0

    def edits(self) -> Iterator[tuple[str, str | None, str | None]]:
        """(edit's initial, role, text) from the first to the last; a deleted row has its old role and text."""
        state = 0
        for role, text, byte in self.tape:
            letter = byte >> 2 * state & 3
            while letter == 1:
                yield "I", ROLE_OF[state], ""
                state = FORCED[state]
                letter = byte >> 2 * state & 3
            if letter == 0:
                yield "D", role, text
            elif letter == 2:
                yield "K", role, text
                state = NEXT[state][role[0]]
            else:
                yield "R", ROLE_OF[state], text
                state = FORCED[state]
        while END_EDITS[state] == 1:
            yield "I", ROLE_OF[state], ""
            state = FORCED[state]


def _blank_for_null(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by the hash of conversation and turn: of twenty numbers 0 drops a row
    (``gone``; it keeps its place, without text), 1 empties it, 2 takes its sentence marks, 3 repeats it, 4 makes
    it the user's. (conv_id, turn, role, text, gone)."""
    number = F.crc32(F.concat(_blank_for_null("conv_id"), F.lit(":"), _blank_for_null("turn")).cast("binary")) % 20
    text = _blank_for_null("text")
    rows = turns.select("conv_id", "turn", number.alias("n"), _blank_for_null("role").alias("role"), text.alias("text")).select(
        "conv_id", "turn",
        F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("n").isin(0, 1), "").when(F.col("n") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("n") == 0).alias("gone"),
        F.explode(F.when(F.col("n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _streamed(turns: DataFrame, of_conversation: Callable[[Conversation], Iterator[tuple]], columns: list[str], schema: str, block_bytes: int) -> DataFrame:
    """Runs each conversation of ``turns`` (conv_id, turn, role, text, and ``gone`` if there is one: such rows only
    say that the conversation exists) through the program and yields the tuples of ``of_conversation``."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), _blank_for_null("role").alias("role"), _blank_for_null("text").alias("text"), gone.alias("gone"))
    dealt = rows.repartition("conv_id").withColumn("digest", F.sha2("text", 256))
    same = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    marked = dealt.withColumn("n", F.row_number().over(same)).drop("digest")
    order = [F.col("conv_id"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("n").desc()]
    # ids travel as text and numbers without nulls: pandas would turn them into floats
    sorted_rows = marked.sortWithinPartitions(*order).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_id"), F.col("conv_id").isNull().alias("no_id"),
        F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", (F.col("n") > 1).alias("repeats"), "gone",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Conversation | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv_id, no_id, turn, no_turn, role, text, repeats, is_gone in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                conv_id = None if no_id else conv_id
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield from _flushed(now, out)
                    now = Conversation(conv_id, block_bytes)
                if not is_gone:
                    now.add(None if no_turn else turn, role, text, repeats)
        if now is not None:
            yield from _flushed(now, out)
        if out:
            yield _frame(out)

    def _flushed(conversation: Conversation, out: list[tuple]) -> Iterator[pd.DataFrame]:
        for row in of_conversation(conversation):
            out.append(row)
            if len(out) >= 1000:
                yield _frame(out)
                out.clear()
        conversation.tape.close()

    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([row[i] for row in out], dtype=object) for i, c in enumerate(columns)})

    done = sorted_rows.mapInPandas(run, f"conv_id string, {schema}")
    return done.withColumn("conv_id", F.col("conv_id").cast(turns.schema["conv_id"].dataType))


def repaired(turns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, place, edit, role, text): the edits of every conversation in order, from place 0. Rows whose edit
    is not D are the repaired conversation."""

    def rows(c: Conversation) -> Iterator[tuple]:
        for place, (edit, role, text) in enumerate(c.edits()):
            yield c.conv_id, place, edit, role, text

    names = ["conv_id", "place", "edit", "role", "text"]
    return _streamed(turns, rows, names, "place long, edit string, role string, text string", block_bytes)


def audited(turns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a conversation: its gaps, faults and illegal neighbours, the cost of its repair, the initials of the
    edits, and the digest of the repaired ``role:text`` rows, joined by line ends."""

    def row(c: Conversation) -> Iterator[tuple]:
        digest, letters, first = hashlib.sha256(), [], True
        for edit, role, text in c.edits() if c.n_rows else ():
            letters.append(edit)
            if edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        yield c.conv_id, c.gaps, *c.faults[1:], c.illegal, c.cost, "".join(letters), digest.hexdigest()

    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    numbers = ", ".join(f"{c} long" for c in names[1:7])
    return _streamed(turns, row, names, f"{numbers}, audit string, repaired_sha256 string", block_bytes)
