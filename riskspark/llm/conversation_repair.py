"""Repair of conversation structure by iterative-deepening A*.

A sound conversation is empty, or has an optional system turn and then user and assistant turns in turn. Edits make one of
any rows: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or assistant turn) 2, and a row
that is cut off and not deleted 1 more. Blank and repeated rows must be deleted. The cheapest edits are searched for, and of
those the ones whose initials come first in ASCII.

What the next role must be follows from the last one, so a state is a row number and one of four places in the pattern.
The search goes depth first, in ASCII order of the edits, as far as a bound on the cost and an admissible estimate of the
rest allow; when it fails the bound rises to the least cost that was cut off. A transposition table keeps, per state, the
cost that was proven too low from there, so a failed state is not entered again with as little left. The table serves all
bounds. Rows near the end are searched first, STEP rows at a time: the estimate of earlier rows then starts from an exact
cost and is off by a few edits at most, so the work grows with the rows, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import pick, small_batches

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # fixed values: costs
STEP = 32
SPACE = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}

START, SYSTEM, USER, ASSISTANT = range(4)  # what the last kept role was
ENDS = {START, ASSISTANT}
NEXT = ((USER, "u"), (USER, "u"), (ASSISTANT, "a"), (USER, "u"))  # what a rerole or an insert makes after each
NAMES = {"u": "user", "a": "assistant"}
RESULT = (
    "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string,"
    "repaired:array<struct<role:string,text:string>>>"
)

Row = tuple[str, str]  # initial of the role; fault: "b"lank, "d"uplicate, "t"runcated or none


def estimates(rows: tuple[Row, ...], low: int, high: int) -> list[int]:
    """A lower bound of what the rows from each of low..high-1 up to high add to the cost.

    Rows that must go cost a deletion each and cut-off rows at least 1 each. Among the others an edit mends two illegal
    neighbourhoods at most and costs 2 at least, beyond what its row costs anyway.
    """
    bound = [0] * (high - low)
    held, after = 0, None
    for i in range(high - 1, low - 1, -1):
        initial, fault = rows[i]
        if fault in ("b", "d"):
            held += DELETE
        else:
            held += CUT_OFF * (fault == "t") + (after is not None and initial + after not in LEGAL)
            after = initial
        bound[i - low] = held
    return bound


def edits_from(rows: tuple[Row, ...], i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, next row, next state) of each edit allowed in a state, in ASCII order."""
    if i < len(rows):
        yield "D", DELETE, i + 1, state
    made, role = NEXT[state]
    yield "I", INSERT, i, made
    if i < len(rows):
        initial, fault = rows[i]
        if fault in ("b", "d"):
            return
        more = CUT_OFF if fault == "t" else 0
        if initial == role:
            yield "K", KEEP + more, i + 1, made
        elif initial == "s" and state == START:
            yield "K", KEEP + more, i + 1, SYSTEM
        yield "R", REROLE + more, i + 1, made


def search(rows: tuple[Row, ...], low: int, state: int, high: int, least: list[list[int]]) -> tuple[int, str, int]:
    """Cost of all edits from a state at row `low` on, initials of those up to row `high`, and the state there.

    `least` is the transposition table: exact at `high`, a lower bound before it, and it learns.
    """
    bound = least[low][state]
    while True:
        path: list[str] = []
        # A frame: row, state, what is left of the bound, edits not tried, least cost found from here so far.
        frames = [[low, state, bound, edits_from(rows, low, state), 1 << 60]]
        while frames:
            frame = frames[-1]
            at, now, left, edits, _ = frame
            if at == high:
                return bound, "".join(path), now
            for initial, cost, row, made in edits:
                if cost + least[row][made] <= left:
                    path.append(initial)
                    frames.append([row, made, left - cost, edits_from(rows, row, made), 1 << 60])
                    break
                frame[4] = min(frame[4], cost + least[row][made])
            else:  # failed: nothing from here on costs as little as is left
                frames.pop()
                least[at][now] = max(least[at][now], left + 1, frame[4])
                if frames:
                    path.pop()
                    parent = frames[-1]
                    parent[4] = min(parent[4], parent[2] - left + least[at][now])
        bound = least[low][state]


def cheapest_edits(rows: tuple[Row, ...]) -> tuple[int, str]:
    """Cost and initials of the cheapest edits, of several the least in ASCII."""
    return _cheapest_short(rows) if len(rows) <= STEP else _cheapest(rows)


@lru_cache(maxsize=50_000)
def _cheapest_short(rows: tuple[Row, ...]) -> tuple[int, str]:
    return _cheapest(rows)


def _cheapest(rows: tuple[Row, ...]) -> tuple[int, str]:
    borders = [*range(0, len(rows), STEP), len(rows)]
    least = [[0] * 4 for _ in range(len(rows))]
    least.append([0, 2 * INSERT, INSERT, 0])  # by state at the end: nothing, user and assistant, assistant, nothing
    for low, high in zip(borders[-2::-1], borders[:0:-1]):
        rest = min(least[high])
        for i, bound in enumerate(estimates(rows, low, high), low):
            least[i] = [rest + bound] * 4
        if low:
            for state in range(4):
                least[low][state] = search(rows, low, state, high, least)[0]
    costs, audit, state = [], "", START
    for low, high in zip(borders, borders[1:]):
        cost, part, state = search(rows, low, state, high, least)
        costs.append(cost)
        audit += part
    # What the pattern lacks at the end is inserted.
    while state not in ENDS:
        audit += "I"
        state = NEXT[state][0]
    return costs[0] if costs else 0, audit


def apply_edits(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns (role, text) that the edits leave."""
    out, i, state = [], 0, START
    for edit in audit:
        made, role = NEXT[state]
        if edit == "D":
            i += 1
            continue
        if edit == "I":
            out.append((NAMES[role], ""))
            state = made
            continue
        kept, text = turns[i]
        i += 1
        if edit == "R":
            kept = NAMES[role]
        state = SYSTEM if edit == "K" and kept[:1] == "s" else made
        out.append((kept, text))
    return out


def judge(turns: list[tuple[int | None, str, str]]) -> dict[str, object]:
    """Faults, cheapest edits and repaired turns of one conversation's rows (turn, role, text) in order."""
    known = {t for t, _, _ in turns if t is not None}
    seen: set[tuple[str, str]] = set()
    rows: list[Row] = []
    for _, role, text in turns:
        body = text.strip(SPACE)
        if not body:
            fault = "b"
        elif (role, text) in seen:
            fault = "d"
        else:
            fault = "" if body[-1] in ".!?" else "t"
        seen.add((role, text))
        rows.append((role[:1], fault))
    faults = [fault for _, fault in rows]
    cost, audit = cheapest_edits(tuple(rows))
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        "blank": faults.count("b"),
        "duplicate": faults.count("d"),
        "truncated": faults.count("t"),
        "illegal": sum(a + b not in LEGAL for (a, _), (b, _) in zip(rows, rows[1:])),
        "cost": cost,
        "audit": audit,
        "repaired": [{"role": r, "text": t} for r, t in apply_edits([(r, t) for _, r, t in turns], audit)],
    }


def repair_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    gone: str | None = None,
) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (turns) of every conversation.

    Rows are in order of turn (null first), ties by role, then text; equal rows are repeats. A null role or text is one space.
    Null conversation ids make one conversation, with a null id. Rows whose column `gone` is true are left out, but their
    conversation appears; one without rows has zeros, an empty audit and no turns. An empty table gives no rows. Extra
    columns are left out and may have any names. One shuffle, by conversation. A conversation becomes one value, as its
    repaired text does, so it is bounded by what a row can hold.
    """
    small_batches(turns.sparkSession)
    named = {"conv_id": conversation, "turn": turn, "role": role, "text": text} | ({"gone": gone} if gone else {})
    rows = pick(turns, **named)
    stays = ~F.coalesce(F.col("gone"), F.lit(False)) if gone else F.lit(True)
    space = F.lit(" ")
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(stays, row))).alias("rows"))

    @F.arrow_udf(RESULT)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct(
            [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
            + [("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
        )
        for batch in batches:
            yield pa.array([judge([(r["turn"], r["role"], r["text"]) for r in c.as_py()]) for c in batch], kind)

    return grouped.select("conv_id", judged("rows").alias("j")).select("conv_id", "j.*")


def repaired_text(repaired: Column) -> Column:
    """The repaired turns as lines of `role:text`."""
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
