"""The repair against a plain search over all edits, and the query against the same with the contract's damage."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from riskspark.llm import conversation_repair as repair
from riskspark.llm import queries

SOUND = re.compile(r"(s?(ua)+)?")
C = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """(cost, audit, turns) by best-first search over whole edit sequences; rows are (role, text, fault)."""

    def may_go_on(initials):
        return re.fullmatch(r"s?(ua)*u?", initials) is not None

    heap, best = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, turns = heapq.heappop(heap)
        if i == len(rows) and SOUND.fullmatch(initials):
            return cost, audit, list(turns)
        key = (i, initials[-1:], audit)
        if key in best:
            continue
        best.add(key)
        steps = []
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((3, "D", i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                steps += [(more, "K", i + 1, (role, text))] + [(2 + more, "R", i + 1, (new, text)) for new in ("user", "assistant")]
        steps += [(2, "I", i, (new, "")) for new in ("user", "assistant")]
        for more, edit, j, turn in steps:
            after = initials + (turn[0][:1] or "?" if turn else "")
            if may_go_on(after):
                heapq.heappush(heap, (cost + more, audit + edit, j, after, turns + ((turn,) if turn else ())))


def brute(rows, n=None):
    """One conversation's figures from its rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    judged, seen = [], []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.append((role, text))
        judged.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    kinds = [f for *_, f in judged]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
    cost, audit, kept = cheapest(judged)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


def damage(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return by


def test_search_equals_trying_all_edits():
    rng = random.Random(8)
    letter = {"blank": "b", "duplicate": "d", "truncated": "t", "": ""}
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), f"t{i}", rng.choice(["", "", "", *letter])) for i in range(rng.randrange(7))]
        got = repair.cheapest_edits(tuple((r[:1], letter[f]) for r, _, f in rows))
        cost, audit, kept = cheapest(rows)
        assert got == (cost, audit), rows
        assert repair.apply_edits([(r, t) for r, t, _ in rows], audit) == kept


def test_blocks_of_rows_do_not_matter(monkeypatch):
    rng = random.Random(9)
    for n in (40, 100, 333):
        rows = tuple((rng.choice("uaus") if rng.random() < 0.3 else "ua"[i % 2], rng.choice(["", "", "t", "b", "d"])) for i in range(n))
        whole = repair.cheapest_edits(rows)
        for step in (1, 5, 64):
            monkeypatch.setattr(repair, "STEP", step)
            assert repair._cheapest(rows) == whole


def odd():
    rng = random.Random(6)
    rows = [
        (rng.randrange(120), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "User", "", None, "tool"]), rng.choice([None, "", " \x0b", "One.", "Two!", "no end", "é", "A?\n", "A."]))
        for _ in range(420)
    ]
    return rows + [(None, 0, "user", "Null id."), (None, None, None, None), (500, 0, "user", "Same.")] + [(501, 1, "assistant", "Same.")] * 4


@pytest.mark.parametrize("rows", [odd(), [], duckdb.sql("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.001/conversations.parquet'").fetchall()])
def test_query_equals_brute_force(spark, tmp_path, rows):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(path)
    got = [tuple(r) for r in queries.op13_conversation_repair(spark, str(tmp_path)).select(*C).collect()]
    want = [(conv, *brute(own)) for conv, own in damage(rows).items()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_all_conversations_of_a_table_are_sound_after_repair(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = repair.repair_conversations(queries.damaged(turns), gone="gone").collect()
    assert len(rows) == turns.select("conv_id").distinct().count()
    for row in rows:
        assert SOUND.fullmatch("".join(t.role[:1] for t in row.repaired))


def test_rows_left_out_and_other_columns(spark):
    rows = [(1, 0, "user", "Hi.", True, "x"), (1, 1, "assistant", "Yes.", True, "x"), (2, 0, "user", "Hi.", None, "x"), (2, 1, "assistant", "Yes.", False, "x")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, gone boolean, audit string").withColumnRenamed("audit", "Text")
    got = {r.conv_id: r for r in repair.repair_conversations(turns, gone="gone").collect()}
    assert (got[1].cost, got[1].audit, got[1].repaired) == (0, "", [])
    assert (got[2].cost, got[2].audit, [tuple(t) for t in got[2].repaired]) == (0, "KK", [("user", "Hi."), ("assistant", "Yes.")])
