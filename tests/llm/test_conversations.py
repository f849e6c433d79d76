import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import Row

from lockstep.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, pos string, audit int, kind string"
WELL_FORMED = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def row(conv, turn, role, text):
    return Row(conv_id=conv, turn=turn, role=role, text=text, pos="x", audit=1, kind=None)


def plain_cheapest(rows):
    """All edits of rows (role, text, fault) up to the cost of deleting everything: the least (cost, audit) and its lines."""
    best = [(3 * len(rows), "D" * len(rows), [])]

    def go(i, cost, audit, roles, lines):
        if (cost, audit) > best[0][:2] and cost >= best[0][0] and not best[0][1].startswith(audit):
            return
        if i == len(rows) and WELL_FORMED.fullmatch(roles):
            best[0] = min(best[0], (cost, audit, lines))
        if cost + 2 <= best[0][0]:
            for name in ("user", "assistant"):
                go(i, cost + 2, audit + "I", roles + name[0], [*lines, name + ":"])
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, cost + 3, audit + "D", roles, lines)
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            go(i + 1, cost + more, audit + "K", roles + (role[:1] or "?"), [*lines, f"{role}:{text}"])
            for name in ("user", "assistant"):
                go(i + 1, cost + 2 + more, audit + "R", roles + name[0], [*lines, f"{name}:{text}"])

    go(0, 0, "", "", [])
    return best[0]


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of a conversation's (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, judged = set(), []
    for _, role, text in rows:
        held = text.strip(SPACE)
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for r, _, _ in judged]
    cost, audit, lines = plain_cheapest(judged)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def some(n, seed, most=5):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "why", "Is it? \n", "", " \t", None, "é…", "é…."]
    return [row(c if c else None, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randrange(1, most + 1))]


def by_conversation(rows):
    found = defaultdict(list)
    for r in rows:
        found[r.conv_id].append((r.turn, r.role, r.text))
    return found


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_repair_by_brute_force(spark):
    rows = some(150, 3)
    found = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(found) == {c: plain(x) for c, x in by_conversation(rows).items()}


@pytest.mark.parametrize("batch", [1, 7, 50])
def test_segments_and_levels_change_nothing(spark, batch, monkeypatch):
    rng = random.Random(batch)
    rows = [row(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "b", "", f"{t}."])) for c, n in ((1, 100), (2, 3), (None, 41), (4, 1)) for t in range(n)]
    turns = conversations.audited(spark.createDataFrame(rows, SCHEMA)).select("conv_id", "pos", "kind")
    whole = sorted(conversations.cheapest(turns).collect(), key=str)
    monkeypatch.setattr(conversations, "BATCH", batch)
    assert sorted(conversations.cheapest(turns, 3).collect(), key=str) == whole
    assert [len(re.findall("[DKRS]", r.letters)) for r in whole] == [{1: 100, 2: 3, None: 41, 4: 1}[r.conv_id] for r in whole]


def test_damage_and_lost_conversations(spark, tmp_path):
    rows = [r for r in some(60, 8, 4)] + [row(c, 0, "user", "Only one.") for c in range(1000, 1060)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for conv, turns in by_conversation(rows).items():
        left = []
        for t, role, text in turns:
            how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            left += [(t, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
        want[conv] = plain(left)
    found = got(conversations.op12_conversation_repair(spark, str(tmp_path)))
    assert found == want
    assert any(x[6] == "" and x[5] == 0 for x in found.values())


def test_empty(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_moves_know_every_kind():
    kinds = {r["kind"] for r in conversations.moves().to_pylist()}
    assert kinds == {i + f for i in "suax" for f in "dtc"}
    least = {(r["kind"], r["origin"], r["state"]): (r["cost"], r["audit"]) for r in conversations.moves().to_pylist()}
    assert least["uc", 2, 2] == (2, "JK") and least["ac", 0, 2] == (2, "R") and least["sd", 0, 0] == (3, "D")
