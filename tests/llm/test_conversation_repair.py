import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidyloom.llm.conversation_repair import Parser, damaged, repair_conversations, repaired_turns
from tidyloom.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, dropped boolean, cost int, part string"
SOLID = re.compile("[^\x20\x09-\x0d]")
GRAMMAR = re.compile("(s?(ua)+)?")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def shortest(rows, marks):
    """Cheapest (cost, audit, turns) by going through the sequences of roles: s or none, then u, a, u, a, ..."""
    best = {("", 0): (0, "", [])}  # how a role sequence ends and whether it is begun -> way

    def after(end, role):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[end].find(role) >= 0

    def inserts(best):
        for _ in range(3):
            for (end, _), (cost, audit, turns) in list(best.items()):
                for role, name in (("u", "user"), ("a", "assistant")):
                    if after(end, role):
                        keep(best, role, cost + 2, audit + "I", [*turns, (name, "")])

    def keep(best, end, cost, audit, turns):
        if (end, 0) not in best or (cost, audit) < best[end, 0][:2]:
            best[end, 0] = cost, audit, turns

    for (role, text), mark in zip(rows, marks):
        inserts(best)
        new = {}
        for (end, _), (cost, audit, turns) in best.items():
            keep(new, end, cost + 3, audit + "D", turns)
            if mark in ("b", "d"):
                continue
            more = mark == "t"
            if role[:1] in ("s", "u", "a") and after(end, role[:1]):
                keep(new, role[:1], cost + more, audit + "K", [*turns, (role, text)])
            for first, name in (("u", "user"), ("a", "assistant")):
                if after(end, first):
                    keep(new, first, cost + 2 + more, audit + "R", [*turns, (name, text)])
        best = new
    inserts(best)
    return min(best[e, 0] for e in ("", "a") if (e, 0) in best)


def every_way(rows, marks):
    """All edits with up to two insertions in a gap."""
    gaps = ["", "u", "a", "ua", "au", "uu", "aa"]
    best = None
    edits = [["D"] if m in ("b", "d") else ["D", "K", "Ru", "Ra"] for m in marks]
    for way in itertools.product(*edits):
        for holes in itertools.product(gaps, repeat=len(rows) + 1):
            roles, cost, audit, turns = "", 0, "", []
            for i, hole in enumerate(holes):
                for h in hole:
                    roles, cost, audit = roles + h, cost + 2, audit + "I"
                    turns.append(("user" if h == "u" else "assistant", ""))
                if i == len(rows):
                    break
                role, text = rows[i]
                edit = way[i]
                audit += edit[0]
                if edit == "D":
                    cost += 3
                    continue
                name = role if edit == "K" else "user" if edit == "Ru" else "assistant"
                cost += (2 if edit != "K" else 0) + (marks[i] == "t")
                roles += name[:1] or "?"
                turns.append((name, text))
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, turns
    return best


def parsed(rows, marks):
    p = Parser()
    for (role, text), mark in zip(rows, marks):
        p.row(role, text, mark in ("b", "d"), mark == "t")
    return p.result()


def sha(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_all_ways_of_short_conversations():
    roles = ["system", "user", "assistant", "tool"]
    texts = ["Yes.", "No", " ", "Yes."]
    rnd = random.Random(3)
    cases = [[]] + [[(r, t)] for r in roles for t in texts]
    cases += [[(rnd.choice(roles), rnd.choice(texts)) for _ in range(rnd.choice((2, 2, 3)))] for _ in range(60)]
    for rows in cases:
        marks = faults(rows)
        want = every_way(rows, marks)
        assert want == shortest(rows, marks)
        cost, audit, made, digest = parsed(rows, marks)
        assert (cost, audit, made, digest) == (*want[:2], "".join(r[:1] for r, _ in want[2]), sha(want[2])), rows


def test_long_conversations():
    rnd = random.Random(8)
    for n in (50, 400):
        for _ in range(20):
            rows = [(rnd.choice(["system", "user", "assistant", "assistant", "", "unknown"]), rnd.choice(["a.", "b", "", f"{rnd.random()}!"])) for _ in range(n)]
            marks = faults(rows)
            want = shortest(rows, marks)
            assert parsed(rows, marks)[:2] == want[:2] and parsed(rows, marks)[3] == sha(want[2])
    p = Parser()
    for i in range(20_000):
        p.row("assistant" if i % 3 else "user", f"{i}.", False, False)
    cost, audit, made, _ = p.result()
    assert GRAMMAR.fullmatch(made) and len(audit) >= 20_000 and cost > 0
    assert len(p.trail) == 12 * 20_000


def brute(rows):
    """All columns for rows (turn, role, text) of one conversation, by whole lists."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    said = [(r, x) for _, r, x in rows]
    marks = faults(said)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, made = shortest(said, marks)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, marks.count("b"), marks.count("d"), marks.count("t"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(made),
    )


def as_told(row):
    return (row["gaps"], row["blank"], row["duplicate"], row["truncated"], row["illegal"], row["cost"], row["audit"], row["repaired_sha256"])


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 1, "user", "Hi"), (1, 5, "assistant", "Yes.\n "), (1, None, "user", "First?"),
    (2, None, None, None), (2, None, "user", None), (3, 0, "assistant", "x" * 200_000 + "."), (4, 7, "", "\x85"), (4, 7, "User", "a."),
    (None, 1, "user", "of no key."), (None, None, "assistant", "neither!"), (None, 2, "user", "of no key."), (5, -3, "user", "a?"), (5, 3, "assistant", "b."),
    (6, 0, "assistant", "b."), (6, 0, "assistant", "a."), (6, 0, "system", "a."), (7, 0, "user", "gone."),
    *((8, i, "user" if i % 2 else "assistant", f"turn {i % 50}.") for i in range(3000)),
]


def test_odd_rows(spark):
    rows = [(*r, r[0] == 7, 5, "p") for r in ODD]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    done = repair_conversations(df)
    told = {r["conv_id"]: r for r in done.collect()}
    by = defaultdict(list)
    for key, *row in ODD:
        by[key] += [row] if key != 7 else []
    assert set(told) == set(by)
    for key, own in by.items():
        assert as_told(told[key]) == brute(own), key
    assert as_told(told[7]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    turns = defaultdict(list)
    for r in repaired_turns(df, done).collect():
        turns[r["conv_id"]].append((r["place"], r["role"], r["text"], r["edit"]))
    for key, row in told.items():
        own = sorted(turns[key])
        assert [p for p, *_ in own] == list(range(len(own)))
        assert "".join(e for *_, e in own) == row["audit"].replace("D", "")
        assert sha([(r, t) for _, r, t, _ in own]) == row["repaired_sha256"]
        assert GRAMMAR.fullmatch("".join(r[:1] for _, r, _, _ in own))


def test_empty_table(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def by_hand(rows):
    out = defaultdict(list)
    for key, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        own = out[key]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def test_damage_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, False, 1, "p") for r in ODD], SCHEMA)
    got = sorted((r["conv_id"] or 0, str(r["turn"]), r["role"], r["text"]) for r in damaged(df).collect() if not r["dropped"])
    want = sorted((k or 0, str(t), r, x) for k, rows in by_hand(ODD).items() for t, r, x in rows)
    assert got == want


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = by_hand(rows)
    got = {r["conv_id"]: as_told(r) for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    for key in got:
        assert got[key] == brute(want.get(key, [])), key
