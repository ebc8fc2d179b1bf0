"""Conversation repair against exhaustive search."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from tabulant.llm import conversation_repair as cr
from tabulant.llm.queries import ORACLE_SQL, op13_conversation_repair

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, repaired rows): every order of edits, cheapest and ASCII-least first."""
    wrong, best = faults(rows), None
    most = 4 * len(rows)  # all deleted

    def go(k, roles, cost, audit, out):
        nonlocal best
        if cost > most or not any(SHAPE.match(roles + x) for x in ("", "a", "ua")):
            return
        if k == len(rows) and SHAPE.match(roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        for role in ("user", "assistant"):
            go(k, roles + role[0], cost + 3, audit + "I", out + [(role, "")])
        if k < len(rows):
            role, text = rows[k]
            go(k + 1, roles, cost + 4, audit + "D", out)
            if wrong[k] not in ("blank", "duplicate"):
                more = 3 if wrong[k] else 0
                if role[:1] in ("s", "u", "a"):
                    go(k + 1, roles + role[0], cost + more, audit + "K", out + [(role, text)])
                for other in ("user", "assistant"):
                    go(k + 1, roles + other[0], cost + more + 3, audit + "R", out + [(other, text)])

    go(0, "", 0, "", [])
    return best


def dynamic(rows):
    """The same by states that carry whole audits; for longer conversations."""
    wrong = faults(rows)
    best = {"": (0, "", ())}  # by what may follow: "" nothing yet, s, u, a

    def put(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for state, (cost, audit, done) in list(out.items()):
                role = "assistant" if state == "u" else "user"
                put(out, role[0], (cost + 3, audit + "I", (*done, (role, ""))))
        return out

    for (role, text), fault in zip(rows, wrong):
        now = {}
        for state, (cost, audit, done) in inserted(best).items():
            put(now, state, (cost + 4, audit + "D", done))
            if fault not in ("blank", "duplicate"):
                more, turn = 3 if fault else 0, "assistant" if state == "u" else "user"
                put(now, turn[0], (cost + more + 3, audit + "R", (*done, (turn, text))))
                if role[:1] == turn[0] or (role[:1] == "s" and state == ""):
                    put(now, role[0], (cost + more, audit + "K", (*done, (role, text))))
        best = now
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def repaired(rows):
    repair, out = cr.Repair(), []
    for (role, text), fault in zip(rows, faults(rows)):
        out += repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    out += repair.end()
    return repair.cost, "".join(e[0] for e in out), [e[1:] for e in out if e[0] != "D"]


def conversation(r, n):
    roles = ["user", "assistant", "system", "user", "assistant", "u", "", "tool", "Assistant"]
    return [(r.choice(roles[: r.choice((2, 3, 9))]), r.choice(("ok.", "no", "", " ", f"t{r.randrange(9)}.", f"t{r.randrange(9)}", "?", "a. "))) for _ in range(n)]


def test_small_ones_against_exhaustive_search():
    r = random.Random(1)
    for _ in range(250):
        rows = conversation(r, r.randrange(0, 5))
        cost, audit, out = repaired(rows)
        assert (cost, audit, out) == exhaustive(rows), rows


def test_longer_ones_against_whole_paths():
    r = random.Random(2)
    for _ in range(400):
        rows = conversation(r, r.randrange(4, 40))
        cost, audit, done = dynamic(rows)
        assert repaired(rows) == (cost, audit, list(done)), rows
    for rows in ([("user", f"{k}.") for k in range(301)], [("assistant", f"{k}") for k in range(200)], [("system", f"{k}.") for k in range(100)], [("x", "")] * 50):
        cost, audit, done = dynamic(rows)
        assert repaired(rows) == (cost, audit, list(done))


def test_decided_rows_are_forgotten():
    r = random.Random(3)
    repair, most, out = cr.Repair(), 0, 0
    for k in range(20_000):
        role = ("user", "assistant")[k % 2] if r.random() > 0.1 else r.choice(("user", "assistant", "system"))
        out += len(list(repair.row(role, f"{k}.", r.random() < 0.05, r.random() < 0.2)))
        most = max(most, repair.undecided())
    assert most < 400 and out > 19_000


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            row = (conv, turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
            out += [row] * (2 if hit == 3 else 1)
    return out


def brute(rows):
    by = defaultdict(list, {c: [] for c, *_ in rows})
    for c, *rest in plain_damage(rows):
        by[c].append(rest)
    out = []
    for c, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [t for t, _, _ in own if t is not None]
        said = [x[1:] for x in own]
        cost, audit, done = dynamic(said)
        counts = [faults(map(tuple, said)).count(f) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in done).encode()).hexdigest()))
    return out


def rows(seed=4):
    r = random.Random(seed)
    out = [(c, t, *x) for c in range(120) for t, x in enumerate(conversation(r, r.randrange(1, 12)))]
    out += [(c, r.choice((None, 1, 1, 2, 900)), *x) for c in range(200, 230) for x in conversation(r, 9)]  # nulls, ties and gaps
    out += [(None, t, *x) for t, x in enumerate(conversation(r, 20))] + [(300 + k, 0, None, None) for k in range(60)] + [(400, None, None, "x."), (400, None, "user", None)]
    return out + [(500, t, ("user", "assistant")[t % 2], f"{t} {'long ' * (30_000 if t == 3 else 1)}.") for t in range(700)] + [(501, t, "user", "again") for t in range(300)]


def frame(spark, data):
    return spark.createDataFrame([(*x, 1, "x") for x in data], "conv_id long, turn long, role string, text string, gone int, _conv string").repartition(7)


def test_query_against_brute_force(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows()), key=str)


def test_equal_rows_of_one_turn_follow_their_first(spark):
    data = [(c, 5, "user", f"{c}.") for c in range(300) for _ in range(6)]
    got = cr.repair_report(frame(spark, data)).select("audit").distinct().collect()
    assert [r["audit"] for r in got] == ["KDDDDDI"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    if not os.path.isdir(data):
        pytest.skip("the test tables are not there")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op13_conversation_repair"]).fetchall()) == sorted(map(tuple, op13_conversation_repair(spark, data).collect()))


def test_turns_give_the_digest(spark):
    data = [x for x in rows() if x[0] != 501]
    shown = frame(spark, data)
    turns = defaultdict(list)
    for c, place, edit, role, text in cr.repaired_turns(shown).orderBy("conv_id", "place").collect():
        assert place == len(turns[c])
        turns[c].append((edit, role, text))
    for r in cr.repair_report(shown).collect():
        own = turns[r["conv_id"]]
        assert r["audit"] == "".join(e for e, _, _ in own)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for e, a, b in own if e != "D").encode()).hexdigest()


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_ids_and_nothing(spark, kind):
    none = spark.createDataFrame([], f"conv_id {kind}, turn int, role string, text string")
    assert cr.repair_report(none).count() == 0 and cr.repaired_turns(none).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id int, turn int, role string, text string").withColumn("conv_id", cr.F.col("conv_id").cast(kind))
    got = cr.repair_report(one)
    assert got.schema["conv_id"].dataType.simpleString() == kind and got.first()["audit"] == "KI"
