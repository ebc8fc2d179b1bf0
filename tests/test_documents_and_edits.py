"""Stored documents, and logs of edits against a plain replay."""

import json
import random

import pytest
from pyspark.sql import functions as F
from tabulant.functions import constants as C
from tabulant.operators import edit_log as L
from tabulant.operators import enrichment as E
from tabulant.operators import reference_document as D

NEW = {
    "shangSheMap": {
        "b9": {"id": "b9", "shortName": "乙", "fullName": "乙公司", "taxId": "T", "feeRate": "6.5%", "signEntity": "佛山", "tasks": [{"name": "a", "content": "x"}]},
        "10": {"id": "10", "shortName": "丙", "feeRate": 8, "extra": [1]}, "9": {"shortName": "丁"}, "a1": {"tasks": []}, "007": {"fullName": "零"},
    },
    "configData": {"taxSources": ["t2", "t1"], "platforms": ["p"], "signEntityMapping": {"z": ["k1", "k2"], "a": []}, "platformTaxSourceMapping": {"w": "t1"}},
    "taskListData": ["2.b(1)", "1.a(2)"], "schemaVersion": 1,
}


def docs(spark):
    old = {"shangSheMap": {"x": {"shortName": "旧"}}}
    rows = [("new", json.dumps(NEW, ensure_ascii=False)), ("old", json.dumps(old)), ("broken", "{"), ("other", '{"a": 1}'), ("null", None), ("text", '"s"'), ("later", json.dumps({**old, "schemaVersion": 9}))]
    return spark.createDataFrame(rows, "doc string, value string")


def test_documents_become_tables(spark):
    loaded = D.load_documents(docs(spark))
    head = {r["doc"]: (r["valid"], r["stored_version"], r["document"]["schemaVersion"]) for r in loaded.collect()}
    assert head == {"new": (True, 1, 1), "old": (True, 0, 1), "broken": (False, None, 1), "other": (False, None, 1), "null": (False, None, 1), "text": (False, None, 1), "later": (True, 9, 9)}
    clients = D.clients_of(loaded).orderBy("doc", "pos").collect()
    assert [r["id"] for r in clients if r["doc"] == "new"] == ["9", "10", "b9", "a1", "007"]  # whole numbers first
    b9 = next(r for r in clients if r["id"] == "b9")
    assert (b9["fee_rate"], b9["tax_id"], b9["tasks"][0]["content"]) == (6.5, "T", "x") and next(r for r in clients if r["id"] == "9")["tasks"] == []
    config = D.config_of(loaded).where("doc = 'new'").orderBy("kind", "pos").collect()
    assert [(r["kind"], r["key"], r["value"]) for r in config] == [("platform", "p", ["p"]), ("platform_tax", "w", ["t1"]), ("sign_entity", "z", ["k1", "k2"]), ("sign_entity", "a", []), ("tax_source", "t2", ["t2"]), ("tax_source", "t1", ["t1"])]
    assert [r["entry"] for r in D.tasks_of(loaded).orderBy("pos").collect()] == NEW["taskListData"]
    assert D.config_of(loaded).where("doc = 'old'").count() == 0
    again = D.load_documents(D.documents_of(D.clients_of(loaded), D.config_of(loaded), D.tasks_of(loaded)))
    for table in (D.clients_of, D.config_of, D.tasks_of):
        want = [r for r in table(loaded).where("doc = 'new'").collect()]
        assert sorted(map(str, table(again).where("doc = 'new'").collect())) == sorted(map(str, want))


def test_migrations_run_in_order(spark):
    chain = (*D.MIGRATIONS, lambda doc: doc.withField("lastUpdated", F.concat(F.coalesce(doc["lastUpdated"], F.lit("")), F.lit("+2"))), lambda doc: doc.withField("lastUpdated", F.concat(doc["lastUpdated"], F.lit("+3"))))
    rows = spark.createDataFrame([(v, json.dumps({"shangSheMap": {}, "schemaVersion": v})) for v in (0, 1, 2, 3)], "doc int, value string")
    got = {r["doc"]: (r["document"]["lastUpdated"], r["document"]["schemaVersion"]) for r in D.load_documents(rows, migrations=chain).collect()}
    assert got == {0: ("+2+3", 3), 1: ("+2+3", 3), 2: (None, 3), 3: (None, 3)}


def test_import_of_a_document(spark):
    loaded = D.load_documents(docs(spark))
    now = [t(loaded.where("doc = 'new'")).drop("doc") for t in (D.clients_of, D.config_of, D.tasks_of)]
    new = spark.createDataFrame([("n", json.dumps({"shangSheMap": {"b9": {"shortName": "换"}, "n1": {}}, "configData": {"platforms": ["q", "p"], "signEntityMapping": {"z": ["k3"]}}, "taskListData": ["5.b(1)", "6.c(1)"]}))], "doc string, value string")
    clients, config, tasks = D.import_document(*now, D.load_documents(new))
    assert {r["id"]: (r["short_name"], r["full_name"]) for r in clients.collect()}["b9"] == ("换", None) and clients.count() == 6
    assert [(r["kind"], r["key"]) for r in config.where("kind = 'platform'").orderBy("pos").collect()] == [("platform", "p"), ("platform", "q")]
    assert config.where("key = 'z'").first()["value"] == ["k3"] and [r["entry"] for r in tasks.orderBy("pos").collect()] == ["5.b(1)", "1.a(2)", "6.c(1)"]
    assert D.import_document(*now, loaded.where("doc = 'broken'"))[0].count() == 5


def plain_lists(lists, log):
    state = {}
    for owner, kind, pos, key, value in sorted(lists, key=lambda r: r[2]):
        state.setdefault((owner, kind), []).append((key, value))
    verdicts = {}
    for owner, kind, seq, op, at, target, key, value in sorted(log, key=lambda r: r[2]):
        pair = any((owner, k) in state for k in ("tax_source", "platform")) and (owner, kind) not in state
        if (owner, kind) not in state:
            state[owner, kind] = [] if pair and kind in ("tax_source", "platform") and any(r[0] == owner and r[1] in ("tax_source", "platform") for r in lists) else list(L.default_entries()[kind])
        entries = state[owner, kind]
        keys = [k for k, _ in entries]
        listed = kind in ("tax_source", "platform", "task")
        key = (key or "").strip()
        value = [key] if listed else [v.strip() for v in value or [] if v.strip()]
        place = (at if at is not None and 0 <= at < len(entries) else -1) if listed else (keys.index(target) if target in keys else -1)
        ok = bool(key and value) if op != "delete" else True
        if op == "add":
            ok = ok and key not in keys
        else:
            ok = ok and place >= 0 and (op == "delete" or key == keys[place] or key not in keys)
        if ok and op == "add":
            entries.append((key, value))
        elif ok and op == "update":
            entries[place] = (key, value)
        elif ok:
            del entries[place]
        verdicts[owner, kind, seq] = ok
    return {(o, k, i, *e) for (o, k), es in state.items() for i, e in enumerate((a, tuple(b)) for a, b in es)}, verdicts


def test_lists_against_a_plain_replay(spark):
    r = random.Random(3)
    lists = [(o, k, i, f"{k}{i}", [f"{k}{i}"] if k in ("tax_source", "platform", "task") else ["v", "w"]) for o, ks in (("a", ("tax_source", "sign_entity")), ("b", ("task", "platform", "platform_tax"))) for k in ks for i in range(4)]
    log = []
    for seq in range(400):
        kind = r.choice(("tax_source", "platform", "task", "sign_entity", "platform_tax"))
        name = lambda: r.choice((f" {kind}{r.randrange(8)} ", "", None, "新", C.PLATFORM_TAX[0][0]))  # noqa: B023, E731
        log.append((r.choice("abc"), kind, seq, r.choice(("add", "add", "update", "delete", "what")), r.choice((None, 0, 1, 3, 50)), f"{kind}{r.randrange(6)}", name(), r.choice((None, [], [" "], ["x ", "y"]))))
    log = [e for e in log if e[3] != "what"]
    after, verdicts = L.replay_lists(spark.createDataFrame(lists, "owner string, kind string, pos long, key string, value array<string>"), spark.createDataFrame(log, "owner string, kind string, seq long, op string, at int, target string, key string, value array<string>").repartition(5))
    want, accepted = plain_lists(lists, log)
    assert {(x["owner"], x["kind"], x["seq"]): x["accepted"] for x in verdicts.collect()} == accepted and 20 < sum(accepted.values()) < len(accepted)
    assert {(x["owner"], x["kind"], x["pos"], x["key"], tuple(x["value"])) for x in after.collect()} == want


def test_selection_against_a_plain_replay(spark):
    r = random.Random(4)
    rows = [(i, r.choice(("f", "g", "", None))) for i in range(60)]
    for n in (0, 1, 5, 40):
        log = [(s, *r.choice([("row", r.randrange(70), None), ("unrow", r.randrange(60), None), ("first", r.randrange(40), None), ("unfirst", 9, None), ("all", None, None), ("clear", None, None), ("file", None, r.choice(("f", "未命名文件", "none")))])) for s in range(n)]
        chosen = set()
        for _, op, k, file in log:
            named = {i for i, f in rows if (f or "未命名文件") == file}
            chosen = {"row": lambda: chosen | {k}, "unrow": lambda: chosen - {k}, "first": lambda: chosen | set(range(k)), "unfirst": lambda: chosen - set(range(k)), "all": lambda: {i for i, _ in rows}, "clear": set, "file": lambda: named or chosen}[op]()  # noqa: B023
        got = L.replay_selection(spark.createDataFrame(rows, "row_no long, _file string"), spark.createDataFrame(log, "seq long, op string, n long, file string"))
        assert {x["row_no"] for x in got.where("selected").collect()} == chosen & {i for i, _ in rows}


def test_cells_against_a_plain_replay(spark):
    r = random.Random(5)
    clients = spark.createDataFrame([("S1", 0, None, None, None, None, [("保洁服务", "打扫"), ("植保", "")])], "id string, pos long, full_name string, short_name string, tax_id string, sign_entity string, tasks array<struct<name:string,content:string>>")
    tasks = E.tasks_of_clients(clients)
    rows = [(i, "S1", "P", "T", "K", "W", "开车" if i % 2 else "") for i in range(12)]
    values = {"platform": ["294.湖南清源", "nowhere", "", None], "tax": ["X", ""], "task": ["1.保洁服务(S1)", "2.植保(S1)", "9.提供园艺工作(Z)", ""]}
    taxes, works = {"294.湖南清源": "0001.湖南"}, {"1.保洁服务(S1)": "保洁", "2.植保(S1)": "植保", "9.提供园艺工作(Z)": "园艺"}
    for n in (0, 3, 60):
        log = [(s, r.choice((None, *range(13))), f, r.choice(values[f])) for s, f in ((s, r.choice(tuple(values))) for s in range(n))]
        state = {i: [p, t, k, w] for i, _, p, t, k, w, _ in rows}
        for _, row, field, value in log:
            value = value or ""
            if field == "platform" and row is None and not value:
                continue
            for i in [row] if row is not None else list(state):
                if i not in state:
                    continue
                if field == "platform":
                    state[i][0] = value
                    state[i][1] = taxes.get(value) or state[i][1]
                elif field == "tax":
                    state[i][1] = value
                else:
                    state[i][2] = value
                    state[i][3] = ("司机" if i % 2 and works[value] != "保洁" else works[value]) if value else state[i][3]
        frame = spark.createDataFrame(rows, f"row_no long, `{E.CLIENT}` string, `{E.PLATFORM}` string, `{E.TAX}` string, `{E.TASK}` string, `{E.WORK}` string, note string")
        got = L.replay_cells(frame, spark.createDataFrame(log, "seq long, row_no long, field string, value string"), tasks, text=E.RowText(("note",)))
        assert {x["row_no"]: [x[E.PLATFORM], x[E.TAX], x[E.TASK], x[E.WORK]] for x in got.collect()} == state


def test_too_many_selections(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_SELECTIONS", 2)
    rows, log = spark.createDataFrame([(0, "f")], "row_no long, _file string"), spark.createDataFrame([(s, "all", None, None) for s in range(3)], "seq long, op string, n long, file string")
    with pytest.raises(Exception, match="more than 2"):
        L.replay_selection(rows, log).collect()
