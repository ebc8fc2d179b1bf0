"""Splittable CSV against the plain parser, and a folder of good and bad files."""

import random

import pytest
from tabulant.operators import export as X
from tabulant.sources import csv_splits, uploads
from tabulant.sources.grids import decode, parse_csv


def texts(seed, n):
    r = random.Random(seed)
    bits = ["a", "b c", ",", ",", '"', '"', '""', "\n", "\n", "\r", "\r\n", "姓名", "é", "\t", '","', '"x\ny"', "\n\n"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 120))) for _ in range(n)]


def grids(frame):
    out = {}
    for r in frame.orderBy("source_id", "row_idx").collect():
        out.setdefault(r["source_id"].rsplit("/", 1)[1], []).append((r["row_idx"], r["cells"]))
    return out


@pytest.mark.parametrize("split", [7, 40, 128 << 20])
def test_split_files_against_the_plain_parser(spark, tmp_path, split):
    data = {f"f{k:03}.csv": t.encode() for k, t in enumerate(texts(split, 60))}
    data |= {"bom.csv": "﻿姓名,金额\n王辉,\"1\n2".encode() + b"\n", "bomless.csv": b'a,"b\n', "open.csv": b'x\n"never closed\n' + b"line,1\n" * 30, "gbk.csv": "姓名,开户银行\n王辉,\"中国\n银行\"\n".encode("gb18030") * 9}
    data |= {"long.csv": b'h1,h2\n"' + b"word word, word\n" * 40 + b'",end\nlast,row', "empty.csv": b"", "blank.csv": b"\n\n,\n", "bad.csv": b"a,\xff\xfe\xff\xfe\nb,1\n"}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        frame = csv_splits.read_csv(spark, str(tmp_path))
        got = grids(frame)
        tasks = frame.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {name: rows for name, content in data.items() if (rows := parse_csv(decode(content)))}
    assert {k: [c for _, c in v] for k, v in got.items()} == want
    for rows in got.values():
        assert len({i for i, _ in rows}) == len(rows)
        if split > 1000:
            assert [i for i, _ in rows] == list(range(len(rows)))
    assert split > 1000 or tasks > 100  # many tasks read them


def test_tabs_and_other_layouts(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('a\t"b\tc"\n"d,e"\tf\n', encoding="utf-8")
    assert grids(csv_splits.read_csv(spark, str(tmp_path), "\t")) == {"a.tsv": [(0, ["a", "b\tc"]), (1, ["d,e", "f"])]}
    layout = csv_splits.Layout([])
    with pytest.raises(RuntimeError, match="run the query again"):
        list(csv_splits._parser(type("B", (), {"value": layout}), ",", False)(csv_splits_batch()))


def csv_splits_batch():
    import pyarrow as pa

    yield pa.RecordBatch.from_pydict({"path": ["p"], "start": [5], "size": [9], "line": [b"x"]})


def test_bad_files_among_good_ones(spark, tmp_path):
    folder = tmp_path / "in put"
    folder.mkdir()
    book = X.xlsx_bytes([("表一", [["姓名", "金额"], ["王辉", 5]]), ("空", [])])
    (folder / "good 1+1.csv").write_text("姓名,身份证号码,金额\n王辉,110101199001011234,5\n合计,,5\n", encoding="utf-8")
    (folder / "book.XLSX").write_bytes(book)
    (folder / "broken.xlsx").write_bytes(book[: len(book) // 2])
    (folder / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0 binary")
    (folder / "page.xls").write_text("<html><table><tr><td>a</td><td>b</td></tr></table></html>", encoding="utf-8")
    (folder / "scan.pdf").write_bytes(b"%PDF-1.4")
    (folder / "note.doc").write_bytes(b"x")
    (folder / "none").write_bytes(b"x")
    (folder / "nothing.csv").write_bytes(b"")
    entries = uploads.read_uploads(spark, str(folder))
    good, bad = uploads.write_uploads(entries, str(tmp_path / "out"))
    found = {k.rsplit("#", 1)[-1].replace("%20", " "): [c for _, c in v] for k, v in grids(good).items()}
    assert found == {"good 1+1.csv": [["姓名", "身份证号码", "金额"], ["王辉", "110101199001011234", "5"], ["合计", "", "5"]], "表一": [["姓名", "金额"], ["王辉", "5"]], "page.xls": [["a", "b"]]}
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}
    assert set(reasons) == {"broken.xlsx", "old.xls", "scan.pdf", "note.doc", "none"}
    assert reasons["note.doc"] == reasons["none"] == reasons["scan.pdf"] == uploads.UNSUPPORTED and reasons["broken.xlsx"].startswith("BadZipFile") and "zipped" in reasons["old.xls"]
    records = {(r["file_name"].replace("%20", " "), r["sheet"]): (r["n_rows"], r["header_row"], r["data_rows"]) for r in uploads.source_records(entries).collect()}
    assert records[("good 1+1.csv", None)] == (3, 0, 1) and records[("book.XLSX", "空")] == (0, None, 0)
    assert not any(name == "nothing.csv" for name, _ in records) and "nothing.csv" not in reasons  # Spark's scans pass over files without a byte
    own = uploads.read_uploads(spark, str(folder), {"pdf": lambda data: [("page 1", [["x"]])]})
    assert own.where("kind = 'pdf'").first()["cells"] == ["x"] and uploads.failures_of(own).count() == 4
