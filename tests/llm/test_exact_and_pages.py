"""Exact dedup, WARC round trip and URL filters against plain Python."""

import base64
import gzip
import hashlib
import re
from collections import defaultdict

from tabulant.llm import warc
from tabulant.llm.exact_dedup import drop_exact_copies, exact_dedup
from tabulant.llm.url_filters import LISTED, PATTERNS, Rule, listed, url_filter
from tests.llm import cases


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_dedup_against_brute_force(spark):
    rows = cases.documents()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    want = []
    for i, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(cases.frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_copies_go_once(spark):
    rows = cases.documents()
    got = drop_exact_copies(cases.frame(spark)).collect()
    assert got[0].asDict().keys() == cases.frame(spark).limit(1).collect()[0].asDict().keys()
    assert len(got) == len({norm(t) for _, t, *_ in rows})
    assert len({norm(r["text"]) for r in got}) == len(got)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(cases.frame(spark, [])).count() == 0
    assert drop_exact_copies(cases.frame(spark, [])).count() == 0


PAGES = [
    (1, "http://A.Example.com/en/77?x", "<p>é</p>"), (2, "https://example.net/de/81", "<p>é</p>"), (3, None, None), (4, "no scheme", ""), (5, "ftp://x.org/es/", "a\r\n\r\nb"),
    (6, "http://h?x/y", "<p>é</p>"), (7, "http://spam-farm.example.org/en/\r\nEvil: 1", "q" * 300_000), (8, "http://com/en/z", "z"), (8, "http://com/en/z", "z"), (None, "http://b.example.com/en/8#f", "z"),
    (9, "http://notcom/en/", "only"), (10, "http://x.com/EN/", None),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, _winner string, kind long")


def brute_warc(rows):
    by = defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    out = []
    for i, _, h in rows:
        data, ids = (h or "").encode(), [x for x in by[h or ""] if x is not None]
        win = max(ids) if ids else None
        again = win is not None and i != win
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", win if again else None))
    return out


def test_warc_round_trip(spark):
    got = [tuple(r)[:5] for r in warc.warc_round_trip(pages(spark), spark).collect()]
    assert sorted(got, key=str) == sorted(brute_warc(PAGES), key=str)
    assert warc.warc_round_trip(pages(spark, []), spark).count() == 0


def test_warc_members_stand_alone(spark, tmp_path):
    raw = warc.write_archives(pages(spark), f"file://{tmp_path}/raw", archive_bytes=1000)
    normal = warc.normalise(raw, f"file://{tmp_path}/members")
    back = warc.read_archives(normal, f"file://{tmp_path}/members", payloads=True).collect()
    payloads = {r["page_id"]: bytes(r["payload"]) for r in back if r["payload"] is not None}
    assert payloads[7] == b"q" * 300_000 and payloads[5] == b"a\r\n\r\nb"
    one = next(r for r in back if r["page_id"] == 5)
    with open(one["archive"], "rb") as f:
        f.seek(one["offset"])
        assert gzip.GzipFile(fileobj=f).read(9) == b"WARC/1.1\r"
    whole = b"".join(gzip.open(r["archive"]).read() for r in normal.collect())
    assert whole.count(b"WARC-Type: ") == len(PAGES) and b"\nEvil: 1" not in whole


def test_inflate_reads_members_and_refuses_cut_files():
    import io

    import pytest

    data = gzip.compress(b"a" * 3_000_000) + gzip.compress(b"b")
    assert b"".join(warc.inflate(io.BytesIO(data))) == b"a" * 3_000_000 + b"b"
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(data[:-9])))


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(r.pattern.replace(r"\z", r"\Z"), host + path) for r in PATTERNS)
    return host, path, None, "block" if bad else "allow"


def test_url_filters_against_brute_force(spark):
    want = [(i, *brute_url(u)) for i, u, _ in PAGES]
    got = [tuple(r)[:5] for r in url_filter(pages(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter(pages(spark, [])).count() == 0


def test_many_rules_are_joined_with_the_same_result(spark):
    more = tuple(listed("block", f"never{k}.example", "/") for k in range(300))
    few = sorted(map(str, url_filter(pages(spark)).collect()))
    assert sorted(map(str, url_filter(pages(spark), rules=LISTED + PATTERNS + more).collect())) == few
    assert isinstance(more[0], Rule)
