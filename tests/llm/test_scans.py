"""Secret scans, license scans and quality rules against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from tabulant.llm import licenses, quality_rules, secrets
from tests.llm import cases

W = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(texts):
    return [(k, t, "en", "s", 0, 7, "x", 1, "k", 5, 9) for k, t in enumerate(texts)]


def secret_texts():
    r = random.Random(5)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (23, 24, 40, 64)]
    b64 = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)) for n in (44, 88)]
    return [
        None, "", "password = hunter22", "Token: short", 'API_KEY="abc/def+12=" passwd:xxxxxx', "token:token:abcdefgh", "🙂é secret = 🙂 secret=abcdefg", "AKIA" + "A" * 15, "AKIA" + "Z9" * 8 + "q",
        *[f"x {h} y" for h in hexes], *[f"key {b}== end" for b in b64], f"token = \"{hexes[2]}\" and {b64[0]}", "aaaaaaaaaaaaaaaaaaaaaaaaA1 AAAAAAAAAAAAAAAAAAAAAAAAa1", "abcdefghijklmnopqrstuvwxyz0123456789AB",
        "AKIAAKIA" + "B" * 16, "tokentoken=abcdef" * 3, "api-key=abcdefgh apikey=abcdefgh", *["plain words only"] * 3, "x" * 50_000 + " password=longlonglong",
    ]


def brute_spans(text):
    text, out = text or "", []
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for k, (rx, least, g) in enumerate(((assign, 6, 1), (re.compile("AKIA[A-Z0-9]+"), 20, 0), (re.compile("[0-9a-f]+"), 24, 0))):
        out += [(m.start(), k, m.end()) for m in rx.finditer(text) if len(m[g]) >= least]
    return sorted(out)


def tail(z):
    return 1 / (1 + math.exp(min(0.07056 * z**3 + 1.5976 * z, 690)))


def brute_p(token, alphabet):
    s, size = [alphabet.index(c) for c in token.rstrip("=") if c in alphabet], len(alphabet)
    n = len(s)
    chi = sum(s.count(x) ** 2 for x in set(s)) * size / n - n
    z1 = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = [2 * x >= size for x in s]
    a, b = sum(high), n - sum(high)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z2 = abs(1 + sum(x != y for x, y in zip(high, high[1:])) - mean) / math.sqrt(var) if var > 0 else 9.0
    m = sum(s) / n
    spread = sum(x * x for x in s) / n - m * m
    z3 = abs(sum((x - m) * (y - m) for x, y in zip(s, s[1:])) / (n * spread) + 1 / n) * math.sqrt(n) if spread > 0 else 9.0
    words = max(0.055, 1.75 / size)
    equal = sum(x == y for i, x in enumerate(s) for j, y in enumerate(s) if i != j)
    sd = math.sqrt(2 * n * (n - 1) * (words + 2 * (n - 2) * 1.25 * words**2 - (2 * n - 3) * words**2))
    return min(1.0, 3 * min(tail(z1), 2 * tail(z2), 2 * tail(z3))), min(1.0, tail((n * (n - 1) * words - equal) / sd))


def brute_tokens(text):
    out = []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,6}", text or ""):
        for e, (_, rx, alphabet) in enumerate(secrets.ENCODINGS):
            if re.search(rx.replace(r"\z", r"\Z"), m[0]):
                n = len(m[0].rstrip("="))
                stratum = max([k for k, low in enumerate(secrets.STRATA) if n >= low], default=0)
                out.append((m.start(), m.end(), e, stratum, *(min(math.floor(-10 * math.log10(p) + 1e-9), 300) for p in brute_p(m[0], alphabet))))
                break
    return out


def test_secret_scan_against_brute_force(spark):
    texts = secret_texts() + [r[1] for r in cases.documents()]
    counts = {}
    for t in texts:
        for _, _, e, s, *bins in brute_tokens(t):
            for c, b in zip(counts.setdefault((e, s), ({}, {})), bins):
                c[b] = c.get(b, 0) + 1
    limits = {k: (secrets.bh_limit(one, secrets.Q), secrets.bh_limit(two, secrets.FALSE)) for k, (one, two) in counts.items()}
    got = {r["doc_id"]: r for r in secrets.secret_scan(cases.frame(spark, rows_of(texts))).collect()}
    assert len(got) == len(texts)
    names = secrets.KINDS
    for k, t in enumerate(texts):
        base = brute_spans(t)
        more = [(a, 3, b) for a, b, e, s, p, f in brute_tokens(t) if p < limits[e, s][0] and f >= limits[e, s][1] and not any(x < b and a < y for x, _, y in base)]
        text = lambda spans: ",".join(f"{names[i]}:{a}:{b}" for a, i, b in spans)
        r = got[k]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[1] == i for s in base) for i in range(3)), t
        assert r["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest(), t
        assert r["spans"] == text(sorted(base + more)), t
    assert sum(r["n_random"] for r in got.values()) >= 2


def test_word_like_tokens_are_not_reported(spark):
    r = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "release notes under licence server address module component settings message interface internal".split()
    like = ["".join(r.choice(words).title() for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)) for _ in range(300)]
    secret = ["".join(r.choice(letters) for _ in range(48)) for _ in range(100)]
    glued = ["AUTH=" + secret[0], "?sig=" + secret[1], "".join(r.choice(letters[:26] + letters[-10:]) for _ in range(64)), "/path_x/" + secret[2] + "+" + secret[3]]
    got = {x["doc_id"]: x["n_random"] for x in secrets.secret_scan(cases.frame(spark, rows_of(like + secret + glued))).collect()}
    false, found = sum(got[k] for k in range(300)), sum(got[k] for k in range(300, 400))
    assert found >= 95 and false <= 0.1 * found
    assert [got[k] for k in range(400, 404)] == [1, 1, 1, 1]


def test_places_of_very_many_matches(spark):
    text = "é" + "".join(f"{'0123456789abcdef' * 2} {'x' * (k % 5)}|" for k in range(1500))
    got = secrets.secret_scan(cases.frame(spark, rows_of([text]))).first()
    base = brute_spans(text)
    assert got["n_hex"] == 1500 and got["base_sha256"] == hashlib.sha256(",".join(f"hex:{a}:{b}" for a, _, b in base).encode()).hexdigest()


def test_false_discovery_limit():
    assert secrets.bh_limit({0: 50, 100: 50}, 0.01) == 100
    assert secrets.bh_limit({0: 50, 5: 50}, 0.01) == 301
    # one small p-value among a few is let go, among very many it isn't
    assert secrets.bh_limit({0: 9, 40: 1}, 0.01) == 40
    assert secrets.bh_limit({0: 999, 40: 1}, 0.01) == 301


def test_secret_scan_of_nothing(spark):
    assert secrets.secret_scan(cases.frame(spark, [])).count() == 0


def test_license_scan(spark):
    mit = licenses.TEMPLATES[7][1]
    texts = [None, "", "prose\nReleased under the MIT License.", mit, "a\n\n" + mit.replace(" copies", "\ncopies") + "\n\nb", "released UNDER the mit licence", "Licensed under CC BY-NC 4.0.", "x" * 100_000]
    got = {r["doc_id"]: r for r in licenses.license_scan(cases.frame(spark, rows_of(texts))).collect()}
    assert [got[k]["license"] for k in range(len(texts))] == [None, None, "MIT", "MIT", "MIT", None, "CC-BY-NC-4.0", None]
    assert got[2]["dice"] == 1.0 and got[0]["licenses"] == "" and got[0]["n_matches"] == 0
    assert licenses.license_scan(cases.frame(spark, [])).count() == 0


def test_licenses_inside_longer_text(spark):
    mit = licenses.TEMPLATES[7][1]
    inline = "Foo 1.2 is a small tool for x. Released under the MIT License. See the site for more."
    texts = [inline, "int a;\n" + mit.replace("limitation", "limitation\n *") + "\nint b;", "see below: licensed\nunder the mozilla public\nlicense, version 2.0. bye", "the mit license plate " * 3, "Released under the MIT License. " * 1000, "\n\n\n"]
    got = {r["doc_id"]: r for r in licenses.license_scan(cases.frame(spark, rows_of(texts))).collect()}
    assert [got[k]["license"] for k in range(6)] == ["MIT", "MIT", "MPL-2.0", None, "MIT", None]
    assert got[0]["dice"] == 1.0 and got[2]["dice"] == 1.0


def test_license_scan_against_its_sql(spark):
    import duckdb
    import pandas as pd

    r = random.Random(4)
    pieces = [t for _, t in licenses.TEMPLATES] + ["Released under", "the mit", "mit license", "\n", "\n\n", " \n\n\n ", "prose of no use", "é", "by 4", "a"]
    texts = [None, "", "\n", *["".join(r.choice(pieces) + r.choice([" ", "\n", ". ", "\n\n"]) for _ in range(r.randint(1, 8))) for _ in range(150)]]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    want = duckdb.sql(licenses.license_sql()).df()
    got = licenses.license_scan(cases.frame(spark, rows_of(texts))).toPandas()
    key = lambda d: sorted((int(x.doc_id), None if pd.isna(x.license) else x.license, None if pd.isna(x.dice) else round(x.dice, 12), x.licenses, int(x.n_matches)) for x in d.itertuples())
    assert key(got) == key(want)


@pytest.mark.parametrize("m", [2, 5, 30, 100])
def test_size_bounds_lose_no_match(m):
    low, high = licenses.bounds(m, 0.85)
    for n in range(1, 4 * m):
        best = 2 * min(n, m) / (n + m)
        assert (low <= n <= high) == (best >= 0.85 - 1e-12)


def brute_counts(text):
    text = text or ""
    words = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(hit) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_quality_counts_against_brute_force(spark):
    rows = cases.documents() + rows_of(["a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z", "s# $t *|<>&%", "a b c d e a b c d e", "x y " * 40, "\n\na\n a\na\n\n"])
    got = sorted((str(r["doc_id"]), tuple(r)[1:7]) for r in quality_rules.quality_rules(cases.frame(spark, rows)).collect())
    assert got == sorted((str(i), brute_counts(t)) for i, t, *_ in rows)


def test_outliers_go_and_clean_rows_stay(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gammas", "delta", "eps", "zetas", "etas", "theta"]
    rows = [(k, " ".join(r.choice(words) + str(r.randrange(900)) for _ in range(r.randrange(40, 400))), ("en", "de")[k % 2], "s", 0, 7, "x", 1, "k", 5, 9) for k in range(600)]
    odd = [(1000 + k, " ".join(f"#$%&*|<>#$%&*|<>{i * 7 + k}q" for i in range(100)), "en", "s", 0, 7, "x", 1, "k", 5, 9) for k in range(4)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(cases.frame(spark, rows + odd)).collect()}
    assert sum(got[k]["kept"] for k in range(600)) == 600
    assert not any(got[1000 + k]["kept"] for k in range(4))
    kept = quality_rules.drop_low_quality(cases.frame(spark, rows + odd))
    assert {x["doc_id"] for x in kept.collect()} == set(range(600)) and kept.columns == cases.frame(spark, []).columns


def brute_verdicts(rows):
    """Distance of each row that passes the base rules, by plain arithmetic: {id: distance}."""
    q = quality_rules
    floors, cut = np.array(q.FLOORS) ** 2, q.SUPPORT / q.chi2_cdf(q.chi2_quantile(q.SUPPORT, q.P), q.P + 2)
    found = {}
    for i, text, lang, source, *_ in rows:
        n, chars, symbols, dup, repeat, failed = brute_counts(text)
        lines = sum(bool(W.search(x)) for x in (text or "").split("\n"))
        if not failed:
            found[i] = (lang, source, [math.log1p(n), math.log1p(chars / n), math.sqrt(symbols / max(chars, 1)), math.sqrt(dup / max(lines, 1)), math.sqrt(repeat / n)])

    def quartiles(x):
        at = [np.sort(x, axis=0)[math.ceil(p * len(x)) - 1] for p in (0.25, 0.5, 0.75)]
        return at[1], np.maximum(((at[2] - at[0]) / 1.349) ** 2, floors)

    def regular(n, mean, cov, prior):
        mean = (n * mean + q.PRIOR_ROWS * prior[0]) / (n + q.PRIOR_ROWS)
        cov = (n * cov + q.PRIOR_ROWS * np.diag(prior[1])) / (n + q.PRIOR_ROWS)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), floors))
        return np.linalg.slogdet(cov)[1], mean, cov

    def d2(x, est):
        y = x - est[1]
        return np.einsum("ij,jk,ik->i", y, np.linalg.inv(est[2]), y)

    def step(x, est, prior):
        bins = np.floor(np.log(d2(x, est) + 1e-6) * q._BINS_PER_E)
        near = x[np.array([(bins < b).sum() < q.SUPPORT * len(x) for b in bins])]
        return regular(len(near), near.mean(axis=0), cut * np.cov(near.T, bias=True), prior)

    every = np.array([x for *_, x in found.values()])
    whole, out = quartiles(every), {}
    for lang, source in {v[:2] for v in found.values()}:
        x = np.array([v[2] for v in found.values() if v[0] == lang])
        prior = [(len(x) * own + q.PRIOR_ROWS * of_all) / (len(x) + q.PRIOR_ROWS) for own, of_all in zip(quartiles(x), whole)]
        ids = [i for i, v in found.items() if v[:2] == (lang, source)]
        x = np.array([found[i][2] for i in ids])
        middle, scale = quartiles(x)
        best = None
        for start in (regular(len(x), middle, np.diag(scale), prior), regular(len(x), x.mean(axis=0), np.cov(x.T, bias=True), prior)):
            est = step(x, start, prior)
            while (new := step(x, est, prior))[0] < est[0] - q.GAIN:
                est = new
            best = est if best is None or est[0] < best[0] else best
        out |= dict(zip(ids, np.sqrt(d2(x, best))))
    return out


def test_verdicts_against_brute_force(spark, monkeypatch):
    """Small groups of several languages and sources; the two starts that need no hash."""
    monkeypatch.setattr(quality_rules, "STARTS", 3)  # the third is then the second again
    r = random.Random(11)
    rows = []
    for k in range(500):
        words = [f"w{r.randrange(10 ** (1 + k % 5))}" for _ in range(r.randrange(20, 200))]
        text = " ".join(words) + "\n" * (k % 3) + ("# $ " * r.randrange(0, 40) if k % 11 == 0 else "")
        rows.append((k, text, ("en", "de", None)[k % 3], f"s{(k * k) % 7}", 0, 7, "x", 1, "k", 5, 9))
    rows += [(900, " ".join(f"#$%&*|<>#$%&*|<>{i}q" for i in range(100)), "en", "s0", 0, 7, "x", 1, "k", 5, 9)]
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(cases.frame(spark, rows)).collect()}
    want = brute_verdicts(rows)
    limit = math.sqrt(quality_rules.chi2_quantile(1 - quality_rules.TAIL, quality_rules.P))
    assert 300 < len(want) and any(d > limit for d in want.values())
    for i, x in got.items():
        assert x["kept"] == (i in want and want[i] <= limit), i
        assert i not in want or abs(x["distance"] - want[i]) < 1e-6 * max(1, want[i]), i


def test_quality_of_nothing(spark):
    assert quality_rules.quality_rules(cases.frame(spark, [])).count() == 0
    assert quality_rules.drop_low_quality(cases.frame(spark, rows_of([None, "", "few"]))).count() == 0


def test_chi_squared():
    assert abs(quality_rules.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(quality_rules.chi2_cdf(5.385, 4) - 0.75) < 1e-3
