"""Secret scans: base patterns, plus a randomness test battery on long tokens.

Base spans (assign, access, hex) come from regular expressions. The battery
looks at every other run of 20 or more token characters (``=`` only ends one): its
encoding is inferred from its characters, and two hypotheses are tested.

That the token is a random string of that encoding:

* chi-squared uniformity over the encoding's alphabet, with the exact variance
  of the statistic for short tokens;
* Wald-Wolfowitz runs above and below the middle of the alphabet;
* serial correlation of neighbouring symbols.

The least of the three p-values, times three, is the token's; tokens for which
Benjamini-Hochberg rejects this hypothesis are let go.

That the token is made of words: equal symbols then meet at least as often as in
written language, and the same chi-squared statistic has the mean and variance of
such a law. A token far flatter than that is a discovery. Benjamini-Hochberg
decides which are, so of the spans reported as ``random`` at most the share
``FALSE`` is expected to be word-like. A token is reported if it is discovered
and not let go.

Both are controlled per encoding and length stratum, over all tokens of the
corpus: short tokens, for which the tests have little power, are reported only if
they stand out among their like, and don't set the level of long ones. P-values
are rounded up to tenths of a decade, so the procedure needs only counts by
(encoding, stratum, hypothesis, decade).

Positions need no UDF: a text split by a pattern and the matches themselves give
all offsets by their lengths. They are summed in blocks, so a text with very many
matches costs little more than in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import let, materialise

_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, least length of what the last column's group matched, group)
BASE = (
    ("assign", _ASSIGN, 6, 2),
    # A run of the whole pattern that is long enough; shorter ones hide no other match.
    ("access", "AKIA[A-Z0-9]{16,}", 20, 0),
    ("hex", "[0-9a-f]{24,}", 24, 0),
)
KINDS = ("assign", "access", "hex", "random")
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,6}"
#: False discovery rates: of tokens let go as not random, and of tokens reported.
Q = 0.01
FALSE = 0.05
#: Word-like tokens: chance that two symbols are equal (written language has 0.06 to 0.08; names in mixed case a little less), at least so many times the alphabet's own; and that three are, in squares of that.
WORD_PAIRS = 0.055
WORD_PAIRS_LEAST = 1.75
WORD_TRIPLES = 1.25
#: Lower ends of the length strata.
STRATA = (20, 28, 40, 64, 128)
#: Encodings in the order they are tried, with the pattern that infers them and the alphabet.
_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+\z", _DIG + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+\z", _DIG + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*\z", _UP + "234567"),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+\z", _DIG + _UP),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+\z", _DIG + _LOW),
    ("base62", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+\z", _DIG + _UP + _LOW),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+={0,2}\z", _UP + _LOW + _DIG + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+={0,2}\z", _UP + _LOW + _DIG + "-_"),
    ("mixed", r"^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z+/_-]+=*\z", _UP + _LOW + _DIG + "+/-_"),
)
_BINS = 300
#: Matches whose places are summed together.
_BLOCK = 256
_HITS = "array<struct<start:bigint,m:string>>"
_SPAN = "array<struct<start:bigint,k:int,end:bigint>>"
_TOKENS = "array<struct<start:bigint,end:bigint,enc:int,stratum:int,bin:int,flat:int>>"


def _matches(text: Column, regex: str) -> Column:
    """Leftmost non-overlapping matches: array of struct(start, m), code points."""

    def in_block(parts: Column, block: Column) -> Column:
        """(length of the block, matches placed from its start)."""
        gap, hit = (lambda i: F.get(parts["gaps"], i)), (lambda i: F.get(parts["hits"], i))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(gap(i))
            return F.struct((start + F.length(hit(i))).cast("bigint").alias("at"), F.array_append(acc["out"], F.struct(start.cast("bigint").alias("start"), hit(i).alias("m"))).cast(_HITS).alias("out"))

        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_HITS).alias("out"))
        return F.aggregate(F.sequence(block * _BLOCK, F.least((block + 1) * _BLOCK, F.size(parts["hits"])) - 1), zero, step)

    def joined(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(blocks, zero, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["out"], lambda h: F.struct((h["start"] + s).alias("start"), h["m"].alias("m"))))).cast(_HITS)

    def placed(parts: Column) -> Column:
        n = F.size(parts["hits"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: in_block(parts, b))
        return F.when(n == 0, F.array().cast(_HITS)).otherwise(let(blocks, joined))

    both = F.struct(F.split(text, regex, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"))
    return F.when(F.rlike(text, F.lit(regex)), let(both, placed)).otherwise(F.array().cast(_HITS))


def _base_spans(text: Column) -> Column:
    def of_kind(k: int, regex: str, least: int, group: int) -> Column:
        hits = _matches(text, regex)
        if group:
            hits = F.filter(hits, lambda h: F.length(F.regexp_extract(h["m"], regex, group)) >= least)
        return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(k).alias("k"), (h["start"] + F.length(h["m"])).cast("bigint").alias("end")))

    found = [of_kind(k, *rest) for k, (_, *rest) in enumerate(BASE)]
    return F.array_sort(F.concat(*found)).cast(_SPAN)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal law, by a logistic form good to 0.00015; falls steadily with z."""
    return 1 / (1 + F.exp(F.least(0.07056 * z * z * z + 1.5976 * z, F.lit(690.0))))


def _p_values(symbols: Column, size: int) -> Column:
    """struct(p, flat) of an array of symbol numbers of an alphabet of ``size``: under "random" and under "made of words"."""
    pairs = max(WORD_PAIRS, WORD_PAIRS_LEAST / size)
    triples = WORD_TRIPLES * pairs * pairs

    def tests(s: Column) -> Column:
        n = F.size(s).cast("double")
        counts = F.transform(F.array_distinct(s), lambda x: F.size(F.filter(s, lambda y: y == x)))
        squares = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c * c)
        chi = squares * size / n - n
        z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)

        high = F.size(F.filter(s, lambda x: 2 * x >= size)).cast("double")
        low = n - high
        turns = F.size(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: (2 * F.get(s, i) >= size) != (2 * F.get(s, i - 1) >= size))) + 1
        mean_runs = 2 * high * low / n + 1
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, F.abs(turns - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(9.0))

        total = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x)
        mean = total / n
        spread = squares_of(s) / n - mean * mean
        lagged = F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda a, i: a + (F.get(s, i) - mean) * (F.get(s, i - 1) - mean))
        z_lag = F.when(spread > 0, F.abs(lagged / (n * spread) + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        least = F.least(_upper_tail(z_chi), 2 * _upper_tail(z_runs), 2 * _upper_tail(z_lag))
        spread_words = F.sqrt(2 * n * (n - 1) * (pairs + 2 * (n - 2) * triples - (2 * n - 3) * pairs * pairs))
        flat = _upper_tail((n * (n - 1) * pairs - (squares - n)) / spread_words)
        return F.struct(F.least(3 * least, F.lit(1.0)).alias("p"), F.least(flat, F.lit(1.0)).alias("flat"))

    def squares_of(s: Column) -> Column:
        return F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x * x)

    return let(symbols, tests)


def _tokens(text: Column) -> Column:
    """Tokens whose encoding can be inferred: struct(start, end, enc, stratum, bin, flat)."""

    def tested(h: Column, enc: int) -> Column:
        alphabet = ENCODINGS[enc][2]
        plain = F.regexp_replace(h["m"], "=+$", "")
        symbols = F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
        symbols = F.filter(symbols, lambda x: x >= 0)
        decade = lambda p: F.least(F.floor(-10 * F.log10(p) + 1e-9), F.lit(_BINS)).cast("int")
        bins = let(_p_values(symbols, len(alphabet)), lambda p: F.struct(decade(p["p"]).alias("bin"), decade(p["flat"]).alias("flat")))
        stratum = F.lit(0)
        for i, low in enumerate(STRATA):
            stratum = F.when(F.length(plain) >= low, F.lit(i)).otherwise(stratum)
        return F.struct(
            h["start"].alias("start"),
            (h["start"] + F.length(h["m"])).cast("bigint").alias("end"),
            F.lit(enc).alias("enc"),
            stratum.alias("stratum"),
            bins["bin"].alias("bin"),
            bins["flat"].alias("flat"),
        )

    def one(h: Column) -> Column:
        out = F.lit(None).cast("struct<start:bigint,end:bigint,enc:int,stratum:int,bin:int,flat:int>")
        for enc in reversed(range(len(ENCODINGS))):
            out = F.when(F.rlike(h["m"], F.lit(ENCODINGS[enc][1])), tested(h, enc)).otherwise(out)
        return out

    return F.filter(F.transform(_matches(text, TOKEN), one), lambda x: x.isNotNull()).cast(_TOKENS)


def _limits(found: DataFrame, q: float, false: float) -> list[tuple[int, int, int, int]]:
    """(encoding, stratum, least bin let go as not random, least ``flat`` discovered), from counts over all tokens."""
    tests = F.array(F.struct(F.lit(0).alias("test"), F.col("t.bin").alias("b")), F.struct(F.lit(1).alias("test"), F.col("t.flat").alias("b")))
    each = found.select(F.explode("_tokens").alias("t")).select("t.enc", "t.stratum", F.explode(tests).alias("x"))
    by: dict[tuple[int, int], tuple[dict[int, int], dict[int, int]]] = {}
    for r in each.groupBy("enc", "stratum", "x.test", "x.b").agg(F.count(F.lit(1)).alias("n")).collect():  # at most encodings * strata * 2 * bins rows
        by.setdefault((r["enc"], r["stratum"]), ({}, {}))[r["test"]][r["b"]] = r["n"]
    return [(enc, stratum, bh_limit(one, q), bh_limit(two, false)) for (enc, stratum), (one, two) in sorted(by.items())]


def bh_limit(counts: dict[int, int], q: float) -> int:
    """Benjamini-Hochberg on p-values rounded up to 10 ** (-bin / 10): the least bin that is rejected."""
    total, seen, limit = sum(counts.values()), 0, _BINS + 1
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if 10 ** (-b / 10) <= q * seen / total:
            limit = b
    return limit


def _text_of(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q, false: float = FALSE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    ``random`` spans are those of the battery that overlap no base span. A null
    text counts as empty; without spans the strings are empty. Repeated rows are
    scanned alike, and each counts in the strata; an empty table gives an empty
    result.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found = materialise(rows.select("doc_id", _base_spans(text).alias("_base"), _tokens(text).alias("_tokens")), "secret-spans")
    limits = _limits(found, q, false)

    def random_spans(base: Column, tokens: Column) -> Column:
        def is_kept(t: Column) -> Column:
            good = F.lit(False)
            for enc, stratum, gone, discovered in limits:
                good = good | ((t["enc"] == enc) & (t["stratum"] == stratum) & (t["bin"] < gone) & (t["flat"] >= discovered))
            return good & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

        return F.transform(F.filter(tokens, is_kept), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("k"), t["end"].alias("end"))).cast(_SPAN)

    count = lambda k: F.size(F.filter(F.col("_base"), lambda s: s["k"] == k)).cast("long")
    more = found.withColumn("_random", random_spans(F.col("_base"), F.col("_tokens")))
    return more.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text_of(F.col("_base")), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat("_base", "_random"))).alias("spans"),
        F.size("_random").cast("long").alias("n_random"),
    )
