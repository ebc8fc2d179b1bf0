"""Scalar functions as native column expressions, with the semantics of the browser's strings and numbers.

White space is the browser's (no-break and full-width spaces, byte-order mark);
numbers are parsed from their prefix where the source did so, and are printed
without exponent or trailing zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulant.functions import constants as C

_WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_MONEY_MARKS = r"[¥￥$€£,，\s\x{A0}\x{3000}]"
_FULL = "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
_HALF = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def js_trim(x: Text) -> Column:
    """Trimmed text; null is empty."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), rf"^{_WS}+|{_WS}+\z", "")


def without_space(x: Text) -> Column:
    """the text without any white space."""
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), _WS, "")


def _once(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number_prefix(x: Text) -> Column:
    """The number at the start of a text, or null (T4)."""
    head = F.regexp_extract(js_trim(x), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.regexp_replace(head, r"\.(?=[eE]|\z)", "").try_cast("double")


def strict_number(x: Text) -> Column:
    """The number that the whole text is, hexadecimal integers included, or null (T5)."""

    def read(s: Column) -> Column:
        plain = F.when(F.rlike(s, F.lit(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")), F.regexp_replace(s, r"\.(?=[eE]|\z)", "").try_cast("double"))
        return F.when(F.rlike(s, F.lit(r"^0[xX][0-9a-fA-F]{1,15}\z")), F.conv(F.substring(s, 3, 15), 16, 10).try_cast("double")).otherwise(plain)

    return _once(js_trim(x), read)


def js_round2(x: Column) -> Column:
    """Rounded to cents, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def number_text(x: Column) -> Column:
    """A number with at most two decimals, without exponent or trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("decimal(38,2)").cast("string"), r"0+\z", ""), r"\.\z", "")


def _money(x: Text) -> Column:
    return F.regexp_replace(F.regexp_replace(js_trim(x), _MONEY_MARKS, ""), r"(元|人民币)\z", "")


def sanitize_amount(x: Text) -> Column:
    """F1: money text to a plain number of cents precision; empty where there is none."""
    return F.coalesce(number_text(js_round2(number_prefix(_money(x)))), F.lit(""))


def is_amount_like(x: Text) -> Column:
    """P5: a number between 0 and 1e8 that is no phone, card or id number."""
    s = _money(x)
    n = number_prefix(s)
    other = F.rlike(s, F.lit(r"^[0-9]{11}\z|^[0-9]{16,19}\z|^[0-9]{17}[0-9Xx]\z"))
    return F.coalesce((s != "") & ~other & (n > 0) & (n < 1e8), F.lit(False))


_SPACELESS = ("name", "idCard", "phone", "bankCard")


def clean_value(x: Text, kind: str) -> Column:
    """value of a typed column: no white space, half-width letters and digits, a proper id suffix."""
    v = F.coalesce(_c(x), F.lit(""))
    out = v
    if kind in _SPACELESS:
        out = F.translate(F.regexp_replace(v, rf"{_WS}|[\x{{200B}}\x{{200C}}\x{{200D}}]", ""), _FULL, _HALF)
    if kind == "idCard":
        out = F.regexp_replace(F.translate(out, "ⅩⅹХх", "XXXX"), r"^([0-9]{17})x\z", "$1X")
    return F.when(js_trim(v) == "", F.lit("")).otherwise(out)


def clean_name(x: Text) -> Column:
    """drops notes beside a personal name; organisations and several names in a cell stay."""
    t = js_trim(F.regexp_replace(js_trim(x), rf"([\x{{4e00}}-\x{{9fff}}]){_WS}+(?=[\x{{4e00}}-\x{{9fff}}])", "$1"))
    lead = F.regexp_extract(t, r"^([\x{4e00}-\x{9fff}·・]+)", 1)
    name = F.regexp_replace(lead, r"[·・]+\z", "")
    rest = F.substr(t, F.length(lead) + 1)
    dotted = F.rlike(name, F.lit("[·・]"))
    as_is = (
        (lead == "")
        | (rest == "")
        | ~F.length(name).between(2, 15)
        | F.rlike(rest, F.lit(r"^[、，,／/]"))
        | (~dotted & ((F.length(name) > 6) | F.rlike(name, F.lit(C.ORG_SUFFIX))))
    )
    return F.when(as_is, t).otherwise(name)


_PLAIN_MARKS = rf"[,，￥¥]|{_WS}"


def split_amount(x: Text) -> Column:
    """the amount of a split cell; null for none and for zero."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), _PLAIN_MARKS, "")
    return _once(s, lambda s: F.when(F.rlike(s, F.lit("[0-9]")), _once(strict_number(s), lambda n: F.when(n != 0, n))))


def merge_amount(x: Text) -> Column:
    """an exact decimal, or null."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), _PLAIN_MARKS, "")
    return F.when(F.rlike(s, F.lit(r"^-?[0-9]+(\.[0-9]+)?\z")), s.try_cast("decimal(38,18)"))


def decimals_of(x: Text) -> Column:
    """Digits after the point of an amount that ``merge_amount`` reads, else 0."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), _PLAIN_MARKS, "")
    return F.length(F.regexp_extract(s, r"^-?[0-9]+\.([0-9]+)\z", 1))


def declared_amount(x: Text) -> Column:
    """The declared total of a row: a number with at least one digit, or null."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), _PLAIN_MARKS, "")
    return F.when(F.rlike(s, F.lit("[0-9]")), strict_number(s))


def validation_amount(x: Text) -> Column:
    """amount for validation: empty is 0, no number is null."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), rf"[¥￥,，]|{_WS}", "")
    return F.when(s == "", F.lit(0.0)).otherwise(strict_number(s))


def tolerance(declared: Column) -> Column:
    return F.greatest(F.lit(0.02), F.abs(declared) * 1e-6)


def gender_of_id(x: Text) -> Column:
    """By the 17th digit of an id."""
    s = js_trim(x)
    odd = F.pmod(F.substring(s, 17, 1).try_cast("int"), F.lit(2)) == 1
    return F.when(F.rlike(s, F.lit(r"^[0-9]{17}[0-9Xx]\z")), F.when(odd, F.lit("男")).otherwise(F.lit("女"))).otherwise(F.lit(""))


def id_checksum_valid(x: Text) -> Column:
    """the weighted sum modulo 11 names the last character."""
    s = F.upper(js_trim(x))
    total = sum((F.substring(s, i + 1, 1).try_cast("int") * w for i, w in enumerate(C.ID_WEIGHTS)), F.lit(0))
    check = F.substr(F.lit(C.ID_CHECKS), F.pmod(total, F.lit(11)) + 1, F.lit(1))
    return F.coalesce(F.rlike(s, F.lit(r"^[0-9]{17}[0-9X]\z")) & (check == F.substring(s, 18, 1)), F.lit(False))


def task_parts(x: Text) -> Column:
    """``seq.name(id)`` as a struct; null where the text has another form."""
    s, r = js_trim(x), r"^([0-9]+)\.(.+)\((.+)\)\z"
    got = F.struct(F.regexp_extract(s, r, 1).alias("seq"), js_trim(F.regexp_extract(s, r, 2)).alias("name"), js_trim(F.regexp_extract(s, r, 3)).alias("id"))
    return F.when(F.rlike(s, F.lit(r)), got)


def pinyin_initial(ch: Column) -> Column:
    """the initial of a character by native Chinese collation; empty for what is neither letter nor character."""
    han = F.lit("Z")
    zh = F.collate(ch, "zh")
    ladder = None
    for letter, first in reversed(C.PINYIN_BOUNDARIES):
        here = zh >= F.collate(F.lit(first), "zh")
        ladder = F.when(here, F.lit(letter)) if ladder is None else ladder.when(here, F.lit(letter))
    special = None
    for char, letter in C.PINYIN_SPECIALS.items():
        special = F.when(ch == char, F.lit(letter)) if special is None else special.when(ch == char, F.lit(letter))
    return F.when(F.rlike(ch, F.lit("^[A-Za-z]")), F.upper(ch)).when(F.rlike(ch, F.lit(r"^[\x{4e00}-\x{9fff}]")), F.coalesce(special, ladder, han)).otherwise(F.lit(""))


def batch_short_name(x: Text) -> Column:
    """the last part of a client name, without company words."""
    s = js_trim(x)
    last = js_trim(F.element_at(F.filter(F.split(s, "[-－—]"), lambda p: p != ""), -1))
    bare = F.regexp_replace(last, "有限公司|有限责任公司|公司|集团", "")
    return F.when(s == "", F.lit("")).when(bare == "", last).otherwise(bare)


def batch_number(x: Text, run_date: Column) -> Column:
    """date, initials and -A."""
    letters = F.array_join(F.transform(F.split(batch_short_name(x), ""), pinyin_initial), "")
    return F.concat(F.date_format(run_date, "yyyyMMdd"), F.when(letters == "", F.lit("UNKNOWN")).otherwise(letters), F.lit("-A"))


def file_name_part(x: Text) -> Column:
    """safe for a file name, at most 60 characters."""
    s = F.regexp_replace(F.coalesce(_c(x), F.lit("")), r'[\\/:*?"<>|]', " ")
    return F.substring(js_trim(F.regexp_replace(s, rf"{_WS}+", " ")), 1, 60)


def sheet_text(x: Text) -> Column:
    """Zero-width characters gone, spaces collapsed; inner spaces of a number of ten digits or more dropped."""
    s = js_trim(F.regexp_replace(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[\x{200B}-\x{200D}]", ""), rf"{_WS}+", " "))
    bare = F.replace(s, F.lit(" "), F.lit(""))
    return F.when(F.rlike(bare, F.lit(r"^[0-9]{10,}\z")), bare).otherwise(s)


def textual_difference(a: Column, b: Column) -> Column:
    """A5: whether two values differ in more than digits."""
    strip = lambda v: F.regexp_replace(v, rf"[,，.。]|{_WS}", "")
    digits = lambda v: F.rlike(strip(v), F.lit(r"^-?[0-9]*\z"))
    return ~(digits(a) & digits(b))
