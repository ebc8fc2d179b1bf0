"""Numbers of workbook cells as the text that is shown: the common number and date formats."""

from __future__ import annotations

import datetime
import re
from decimal import ROUND_HALF_UP, Decimal

# The built-in formats of a workbook by number.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0", 49: "@",
}
_TOKEN = re.compile(r'"([^"]*)"|\\(.)|_.|\*.|\[[^\]]*\]|(AM/PM|A/P|上午/下午)|(y+|m+|d+|h+|s+)|(.)', re.IGNORECASE | re.DOTALL)
_LITERAL = re.compile(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]')
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def general(text: str) -> str:
    """A stored number without a format: eleven digits at most, no exponent where it can be helped."""
    value = Decimal(text)
    if value and not -5 <= value.adjusted() < 11:
        return re.sub(r"\.?0*E", "E", f"{value:.5E}")
    shown = f"{value.quantize(Decimal(1).scaleb(min(0, max(value.adjusted(), 0) - 9)), ROUND_HALF_UP):f}" if value != value.to_integral_value() else f"{value.to_integral_value():f}"
    return (shown.rstrip("0").rstrip(".") if "." in shown else shown) or "0"


def is_date(code: str) -> bool:
    return bool(re.search(r"[ymdhs]", _LITERAL.sub("", code.split(";")[0]), re.IGNORECASE)) and code.lower() != "general"


def _moment(text: str, year_1904: bool) -> datetime.datetime:
    days = Decimal(text) + (1462 if year_1904 else 0)
    days += 1 if days < 60 else 0  # the sheet's calendar has a 29 February 1900
    seconds = (days * 86_400).quantize(Decimal(1), ROUND_HALF_UP)
    return datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=int(seconds))


def date_text(text: str, code: str, year_1904: bool = False) -> str:
    """A serial day under a date format; minutes are an m after hours or before seconds."""
    t, out = _moment(text, year_1904), []
    parts = list(_TOKEN.finditer(code.split(";")[0]))
    units = [(i, p[4].lower()) for i, p in enumerate(parts) if p[4]]
    half = any(p[3] for p in parts)
    near = {i: (units[k - 1][1][0] if k else "", units[k + 1][1][0] if k + 1 < len(units) else "") for k, (i, _) in enumerate(units)}
    for i, p in enumerate(parts):
        if p[1] is not None or p[2] or p[5]:
            out.append(p[1] if p[1] is not None else p[2] or p[5])
        elif p[3]:
            out.append("PM" if t.hour >= 12 else "AM")
        elif p[4]:
            u = p[4].lower()
            minute = u[0] == "m" and (near[i][0] == "h" or near[i][1] == "s")
            hour = (t.hour % 12 or 12) if half else t.hour
            number = {"y": t.year if len(u) > 2 else t.year % 100, "m": t.minute if minute else t.month, "d": t.day, "h": hour, "s": t.second}[u[0]]
            if u[0] == "m" and not minute and len(u) == 3:
                out.append(_MONTHS[t.month - 1])
            elif u[0] == "y":
                out.append(f"{number:0{4 if len(u) > 2 else 2}d}")
            else:
                out.append(f"{number:0{min(len(u), 2)}d}")
    return "".join(out)


def number_text(text: str, code: str) -> str:
    """A stored number under a number format: sign sections, thousands, fixed decimals, percent and literal text."""
    value = Decimal(text)
    sections = code.split(";")
    section = sections[1] if value < 0 and len(sections) > 1 else sections[2] if value == 0 and len(sections) > 2 else sections[0]
    bare = _LITERAL.sub("", section)
    place = re.search(r"[#0?][#0?,]*(\.[#0?]+)?", bare)
    if not place:
        return "".join(m[1] or m[2] or "" for m in re.finditer(r'"([^"]*)"|\\(.)', section)) if bare.strip() == "" else general(text)
    if "%" in bare:
        value *= 100
    decimals = (place[1] or ".")[1:]
    shown = f"{abs(value).quantize(Decimal(1).scaleb(-len(decimals)), ROUND_HALF_UP):{',' if ',' in place[0] else ''}f}"
    optional = len(decimals) - len(decimals.rstrip("#"))
    for _ in range(optional):
        if shown.endswith("0"):
            shown = shown[:-1]
    shown = shown.rstrip(".")
    whole = place[0].split(".")[0].replace(",", "")
    shown = shown.rjust(len(shown) + max(0, whole.count("0") - len(re.sub(r"\D", "", shown.split(".")[0]))), "0")
    if whole.count("0") == 0 and shown.startswith("0."):
        shown = shown[1:]
    mark = "\0"
    done, out = False, []
    for m in re.finditer(r'"([^"]*)"|\\(.)|\[\$?([^\]-]*)[^\]]*\]|_(.)|\*.|([#0?,.]+)|(.)', section, re.DOTALL):
        if m[1] is not None or m[2]:
            out.append(m[1] if m[1] is not None else m[2])
        elif m[0].startswith("[$"):
            out.append(m[3])
        elif m[5] and not done:
            out.append(mark)
            done = True
        elif m[6]:
            out.append(m[6])
    sign = "-" if value < 0 and len(sections) < 2 else ""
    return sign + "".join(out).replace(mark, shown).strip(" ") if done else sign + shown


def shown(text: str, code: str, year_1904: bool = False) -> str:
    """What a cell shows for a stored number; text that is no number stays."""
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return text
    if code == "@" or not code or code.lower() == "general":
        return general(text)
    if is_date(code):
        return date_text(text, code, year_1904) if Decimal(text) >= 0 else text
    return general(text) if "E+" in code.upper() else number_text(text, code)
