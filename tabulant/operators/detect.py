"""Table detection and schema inference over grids.

A grid is a DataFrame (source_id, row_idx, cells array<string>), many sources at
once. Everything is decided per source on the cluster: rows are scored inside
their own row, per-source facts come from aggregates, and only the sequential
claiming of columns looks at a source's columns together, as one small group.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulant.functions import constants as C
from tabulant.functions.scalars import declared_amount, is_amount_like, js_trim, split_amount, tolerance

SCAN_ROWS = 30
SAMPLE = 12
#: Parts into which the rows of one source are dealt, so that a few large sources occupy all tasks.
PARTS = 64


def beside(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows joined with the few facts of their source. Facts are repeated per part; no task holds all rows of a source."""
    part = F.pmod(F.xxhash64("row_idx"), F.lit(PARTS)).cast("int")
    every = facts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", part).join(every, ["source_id", "_part"]).drop("_part")


def _any(cells: Column, test) -> Column:
    return F.exists(cells, test)


def filled(cells: Column) -> Column:
    """The trimmed cells that are not blank."""
    return F.filter(F.transform(cells, js_trim), lambda c: c != "")


def header_score(cells: Column) -> Column:
    """Keyword hits of a row, half a point for a sequence-number cell."""

    def points(c: Column) -> Column:
        hits = sum((F.rlike(c, F.lit(p)).cast("double") for p in C.COLUMN_KEYWORDS.values()), F.lit(0.0))
        return F.when(js_trim(c) == "", F.lit(0.0)).otherwise(hits + 0.5 * F.rlike(c, F.lit(C.SEQUENCE_HEADER)).cast("double"))

    return F.aggregate(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), F.lit(0.0), lambda a, c: a + points(c))


def header_rows(grid: DataFrame) -> DataFrame:
    """(source_id, header_row, cells): the best of the first rows, the earliest of equals."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("row_idx"))
    head = grid.withColumn("_at", place).where(F.col("_at") <= SCAN_ROWS).withColumn("_score", header_score(F.col("cells")))
    best = F.max_by(F.struct("row_idx", "cells"), F.struct("_score", -F.col("row_idx")))
    return head.groupBy("source_id").agg(best.alias("h")).select("source_id", F.col("h.row_idx").alias("header_row"), F.col("h.cells").alias("header"))


def is_continuation(header: Column, following: Column) -> Column:
    """Whether the next row is the second line of a header."""
    found = filled(following)
    short = F.forall(found, lambda c: ~F.rlike(c, F.lit(r"^[0-9]+(\.[0-9]+)?\z|^[0-9]{17}[0-9Xx]\z")) & (F.length(c) <= 10))
    return F.coalesce((F.size(found) > 0) & (F.size(found) <= F.greatest(F.lit(3.0), 0.5 * F.size(header))) & short, F.lit(False))


def merged_header(a: Column, b: Column) -> Column:
    """D3: both lines of a header, joined by column."""
    return F.zip_with(a, b, lambda x, y: F.concat(js_trim(x), js_trim(y)))


def is_total_row(cells: Column) -> Column:
    """The first filled cell begins with a total word."""
    return F.coalesce(F.rlike(F.get(filled(cells), F.lit(0)), F.lit(C.TOTAL_ROW)), F.lit(False))


def is_repeated_header(cells: Column) -> Column:
    """Three or more short header words that make up 60 % of the filled cells."""
    found = filled(cells)
    words = F.size(F.filter(found, lambda c: F.rlike(c, F.lit(C.HEADER_WORDS)) & (F.length(c) <= 8)))
    return (words >= 3) & (words >= 0.6 * F.size(found))


def has_identity(cells: Column, header: Column) -> Column:
    """A strong id, or a name with an amount among three filled cells."""
    both = F.arrays_zip(F.transform(cells, js_trim).alias("c"), F.transform(header, js_trim).alias("h"))
    strong = lambda c: F.rlike(c, F.lit(r"^[0-9A-Za-z]{18}\z|^1[3-9][0-9]{9}\z|^[0-9]{16,19}\z"))
    fee = lambda c: F.rlike(c, F.lit(C.FEE_LABEL))
    word = lambda c: F.rlike(c, F.lit(r"^[\x{4e00}-\x{9fff}·]{2,15}\z"))
    placed = lambda h: F.rlike(F.coalesce(h, F.lit("")), F.lit(C.NOT_A_NAME_COLUMN))
    name = F.exists(both, lambda z: F.coalesce(word(z["c"]) & ~fee(z["c"]) & ~placed(z["h"]), F.lit(False)))
    amount = F.exists(cells, lambda c: ~strong(js_trim(c)) & ~fee(js_trim(c)) & ~word(js_trim(c)) & is_amount_like(c))
    return F.exists(cells, lambda c: strong(js_trim(c))) | (name & amount & (F.size(filled(cells)) >= 3))


def detect_tables(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables: source_id, header_row, header, filtered_count; data rows: source_id, row_idx, cells, header)."""
    best = header_rows(grid)
    after = grid.select("source_id", (F.col("row_idx") - 1).alias("header_row"), F.col("cells").alias("_next"))
    two = is_continuation(F.col("header"), F.col("_next"))
    heads = best.join(after, ["source_id", "header_row"], "left").select(
        "source_id", "header_row", F.when(two, merged_header(F.col("header"), F.col("_next"))).otherwise(F.transform("header", js_trim)).alias("header"), F.when(two, 2).otherwise(1).alias("_lines")
    )
    body = beside(grid, heads).where(F.col("row_idx") >= F.col("header_row") + F.col("_lines"))
    body = body.where((F.size(filled(F.col("cells"))) > 0) & ~is_total_row(F.col("cells")) & ~is_repeated_header(F.col("cells")))
    judged = body.withColumn("_person", has_identity(F.col("cells"), F.col("header")))
    dropped = judged.groupBy("source_id").agg(F.count_if(~F.col("_person")).alias("filtered_count"))
    tables = heads.join(dropped, "source_id", "left").select("source_id", "header_row", "header", F.coalesce("filtered_count", F.lit(0)).alias("filtered_count"))
    return tables, judged.where("_person").select("source_id", "row_idx", "cells", "header")


def column_profile(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per (source, column): the facts that D9, D10, D13-D16 need, in one pass over the head of each source."""
    at = F.row_number().over(Window.partitionBy("source_id").orderBy("row_idx"))
    head = rows.withColumn("_at", at).where(F.col("_at") <= 20)
    cells = head.select("source_id", "_at", F.posexplode("cells").alias("col_idx", "cell"))
    v = js_trim("cell")
    here, like = v != "", is_amount_like("cell")
    first = F.col("_at") <= SAMPLE
    digits = F.rlike(F.regexp_replace(v, r"\s+", ""), F.lit(r"^[0-9]{10,23}\z"))
    namelike = F.rlike(v, F.lit(r"^[\x{4e00}-\x{9fff}·]{2,6}\z")) & ~F.rlike(v, F.lit(C.FEE_PREFIX))
    facts = cells.groupBy("source_id", "col_idx").agg(
        F.count_if(first & here).alias("filled12"),
        F.count_if(first & here & digits).alias("cards12"),
        F.count_if(first & like).alias("amounts12"),
        F.count_if((F.col("_at") <= 10) & like).alias("amounts10"),
        F.count_if(here).alias("filled20"),
        F.count_if(here & namelike).alias("names20"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("_at") <= 3) & here, F.struct("_at", v.alias("v"))))), lambda s: s["v"]).alias("samples"),
    )
    n = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"))
    heads = tables.select("source_id", F.posexplode_outer("header").alias("col_idx", "header"))
    return heads.join(facts, ["source_id", "col_idx"], "left").join(n, "source_id", "left").fillna(0, ["filled12", "cards12", "amounts12", "amounts10", "filled20", "names20", "n_rows"])


def amount_candidates(profile: DataFrame) -> Column:
    """D10 on a profile row: not excluded by its header, and 60 % amounts among the filled cells."""
    return ~F.rlike(js_trim("header"), F.lit(C.MULTI_AMOUNT_EXCLUDED)) & (F.col("filled12") > 0) & (F.col("amounts12") >= 0.6 * F.col("filled12"))


def sum_relations(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per source the best (total_col, split_cols): a column that the sum of two or more others makes up.

    ``candidates``: (source_id, cols array<int>) with two to eight columns, so a
    source has at most 8 * 2 ** 7 combinations. The first 20 rows, then all
    rows, must agree to 80 % with at least three checked.
    """
    fit = candidates.where(F.size("cols").between(2, 8))
    totals = fit.select("source_id", "cols", F.explode("cols").alias("total_col")).withColumn("rest", F.array_remove("cols", F.col("total_col")))
    masks = totals.withColumn("mask", F.explode(F.sequence(F.lit(0), F.shiftleft(F.lit(1), 7) - 1))).where(F.col("mask") < F.pow(F.lit(2), F.size("rest")))
    bit = lambda c, i: F.get(F.split(F.lpad(F.bin(F.col("mask")), 8, "0"), ""), F.lit(7) - i) == "1"
    combos = masks.withColumn("split_cols", F.filter("rest", bit)).where(F.size("split_cols") >= 2).select("source_id", "total_col", "split_cols")
    def tried(part: DataFrame, on: DataFrame) -> DataFrame:
        declared = declared_amount(F.get("cells", F.col("total_col")))
        total = F.aggregate("split_cols", F.lit(0.0), lambda a, c: a + F.coalesce(split_amount(F.get(F.col("cells"), c)), F.lit(0.0)))
        checked = beside(part, on).withColumn("_d", declared).where(F.col("_d").isNotNull()).withColumn("_ok", F.abs(total - F.col("_d")) <= tolerance(F.col("_d")))
        sums = checked.groupBy("source_id", "total_col", "split_cols").agg(F.count(F.lit(1)).alias("n"), F.count_if("_ok").alias("ok"))
        return sums.where("n >= 3 and ok >= 0.8 * n")

    at = F.row_number().over(Window.partitionBy("source_id").orderBy("row_idx"))
    head = rows.select("source_id", "row_idx", "cells", at.alias("_at")).where("_at <= 20")
    likely = tried(head, combos).drop("n", "ok")
    good = tried(rows.select("source_id", "row_idx", "cells"), likely)
    order = Window.partitionBy("source_id").orderBy(F.desc(F.size("split_cols")), F.desc("ok"), "total_col", F.array_join(F.col("split_cols").cast("array<string>"), ","))
    return good.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("source_id", "total_col", "split_cols", "ok")


def amount_score(header: str, amounts: int, sample: int) -> float:
    """D14 of one column."""
    if not header or re.search(C.AMOUNT_EXCLUDED, header):
        return float("-inf")
    score = float(next((points for points, p in C.AMOUNT_TIERS if re.search(p, header)), 0))
    if not sample:
        return score
    ratio = amounts / sample
    return score + 8 * ratio - (8 if ratio < 0.35 and score + 8 * ratio < 6 else 0)


def keyword_claims(columns: list[tuple[int, str, float]]) -> dict[int, str]:
    """Types claimed by headers. ``columns``: (index, header, share of card numbers in the data)."""
    claimed: dict[int, str] = {}
    used: set[str] = set()
    for i, header, cards in columns:
        for kind, regex in C.COLUMN_KEYWORDS.items():
            if not header or kind == "amount" or kind in used or not re.search(regex.replace(r"\z", r"\Z"), header):
                continue
            if kind == "bankCard" and re.search(C.LOCATION_HEADER, header):
                continue
            if kind == "bankCard" and not re.search(C.CARD_HINT, header) and cards < 0.5:
                if "bankName" not in used:  # the column goes on: a later type may still take it over
                    claimed[i] = "bankName"
                    used.add("bankName")
                continue
            claimed[i] = kind
            used.add(kind)
            break
    return claimed


def infer_types(profile: DataFrame, relations: DataFrame, infer_names: bool = False) -> DataFrame:
    """(source_id, col_idx, header, type, samples), type '' where none is recognised."""
    given = profile.join(relations, "source_id", "left")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col_idx")
        headers = [str(h or "").strip() for h in pdf["header"]]
        index = [int(i) for i in pdf["col_idx"]]
        facts = pdf.to_dict("records")
        cards = [f["cards12"] / f["filled12"] if f["filled12"] else 1.0 for f in facts]
        claimed = keyword_claims(list(zip(index, headers, cards)))
        candidates = [
            i for i, h, f in zip(index, headers, facts) if i not in claimed and not (h and re.search(C.MULTI_AMOUNT_EXCLUDED, h)) and f["filled12"] and f["amounts12"] >= 0.6 * f["filled12"]
        ]
        several = False
        if 2 <= len(candidates) <= 8:
            total = facts[0]["total_col"]
            if total is not None and total == total:
                claimed[int(total)] = "amountTotal"
                claimed |= {int(c): "amount" for c in facts[0]["split_cols"]}
                several = True
            else:
                own = [headers[index.index(i)] for i in candidates]
                pens = sum(bool(re.search(C.PEN_HEADER.replace(r"\z", r"\Z"), h)) for h in own)
                months = sum(bool(re.search(C.MONTH_HEADER.replace(r"\z", r"\Z"), h)) for h in own)
                if pens >= 2 or months >= 2:
                    claimed |= {i: "amount" for i in candidates}
                    several = True
        n = int(facts[0]["n_rows"]) if facts else 0
        if not several:
            scored = [(amount_score(h, f["amounts12"], min(n, SAMPLE)), -i) for i, h, f in zip(index, headers, facts) if i not in claimed]
            score, place = max(scored, default=(float("-inf"), 0))
            if score >= 5:
                claimed[-place] = "amount"
            else:
                found = next((i for i, f in zip(index, facts) if i not in claimed and f["amounts10"] >= 0.5 * min(n, 10)), None)
                if found is not None:
                    claimed[found] = "amount"
        if infer_names and "name" not in claimed.values() and min(n, 20) >= 3:
            shares = [(f["names20"] / f["filled20"], -i) for i, f in zip(index, facts) if i not in claimed and f["filled20"] >= 3 and f["names20"] >= 0.6 * f["filled20"]]
            if shares:
                claimed[-max(shares)[1]] = "name"
        kept = [(f, i, h) for f, i, h in zip(facts, index, headers) if h or i in claimed]
        return pd.DataFrame(
            {
                "source_id": [f["source_id"] for f, _, _ in kept],
                "col_idx": [i for _, i, _ in kept],
                "header": [h or f"列{i + 1}" for _, i, h in kept],
                "type": [claimed.get(i, "") for _, i, _ in kept],
                "samples": [list(f["samples"]) if f["samples"] is not None else [] for f, _, _ in kept],
            }
        )

    return given.groupBy("source_id").applyInPandas(decide, "source_id string, col_idx int, header string, type string, samples array<string>")


def detect_columns(grid: DataFrame, infer_names: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables, data rows and typed columns of all sources."""
    tables, rows = detect_tables(grid)
    profile = column_profile(tables, rows)
    wanted = profile.where(amount_candidates(profile)).groupBy("source_id").agg(F.sort_array(F.collect_list("col_idx")).alias("cols"))
    # Columns claimed by a keyword are no candidates; the same claim decides it as in infer_types.
    claims = profile.groupBy("source_id").applyInPandas(_free_columns, "source_id string, free array<int>")
    wanted = wanted.join(claims, "source_id").select("source_id", F.array_sort(F.array_intersect("cols", "free")).alias("cols"))
    return tables, rows, infer_types(profile, sum_relations(rows, wanted), infer_names)


def _free_columns(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("col_idx")
    cards = [c / f if f else 1.0 for c, f in zip(pdf["cards12"], pdf["filled12"])]
    claimed = keyword_claims(list(zip(map(int, pdf["col_idx"]), [str(h or "").strip() for h in pdf["header"]], cards)))
    return pd.DataFrame({"source_id": [pdf["source_id"].iloc[0]], "free": [[int(i) for i in pdf["col_idx"] if int(i) not in claimed]]})


def type_columns(columns: DataFrame) -> DataFrame:
    """(source_id, type, col_idx): the last column of a type, the first one for amounts."""
    typed = columns.where("type <> ''")
    return typed.groupBy("source_id", "type").agg(F.when(F.first("type") == "amount", F.min("col_idx")).otherwise(F.max("col_idx")).alias("col_idx"))


def override_types(columns: DataFrame, overrides: DataFrame) -> DataFrame:
    """A user's type wins; the empty type says the column is not recognised."""
    own = overrides.select("source_id", "col_idx", F.col("type").alias("_own"))
    return columns.join(own, ["source_id", "col_idx"], "left").withColumn("type", F.coalesce("_own", "type")).drop("_own")


def source_scores(tables: DataFrame, rows: DataFrame, columns: DataFrame, names: DataFrame) -> DataFrame:
    """(source_id, score, data_rows). ``names``: (source_id, sheet_name)."""
    typed = columns.where("type <> ''")
    heads = typed.groupBy("source_id").agg(F.sum(F.when(F.col("type") == "amount", 25).when(F.col("type") == "name", 20).otherwise(10)).alias("header_score"))
    cols = typed.groupBy("source_id").agg(F.min(F.when(F.col("type") == "amount", F.col("col_idx"))).alias("a"), F.min(F.when(F.col("type") == "name", F.col("col_idx"))).alias("n"))
    at = F.row_number().over(Window.partitionBy("source_id").orderBy("row_idx"))
    marked = rows.withColumn("_at", at).join(cols, "source_id", "left")
    sample = F.col("_at") <= 50
    facts = marked.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("data_rows"),
        F.count_if(sample).alias("k"),
        F.count_if(sample & is_amount_like(F.get("cells", F.col("a")))).alias("amounts"),
        F.count_if(sample & (js_trim(F.get("cells", F.col("n"))) != "")).alias("people"),
    )
    share = lambda c, points: F.floor(F.col(c) / F.greatest("k", F.lit(1)) * points + 0.5)
    named = F.when(F.rlike("sheet_name", F.lit(C.SHEET_BONUS)), 8).otherwise(0) - F.when(F.rlike("sheet_name", F.lit(C.SHEET_PENALTY)), 12).otherwise(0)
    every = names.join(tables.select("source_id", "filtered_count"), "source_id", "left").join(heads, "source_id", "left").join(facts, "source_id", "left").fillna(0, ["header_score", "data_rows", "k", "amounts", "people"])
    full = F.col("header_score") + F.when(F.col("k") >= 3, 8).otherwise(0) + share("amounts", 18) + share("people", 12) + named
    return every.select("source_id", "sheet_name", F.when(F.col("filtered_count").isNull(), -999).otherwise(full).alias("score"), "data_rows")


def selected_sheets(scores: DataFrame, file_col: str = "file") -> DataFrame:
    """Which sheets of a file are taken; best first."""
    per_file = Window.partitionBy(file_col)
    fit = (F.col("score") >= 30) & (F.col("data_rows") >= 1) & (F.col("score") >= F.max("score").over(per_file) - 15) & ~F.rlike("sheet_name", F.lit(C.SHEET_NOT_SELECTED))
    ranked = scores.withColumn("_fit", fit).withColumn("_r", F.row_number().over(per_file.orderBy(F.desc("score"), "sheet_pos")))
    any_fit = F.max("_fit").over(per_file)
    return ranked.withColumn("selected", F.when(any_fit, F.col("_fit")).otherwise(F.col("_r") == 1)).withColumnRenamed("_r", "place").drop("_fit")
