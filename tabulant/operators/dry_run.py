"""Merging and splitting with counts from the pass that computes the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabulant.functions.scalars import declared_amount, split_amount, tolerance
from tabulant.operators.people import merge_people, split_amounts


class Counts:
    """What an action on the prepared rows has counted on its way; ``get`` waits for the first one."""

    def __init__(self) -> None:
        self.watched = {k: Observation(k) for k in ("rows", "groups", "split")}
        self.merged = False

    def get(self) -> dict[str, int]:
        """rows_in, without_key, groups, conflicting (with merging), rows_merged, rows_out, mismatches."""
        names = ("rows", "groups", "split") if self.merged else ("split",)
        return {k: v or 0 for n in names for k, v in self.watched[n].get.items()}


def prepared(
    rows: DataFrame, types: dict[str, int], amount_cols: list[int], total_col: int | None = None, labels: dict[int, str] | None = None, merge: bool = True, note_col: int | None = None, label_note: bool = False
) -> tuple[DataFrame, Counts]:
    """The rows that are going to be written, and the counts that are shown before: one plan, one pass.

    An action on the rows (``write``, or ``noop`` for a preview only) fills the counts.
    """
    counts = Counts()
    merged, _ = merge_people(rows, types, amount_cols, labels, merge, counts.watched)
    counts.merged = merge and (types.get("idCard") is not None or types.get("name") is not None)
    values = [split_amount(F.get("cells", F.lit(c))) for c in sorted(amount_cols)]
    parts = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    out = F.greatest(parts, F.lit(1)) if len(values) > 1 else F.lit(1)
    if total_col is None or len(values) < 2:
        wrong = F.lit(False)
    else:
        declared, total = declared_amount(F.get("cells", F.lit(total_col))), sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
        wrong = F.abs(total - declared) > tolerance(declared)
    seen = merged.observe(counts.watched["split"], F.count(F.lit(1)).alias("rows_merged"), F.sum(out).alias("rows_out"), F.count_if(wrong).alias("mismatches"))
    return split_amounts(seen, amount_cols, total_col, note_col, labels, label_note)[0], counts
