"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are dealt into blocks. With target weight w, a share of all
slots, block k of a source is released at floor(k / w) and due at
ceil((k + 1) / w); earliest-deadline-first over released blocks then meets every
deadline, so after any t slots a source that has not run out has had more than
w t - 1 and fewer than w t + 1 blocks. Weights are exact fractions, so this holds
for any weights, any number of sources and any number of slots.

What comes next depends on all that came before, so one task goes through the
blocks: it holds a few numbers per source, and writes one light row per block
of ``BLOCK_ROWS`` documents as it goes. Rows find their block's slot by a keyed
join, which Spark broadcasts where the schedule is small.

The rank of a row in its source does not need a window over the source: rows
are hashed into chunks of about ``CHUNK_ROWS``, chunk counts are summed up, and
only rows of one chunk are numbered together. Where sources have run out and no
block is released, slots stay idle.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulant.llm.common import discard, materialise

BLOCK_ROWS = 256
CHUNK_ROWS = 50_000
#: Default target weights are proportional to rows ** TEMPERATURE.
TEMPERATURE = 0.7
#: Blocks of the schedule that are written together.
_BATCH = 50_000


def edf_schedule(sources: list[tuple[str, float, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks of the sources (name, weight, blocks), earliest deadline first.

    Ties go to the lesser name. Weights are taken as the decimal numbers that
    they print as, so 0.7 is seven tenths and 1/3 with 2/3 is a third.
    """
    exact = {s: Fraction(repr(float(w))) for s, w, _ in sources}
    whole = math.lcm(*(f.denominator for f in exact.values()))
    weight = {s: int(f * whole) for s, f in exact.items()}
    total = sum(weight.values())
    blocks = {s: n for s, _, n in sources}
    waiting = [(0, s, 0) for s, n in blocks.items() if n]  # of each source the next block; by the time that it is released the one before is had
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            r, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weight[s]), s, k, r))
        due, s, k, r = heapq.heappop(ready)
        yield s, k, t, r, due
        t += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // weight[s], s, k + 1))


_SCHEDULE = "_stream string, _block long, _slot long, _release long, _due long"
_SCHEDULE_ARROW = pa.schema([("_stream", pa.string()), *[(c, pa.int64()) for c in ("_block", "_slot", "_release", "_due")]])


def _schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sources = sorted((r["_stream"], r["_weight"], r["_blocks"]) for b in batches for r in b.to_pylist())
    if not sources:
        return
    total, least = sum(w for _, w, _ in sources), min(w / n for _, w, n in sources)
    if total / least > 2.0**62:
        raise ValueError("target weights lie so far apart that slot numbers do not fit in a long")
    rows: list[tuple[str, int, int, int, int]] = []
    for row in edf_schedule(sources):
        rows.append(row)
        if len(rows) == _BATCH:
            yield pa.record_batch(list(map(list, zip(*rows))), schema=_SCHEDULE_ARROW)
            rows = []
    if rows:
        yield pa.record_batch(list(map(list, zip(*rows))), schema=_SCHEDULE_ARROW)


def _weighted(sizes: DataFrame, weights: dict[str, float] | None, block_rows: int) -> DataFrame:
    """``sizes`` with _weight and _blocks."""
    out = sizes.withColumn("_blocks", F.ceil(F.col("_rows") / block_rows))
    if weights is None:
        return out.withColumn("_weight", F.pow(F.col("_rows").cast("double"), F.lit(TEMPERATURE)))
    given = sizes.sparkSession.createDataFrame([("v" + s, float(w)) for s, w in weights.items() if w > 0], "_stream string, _weight double")
    out = out.join(given, "_stream", "left")
    missing = [r["_stream"] for r in out.where("_weight is null").orderBy("_stream").limit(5).collect()]
    if missing:
        raise ValueError(f"no positive target weight for {missing}")
    return out


def _scheduled(docs: DataFrame, id_col: str, source_col: str, weights: dict[str, float] | None, block_rows: int, chunk_rows: int) -> DataFrame:
    """``docs`` with _stream, _block, _place, _slot, _release, _due."""
    named = F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.withColumn("_stream", named)
    sizes = materialise(rows.groupBy("_stream").agg(F.count(F.lit(1)).alias("_rows")), "mixing-sources")
    sources = _weighted(sizes, weights, block_rows).select("_stream", "_weight", "_blocks").coalesce(1)
    schedule = materialise(sources.mapInArrow(_schedule, _SCHEDULE), "mixing-schedule")

    chunks = max(1, math.ceil((sizes.agg(F.sum("_rows")).first()[0] or 0) / chunk_rows))
    discard(sizes)
    rows = rows.withColumn("_h", F.xxhash64(id_col)).withColumn("_chunk", F.pmod(F.col("_h"), F.lit(chunks)))
    parts = rows.groupBy("_stream", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_stream").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_stream", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own_rows = Window.partitionBy("_stream", "_chunk").orderBy("_h", id_col)
    ranked = rows.withColumn("_rn", F.row_number().over(own_rows) - 1).join(starts, ["_stream", "_chunk"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_rn")).withColumn("_block", F.floor(F.col("_rank") / block_rows))
    out = ranked.join(schedule, ["_stream", "_block"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "_stream", "_block", (F.col("_rank") % block_rows).alias("_place"), "_slot", "_release", "_due")


def mixing_schedule(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """One row per input row: doc_id, source, block, place, slot, release, deadline.

    Sorted by (slot, place) the rows are in mixed order. Weights default to
    rows ** 0.7 by source; a null source is a stream of its own, ids that repeat
    or are null take neighbouring ranks, and an empty table gives an empty
    result.
    """
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"))
    out = _scheduled(light, "doc_id", "source", weights, block_rows, chunk_rows)
    return out.select("doc_id", "source", F.col("_block").alias("block"), F.col("_place").alias("place"), F.col("_slot").alias("slot"), F.col("_release").alias("release"), F.col("_due").alias("deadline"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """All rows and columns of ``docs``, dealt out and sorted in mixed order.

    Partitions follow each other in that order. Written and read again it is
    lost, as Spark reads files by size; ``mixed`` of what was read restores it.
    """
    renamed = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    out = _scheduled(rows, renamed[id_col], renamed[source_col], weights, block_rows, chunk_rows)
    out = out.repartitionByRange("_slot", "_place").sortWithinPartitions("_slot", "_place")
    return out.select(*[F.col(n).alias(c) for c, n in renamed.items()])
