"""Ordered work over per-key sequences that survives hot keys.

A recording is a sequence of rows per key. A plain ``Window.partitionBy(key)``
puts a whole sequence into one task, which fails once one key holds a large
share of the data. Here a long sequence is cut into *slices* of bounded size:

* keys with more rows than ``spark.tracelake.sliceRows`` are *hot*; every other
  key is one slice (number 0), and if a counting job finds no hot key at all the
  plan is the plain window;
* cut points of a hot key come from a sample chosen by hashing the row's own key
  and order columns. The choice depends on the data only, so a task that is run
  again after a lost executor, or a second scan in the same plan, sees the same cuts;
* window functions run per ``(key, slice)``; what crosses a cut (row offsets,
  running values, neighbour rows) is one row per slice and is joined back.

At most ``MAX_SLICES`` keys can be hot and at most twice as many slices exist, as
the limit for "hot" rises with the total row count. That bound is what makes the
broadcasts below safe at any data size. No other side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workdir import stored

SLICE_ROWS_CONF = "spark.tracelake.sliceRows"
DEFAULT_SLICE_ROWS = 2_000_000
MAX_SLICES = 32_768
SAMPLES_CONF = "spark.tracelake.samplesPerSlice"
SAMPLES_PER_SLICE = 64
_HASH_SPACE = 1 << 30
_SEARCH_STEPS = [1 << b for b in range(16, -1, -1)]

#: Key columns that stored timelines make and that are never null: plain equality keeps the hashes of their buckets.
NEVER_NULL = ["recording_key"]

HOT, SLICE = "_hot", "_slice"
LAYOUT = [HOT, SLICE]


def slice_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SLICE_ROWS_CONF, str(DEFAULT_SLICE_ROWS)))


def samples_per_slice(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SAMPLES_CONF, str(SAMPLES_PER_SLICE)))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
              broadcast: bool = False) -> DataFrame:
    """Null-safe equi-join on ``keys`` (plain for those that are never null); the key columns of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if broadcast:
        renamed = F.broadcast(renamed)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        one = left[k] == renamed[f"_r_{k}"] if k in NEVER_NULL else left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = one if i == 0 else cond & one
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _count_below(cuts: Column, point: Column) -> Column:
    """How many of the sorted ``cuts`` are <= ``point``, by binary search."""
    steps = F.array(*[F.lit(s) for s in _SEARCH_STEPS])
    return F.aggregate(
        steps, F.lit(0),
        lambda lo, step: F.when(F.get(cuts, lo + step - F.lit(1)) <= point, lo + step).otherwise(lo),
    )


def _find_cuts(df: DataFrame, keys: list[str], order: list[str], sizes_of: DataFrame | None) -> DataFrame | None:
    """(keys, _hot, _cuts = sorted cut points) of the hot keys, or None when no key is hot.

    Runs a counting job. Only if it finds a hot key are cuts sampled; they are then
    kept as a small stored table, at most ``2 * MAX_SLICES`` points.
    """
    limit = slice_rows(df)
    sizes = (sizes_of if sizes_of is not None else df).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    seen = sizes.agg(F.max("_rows").alias("top"), F.sum("_rows").alias("all")).first()
    if seen["top"] is None:
        return None
    samples = samples_per_slice(df)
    limit = max(limit, -(-seen["all"] // MAX_SLICES))
    if seen["top"] <= limit:
        return None
    hot = sizes.where(F.col("_rows") > limit).select(*keys)
    hashed = F.pmod(F.xxhash64(*keys, *order), F.lit(_HASH_SPACE))
    sample = join_keys(df.select(*keys, *order), hot, keys, "left_semi", broadcast=True).where(
        hashed < F.lit(_HASH_SPACE * samples / limit))
    picks = F.transform(
        F.sequence(F.lit(1), (F.size("_s") / samples).cast("int") - 1),
        lambda i: F.get(F.col("_s"), i * samples),
    )
    cuts = (
        sample.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_s"))
        .where(F.size("_s") >= 2 * samples)
        .select(*keys, F.lit(True).alias(HOT), picks.alias("_cuts"))
    )
    cuts = stored(cuts, "cuts")
    return None if cuts.isEmpty() else cuts


def slice_sequence(df: DataFrame, keys: list[str], order: list[str], sizes_of: DataFrame | None = None) -> DataFrame:
    """Add ``_hot`` and ``_slice`` if any key is hot, else return ``df`` as it is; no shuffle."""
    cuts = _find_cuts(df, keys, order, sizes_of)
    if cuts is None:
        return df
    out = join_keys(df, cuts, keys, "left", broadcast=True)
    place = F.when(F.col("_cuts").isNotNull(), _count_below(F.col("_cuts"), F.struct(*order)))
    return out.withColumn(SLICE, F.coalesce(place, F.lit(0))).drop("_cuts")


def is_sliced(df: DataFrame) -> bool:
    return SLICE in df.columns


def _parts(df: DataFrame, keys: list[str]) -> list[str]:
    return [*keys, *LAYOUT] if is_sliced(df) else list(keys)


def _per_slice(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregate the hot slices: at most ``2 * MAX_SLICES`` rows, stored.

    Storing them keeps a chain of ordered steps linear: each step reads the rows
    once and a finished small table, instead of carrying a second copy of all
    steps before it in the plan.
    """
    return stored(df.where(F.col(HOT).isNotNull()).groupBy(*keys, *LAYOUT).agg(*aggs), "slices")


def _with_slices(df: DataFrame, per_slice: DataFrame, keys: list[str]) -> DataFrame:
    return join_keys(df, per_slice.drop(HOT), [*keys, SLICE], "left", broadcast=True)


def index_rows(df: DataFrame, keys: list[str], order: list[str], *, weight: str | None = None,
               row: str = "row_idx", total: str = "n_rows", sizes_of: DataFrame | None = None) -> DataFrame:
    """Number the rows of every key from 0 in ``order`` and add the key's row count.

    ``order`` must identify a row within its key. With ``weight`` a row stands for
    that many equal rows: ``row`` is the first number it covers and ``total`` the
    sum of weights. ``sizes_of`` names a cheaper frame with at least as many rows
    per key for the size check. One shuffle of ``df``, by (key, slice).
    """
    w = F.col(weight) if weight else F.lit(1)
    sliced = slice_sequence(df, keys, order, sizes_of)
    parts = _parts(sliced, keys)
    win = Window.partitionBy(*parts).orderBy(*order)
    if weight:
        local = F.coalesce(F.sum(w).over(win.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        local = F.row_number().over(win).cast("bigint") - 1
    out = sliced.withColumns({row: local.cast("bigint"), total: F.sum(w).over(Window.partitionBy(*parts)).cast("bigint")})
    if not is_sliced(sliced):
        return out
    sums = _per_slice(sliced, keys, F.sum(w).alias("_w"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *LAYOUT, F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"),
                          F.sum("_w").over(whole).alias("_all"))
    out = _with_slices(out, offsets, keys)
    return out.withColumns({
        row: (F.col(row) + F.coalesce("_off", F.lit(0))).cast("bigint"),
        total: F.coalesce("_all", total).cast("bigint"),
    }).drop("_off", "_all")


def neighbours(df: DataFrame, keys: list[str], *, prev: dict[str, str | Column] | None = None,
               next: dict[str, str | Column] | None = None, row: str = "row_idx") -> DataFrame:
    """Values of the previous / next row of the same key (null at the ends).

    ``df`` comes from :func:`index_rows`; no further shuffle of it is needed.
    """
    prev, next = prev or {}, next or {}
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    win = Window.partitionBy(*_parts(df, keys)).orderBy(row)
    if not is_sliced(df):
        return df.withColumns({n: F.lag(as_col(c)).over(win) for n, c in prev.items()}
                              | {n: F.lead(as_col(c)).over(win) for n, c in next.items()})
    edge_aggs = []
    if prev:
        edge_aggs.append(F.max_by(F.struct(*[as_col(c).alias(n) for n, c in prev.items()]), F.col(row)).alias("_last"))
    if next:
        edge_aggs.append(F.min_by(F.struct(*[as_col(c).alias(n) for n, c in next.items()]), F.col(row)).alias("_first"))
    edges = _per_slice(df, keys, *edge_aggs)
    over_slices = Window.partitionBy(*keys).orderBy(SLICE)
    if prev:
        edges = edges.withColumn("_before", F.lag("_last").over(over_slices)).drop("_last")
    if next:
        edges = edges.withColumn("_after", F.lead("_first").over(over_slices)).drop("_first")
    local = {f"_p_{n}": F.lag(as_col(c)).over(win) for n, c in prev.items()}
    local |= {f"_n_{n}": F.lead(as_col(c)).over(win) for n, c in next.items()}
    inner = Window.partitionBy(*_parts(df, keys))
    local |= {"_lo": F.min(row).over(inner), "_hi": F.max(row).over(inner)}
    out = _with_slices(df.withColumns(local), edges, keys)
    done = {n: F.when(F.col(row) == F.col("_lo"), F.col("_before")[n]).otherwise(F.col(f"_p_{n}")) for n in prev}
    done |= {n: F.when(F.col(row) == F.col("_hi"), F.col("_after")[n]).otherwise(F.col(f"_n_{n}")) for n in next}
    return out.withColumns(done).drop(*local, "_before", "_after")


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], values: dict[str, tuple[str, str | Column]], *,
            row: str = "row_idx", inclusive: bool = True) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` from the first row of the key to this one."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    win = Window.partitionBy(*_parts(df, keys)).orderBy(row).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    if not is_sliced(df):
        return df.withColumns({n: _COMBINE[fn](as_col(c)).over(win) for n, (fn, c) in values.items()})
    totals = _per_slice(df, keys, *[_COMBINE[fn](as_col(c)).alias(f"_t_{n}") for n, (fn, c) in values.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.withColumns({f"_c_{n}": _COMBINE[fn](f"_t_{n}").over(before) for n, (fn, _) in values.items()})
    carries = carries.drop(*[f"_t_{n}" for n in values])
    local = {f"_l_{n}": _COMBINE[fn](as_col(c)).over(win) for n, (fn, c) in values.items()}
    out = _with_slices(df.withColumns(local), carries, keys)
    done = {}
    for n, (fn, _) in values.items():
        here, carry = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if fn == "sum":
            done[n] = F.when(here.isNull() & carry.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        else:
            pick = F.greatest if fn == "max" else F.least
            done[n] = F.coalesce(pick(here, carry), here, carry)
    return out.withColumns(done).drop(*local, *[f"_c_{n}" for n in values])


def last_known(df: DataFrame, keys: list[str], value: str, out: str, *, row: str = "row_idx") -> DataFrame:
    """Last non-null ``value`` up to and including this row (fill forward)."""
    tagged = F.when(F.col(value).isNotNull(), F.struct(F.col(row).alias("i"), F.col(value).alias("v")))
    return running(df, keys, {out: ("max", tagged)}, row=row).withColumn(out, F.col(out)["v"])


def runs(df: DataFrame, keys: list[str], flag: str, *, row: str = "row_idx", carry: list[Column] | None = None) -> DataFrame:
    """One row per run of consecutive rows with equal ``flag`` (null counts as false).

    Columns: keys, ``flag``, ``run_start`` (row number), ``run_rows``, plus the
    aggregates passed in ``carry``.
    """
    flagged = df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    linked = neighbours(flagged, keys, prev={"_pf": flag}, row=row)
    begins = F.when(F.col("_pf").isNull() | (F.col("_pf") != F.col(flag)), F.col(row))
    marked = running(linked, keys, {"run_start": ("max", begins)}, row=row)
    return marked.groupBy(*keys, "run_start").agg(
        F.first(flag).alias(flag), F.count(F.lit(1)).alias("run_rows"), *(carry or []))


def sliding_sum(df: DataFrame, keys: list[str], value: Column, frame_rows: int, out: str, *,
                row: str = "row_idx", block: int | None = None) -> DataFrame:
    """Sum over the last ``frame_rows`` rows; null until the frame is full.

    Rows are regrouped into blocks of consecutive row numbers; the rows a block
    needs from before its start are copied to it, so any key can be split.
    """
    size = max(block or slice_rows(df), frame_rows)
    home = F.floor(F.col(row) / size).cast("bigint")
    reach = F.floor((F.col(row) + frame_rows - 1) / size).cast("bigint")
    copies = df.withColumn("_v", value).withColumn("_home", home).withColumn(
        "_block", F.explode(F.sequence(home, reach)))
    win = Window.partitionBy(*keys, "_block").orderBy(row).rowsBetween(-(frame_rows - 1), 0)
    summed = copies.withColumn(out, F.sum("_v").over(win)).where(F.col("_block") == F.col("_home"))
    return summed.withColumn(out, F.when(F.col(row) >= frame_rows - 1, F.col(out))).drop("_v", "_home", "_block")


def strip_layout(df: DataFrame) -> DataFrame:
    return df.drop(*LAYOUT)
