"""Epochs with one array column per instrument instead of one column per sub-column.

A full export has thousands of sub-columns that come from a few hundred instruments. Wide
plans over thousands of columns neither compile nor schedule well, so the layout here is:
an instrument with several sub-columns is one ``array<double>`` column, in the order of its
sub-index; an instrument with one is a plain double. Exports number their instruments
differently, so columns are named by label, and each file has its own places for them: a
row of ``file_places`` per file says at which cells an instrument's values stand. Rows are
packed by looking these cells up, without a long form in between and without parsing the
cells of instruments that are not asked for; ``unpack_rows`` turns them back exactly.

The instruments of a cohort are collected: they are bounded by the vocabulary of templates
(``MAX_INSTRUMENTS``), not by the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import identifier
from ..functions.numbers import clean_nan
from .columns import unique_names
from .ordered import join_keys
from .quality import Instrument, region_of
from .retrieve import spectrogram_instrument, spectrogram_long

MAX_INSTRUMENTS = 4_000


@dataclass(frozen=True)
class Slot:
    """An instrument of the cohort: its column's name, what it measures and how many values it has at most."""

    name: str
    family: str
    label: str
    width: int

    @property
    def is_array(self) -> bool:
        return self.width > 1

    @property
    def region(self) -> str:
        return region_of(self.label)


def instrument_layout(columns: DataFrame, keys: list[str], scalar_name: str | None = None) -> DataFrame:
    """(keys, i_group, instrument, family, label, width, places, codes) from the columns of every file.

    ``columns``: (keys, col_idx, code, label, i_group, sub_index, family). ``places`` and
    ``codes`` are in the order of sub-indexes from 1, null where a file lacks one; of a code
    that appears twice the first column counts. Equal names in a file are told apart in
    the order of their instrument numbers. ``scalar_name`` names a column whose value is
    the name of an instrument with one value; others are named by their label.
    """
    own = F.col(scalar_name) if scalar_name else F.lit(None).cast("string")
    cell = columns.groupBy(*keys, "i_group", "sub_index").agg(F.min_by(F.struct("col_idx", "code", "label", "family", own.alias("own")), "col_idx").alias("c"))
    shown = F.when(F.col("c.label") != "", F.col("sub_index"))
    per = cell.groupBy(*keys, "i_group").agg(
        F.coalesce(F.min_by("c.label", shown), F.lit("")).alias("label"), F.min_by("c.own", "sub_index").alias("_own"), F.min_by("c.family", "sub_index").alias("family"), F.max("sub_index").alias("width"),
        F.map_from_entries(F.collect_list(F.struct("sub_index", F.struct(F.col("c.col_idx").alias("at"), F.col("c.code").alias("code"))))).alias("_m"))
    cells = F.transform(F.sequence(F.lit(1), F.col("width").cast("int")), lambda k: F.try_element_at("_m", k))
    named = F.when((F.col("width") == 1) & F.col("_own").isNotNull(), F.col("_own")).when(F.col("label") != "", identifier("label")).otherwise(F.concat_ws("_", "family", F.col("i_group").cast("string")))
    out = per.withColumns({"places": F.transform(cells, lambda c: c["at"].cast("int")), "codes": F.transform(cells, lambda c: c["code"]), "instrument": named}).drop("_m", "_own")
    return unique_names(out, keys, "i_group", "instrument").drop("instrument").withColumnRenamed("unique_name", "instrument")


def cohort_slots(layout: DataFrame) -> list[Slot]:
    """The cohort's instruments in order of their names."""
    found = layout.groupBy("instrument").agg(F.max("width").alias("width"), F.min(F.struct("family", "label")).alias("x"))
    rows = found.orderBy("instrument").limit(MAX_INSTRUMENTS + 1).collect()
    if len(rows) > MAX_INSTRUMENTS:
        raise ValueError(f"more than {MAX_INSTRUMENTS} different instruments; are the labels what they should be?")
    return [Slot(r["instrument"], r["x"]["family"], r["x"]["label"], r["width"]) for r in rows]


def _per_file(layout: DataFrame, slots: list[Slot], keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): ``value`` of every slot of the file in the order of ``slots``, null where it has none."""
    names = F.array(*[F.lit(s.name) for s in slots])
    known = layout.where(F.col("instrument").isin([s.name for s in slots]))
    maps = known.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("instrument", value))).alias("_m"))
    return maps.select(*keys, F.transform(names, lambda n: F.try_element_at("_m", n)).alias(out))


def file_places(layout: DataFrame, slots: list[Slot], keys: list[str]) -> DataFrame:
    """(keys, places): per slot the cells that hold its values; one row per file."""
    return _per_file(layout, slots, keys, "places", "places")


def _packed_columns(slots: list[Slot], value) -> list[Column]:
    """``value(cell)`` of all cells of every slot, as its column."""
    at = lambda i: F.get("places", F.lit(i))
    return [(F.transform(at(i), value) if s.is_array else value(F.get(at(i), F.lit(0)))).alias(s.name) for i, s in enumerate(slots)]


def pack_rows(rows: DataFrame, layout: DataFrame, slots: list[Slot], keys: list[str], keep: list[str] = ("row_idx", "ts")) -> DataFrame:
    """Rows with a ``values`` array of all cells -> keys, ``keep`` and a column per instrument."""
    placed = join_keys(rows, file_places(layout, slots, keys), keys)
    return placed.select(*keys, *keep, *_packed_columns(slots, lambda p: F.get("values", p)))


def pack_lines(lines: DataFrame, codes: DataFrame, layout: DataFrame, slots: list[Slot], of: str = "file", keep: list[str] = ()) -> DataFrame:
    """Lines of exports -> file, ``keep``, row_idx, serial, ts and a column per instrument; only cells of ``slots`` are parsed.

    ``codes`` is what ``exports.code_rows`` gives, with the columns ``keep``. ``of`` is its column that names
    the file whose ``layout`` a file shares.
    """
    from ..functions.clock import serial_to_timestamp
    from ..sources.exports import CLOCK, cells

    clock = F.array_position("codes", CLOCK).cast("int") - 1
    places = file_places(layout, slots, ["file"]).withColumnRenamed("file", "_of")
    per_file = codes.select("file", "code_line", clock.alias("_clock"), F.col(of).alias("_of"), *keep).join(places, "_of").drop("_of")
    data = lines.join(per_file, "file").where((F.col("line_no") > F.col("code_line")) & (F.trim("text") != ""))
    split = F.when(F.contains("text", F.lit('"')), cells("text")).otherwise(F.split("text", ",", -1))
    cell = lambda p: F.trim(F.get("_cells", p))
    number = lambda p: F.when(cell(p) != "", cell(p)).try_cast("double")  # noqa: E731  (a failing cast costs much more than the test)
    cleaned = lambda s: F.transform(s.name, clean_nan) if s.is_array else clean_nan(s.name)
    cut = data.select("file", *keep, (F.col("line_no") - F.col("code_line") - 1).alias("row_idx"), "_clock", "places", split.alias("_cells"))
    parsed = cut.select("file", *keep, "row_idx", number(F.col("_clock")).alias("serial"), *_packed_columns(slots, number))
    out = parsed.select("file", *keep, "row_idx", clean_nan("serial").alias("serial"), *[cleaned(s).alias(s.name) for s in slots])
    return out.select("file", *keep, "row_idx", "serial", serial_to_timestamp("serial").alias("ts"), *[s.name for s in slots])


def _arrays(slots: list[Slot]) -> Column:
    return F.array(*[F.col(s.name) if s.is_array else F.array(s.name) for s in slots])


def unpack_rows(packed: DataFrame, layout: DataFrame, slots: list[Slot], keys: list[str], keep: list[str] = ("row_idx", "ts")) -> DataFrame:
    """The inverse: keys, ``keep``, ``codes`` and ``values`` in the order of the file's columns."""
    entry = F.arrays_zip(F.col("places").alias("at"), F.col("codes").alias("code"))
    at_slot = {s.name: i for i, s in enumerate(slots)}
    number = F.get(F.map_values(F.map_filter(F.create_map(*[x for n, i in at_slot.items() for x in (F.lit(n), F.lit(i))]), lambda k, _: k == F.col("instrument"))), F.lit(0))
    cells = layout.where(F.col("instrument").isin(list(at_slot))).select(*keys, number.alias("slot"), F.posexplode(entry).alias("sub", "c"))
    back = cells.where(F.col("c.at").isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("c.at").alias("at"), F.col("c.code").alias("code"), "slot", "sub"))).alias("_back"))
    wide = join_keys(packed.select(*keys, *keep, _arrays(slots).alias("_a")), back, keys)
    return wide.select(*keys, *keep, F.transform("_back", lambda b: b["code"]).alias("codes"),
                       F.transform("_back", lambda b: F.get(F.get("_a", b["slot"]), b["sub"])).alias("values"))


def long_values(packed: DataFrame, slots: list[Slot], ids: list[str]) -> DataFrame:
    """(ids, instrument, sub_index, value) of every present value."""
    named = F.array(*[F.struct(F.lit(s.name).alias("instrument"), (F.col(s.name) if s.is_array else F.array(s.name)).alias("v")) for s in slots])
    each = packed.select(*ids, F.inline(named)).select(*ids, "instrument", F.posexplode("v").alias("_p", "value"))
    return each.where(F.col("value").isNotNull()).select(*ids, "instrument", (F.col("_p") + 1).alias("sub_index"), "value")


def instrument_sums(packed: DataFrame, slots: list[Slot], ids: list[str]) -> DataFrame:
    """(ids, instrument, n_values, total) per row and instrument, added up within the row: no row per value is made."""
    def sums(s: Slot) -> Column:
        v = F.filter(s.name, lambda x: x.isNotNull()) if s.is_array else F.col(s.name)
        n = F.coalesce(F.size(v), F.lit(0)) if s.is_array else v.isNotNull().cast("int")
        total = F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x)) if s.is_array else v
        return F.struct(F.lit(s.name).alias("instrument"), n.cast("long").alias("n_values"), total.alias("total"))

    return packed.select(*ids, F.inline(F.array(*[sums(s) for s in slots])))


def cell_counts(packed: DataFrame, slots: list[Slot], keys: list[str]) -> DataFrame:
    """(keys, n_cells, n_null, n_nan) over all values of the instruments that a file has."""
    def count(s: Slot, cond) -> Column:
        one = lambda v: F.coalesce(cond(v), F.lit(False)).cast("int")
        return F.coalesce(F.aggregate(s.name, F.lit(0), lambda n, v: n + one(v)), F.lit(0)) if s.is_array else one(F.col(s.name))

    total = lambda cond: F.sum(sum((count(s, cond) for s in slots), F.lit(0)))
    return packed.groupBy(*keys).agg(total(lambda v: F.lit(True)).alias("n_cells"), total(lambda v: v.isNull()).alias("n_null"), total(lambda v: F.isnan(v)).alias("n_nan"))


def null_rule_instruments(slots: list[Slot]) -> list[Instrument]:
    """The instruments as the null rule of suppressed zeros takes them: one array or one column each."""
    return [Instrument(s.name, s.family, s.region, () if s.is_array else (s.name,), s.name if s.is_array else None) for s in slots]


def family_spectrogram(packed: DataFrame, columns: DataFrame, layout: DataFrame, slots: list[Slot], keys: list[str], family: str,
                       hemisphere: str | None = None, prefer: str | None = None, ids: list[str] = ("row_idx", "ts")) -> DataFrame:
    """(keys, ids, bin, freq_hz, value) of each file's best instrument of a family, read from its one array column."""
    own = [s for s in slots if s.family == family and s.is_array]
    chosen = join_keys(spectrogram_instrument(columns, keys, family, hemisphere, prefer), layout.select(*keys, "i_group", "instrument"), [*keys, "i_group"])
    rows = join_keys(packed, chosen.select(*keys, "instrument"), keys)
    pick = F.lit(None).cast("array<double>")
    for s in own:
        pick = F.when(F.col("instrument") == s.name, F.col(s.name)).otherwise(pick)
    return spectrogram_long(rows.select(*keys, *ids, pick.alias("_bins")), [*keys, *ids], "_bins", family)
