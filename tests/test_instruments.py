"""Packing sub-columns into instrument arrays and back."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import instruments as im
from tracelake.operators import quality
from tracelake.sources import exports as ex

COLUMNS = "file string, col_idx int, code string, label string, i_group int, sub_index int, family string, hemisphere string"


def panel(file, order, widths, gap=None):
    """Columns of a file whose instruments come in ``order``; ``gap`` is a (instrument, sub-index) that is missing."""
    at, out = 1, []
    for group, name in enumerate(order, 1):
        for sub in range(1, widths[name] + 1):
            if (name, sub) != gap:
                out.append((file, at, f"I{group}_{sub}", name, group, sub, "fft_spectrogram" if "Spectrogram" in name else "fft_power", "left" if "Left" in name else "right"))
                at += 1
    return out


def lines_of(columns, rows):
    """A file as lines: its labels, its codes and its rows of cells."""
    labels = ",".join(["", *[f'"{c[3]}"' for c in columns]])
    codes = ",".join(["ClockDateTime", *[c[2] for c in columns]])
    return [(columns[0][0], i, t) for i, t in enumerate(["File,x", labels, codes, *rows])]


NAMES = ["FFT Spectrogram, Left Hemisphere", "FFT Spectrogram, Right Hemisphere", "FFT Power, 1 - 4 Hz, Left Hemisphere", "FFT Power, 1 - 4 Hz, Right Hemisphere"]
WIDTHS = dict(zip(NAMES, [40, 40, 1, 1]))


@pytest.fixture(scope="module")
def two_files(spark):
    rng = random.Random(3)
    cell = lambda: rng.choice(["", "0", "nan", f"{rng.random():.4f}", '"off, left"', " 7 "])
    parts = [panel("a", NAMES, WIDTHS), panel("b", NAMES[::-1], WIDTHS, gap=(NAMES[1], 17))]
    text = [line for p in parts for line in lines_of(p, [",".join([str(45000 + r), *[cell() for _ in p]]) for r in range(9)])]
    columns = spark.createDataFrame([c for p in parts for c in p], COLUMNS)
    lines = spark.createDataFrame(text, "file string, line_no long, text string")
    return lines, columns


def test_packing_lines_equals_packing_rows_and_is_undone_exactly(spark, two_files):
    lines, columns = two_files
    layout = im.instrument_layout(columns, ["file"])
    slots = im.cohort_slots(layout)
    assert [(s.width, s.is_array, s.region) for s in slots] == [(1, False, "Left Hemisphere"), (1, False, "Right Hemisphere"), (40, True, "Left Hemisphere"), (40, True, "Right Hemisphere")]
    rows = ex.export_rows(lines)
    packed = im.pack_rows(rows, layout, slots, ["file"])
    direct = im.pack_lines(lines, ex.code_rows(lines), layout, slots)
    text = lambda df: sorted(map(str, df.select("file", "row_idx", "ts", *[s.name for s in slots]).collect()))
    assert text(packed) == text(direct) and packed.count() == 18
    back = {(r["file"], r["row_idx"]): dict(zip(r["codes"], r["values"])) for r in im.unpack_rows(packed, layout, slots, ["file"]).collect()}
    for r in rows.collect():
        assert back[(r["file"], r["row_idx"])] == {c: v for c, v in zip(r["codes"], r["values"]) if c != ex.CLOCK}
        assert list(back[(r["file"], r["row_idx"])]) == r["codes"][1:]
    long = im.long_values(packed, slots, ["file", "row_idx"])
    assert long.count() == sum(v is not None for cells in back.values() for v in cells.values())
    assert long.where("file = 'b' AND sub_index = 17 AND instrument LIKE '%right%'").count() == 0


def test_only_the_instruments_asked_for_are_read(spark, two_files):
    lines, columns = two_files
    layout = im.instrument_layout(columns, ["file"])
    slots = im.cohort_slots(layout.where("instrument LIKE '%power%'"))
    packed = im.pack_lines(lines, ex.code_rows(lines), layout, slots)
    assert packed.columns == ["file", "row_idx", "serial", "ts", *[s.name for s in slots]] and len(slots) == 2


def test_equal_labels_and_missing_labels(spark):
    rows = [("f", i, f"I{g}_1", label, g, 1, "other", "") for i, (g, label) in enumerate([(1, "x"), (2, "x"), (3, ""), (4, "X")], 1)] + [("f", 9, "I1_1", "x", 1, 1, "other", "")]
    layout = im.instrument_layout(spark.createDataFrame(rows, COLUMNS), ["file"])
    assert [(r["instrument"], r["places"]) for r in layout.orderBy("i_group").collect()] == [("x", [1]), ("x__dup2", [2]), ("other_3", [3]), ("x__dup3", [4])]


def test_a_full_panel_stays_narrow(spark):
    widths = {f"FFT Spectrogram {i}, Left Hemisphere": 40 for i in range(60)} | {f"Rhythmicity Spectrogram {i}": 97 for i in range(14)} | {f"FFT Power, {i} - {i + 1} Hz": 1 for i in range(330)}
    columns = panel("p", list(widths), widths)
    assert len(columns) == 4088
    frame = spark.createDataFrame(columns, COLUMNS)
    layout = im.instrument_layout(frame, ["file"])
    slots = im.cohort_slots(layout)
    assert len(slots) == 404
    lines = spark.createDataFrame(lines_of(columns, [",".join([str(45000 + r), *[str(r * i % 97) for i in range(4088)]]) for r in range(5)]), "file string, line_no long, text string")
    packed = im.pack_lines(lines, ex.code_rows(lines), layout, slots)
    assert len(packed.columns) == 408
    totals = im.long_values(packed, slots, ["row_idx"]).groupBy("row_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s")).collect()
    assert {r["row_idx"]: (r["n"], r["s"]) for r in totals} == {r: (4088, float(sum(r * i % 97 for i in range(4088)))) for r in range(5)}


def test_null_rule_and_spectrogram_on_arrays(spark):
    names = NAMES
    columns = spark.createDataFrame(panel("a", names, WIDTHS), COLUMNS)
    layout = im.instrument_layout(columns, ["file"])
    slots = im.cohort_slots(layout)
    rows = [("a", i, [None, *([0.0] * 40 if i in (2, 3) else [float(i + 1)] * 40), *[float(i + 2)] * 40, 0.0 if i in (2, 3) else 1.0, 5.0]) for i in range(8)]
    packed = im.pack_rows(spark.createDataFrame(rows, "file string, row_idx long, values array<double>"), layout, slots, ["file"], ["row_idx"])
    out = quality.null_suppressed_zeros(packed, ["file"], im.null_rule_instruments(slots)).orderBy("row_idx").collect()
    left = next(s.name for s in slots if s.is_array and "left" in s.name)
    assert [r["row_idx"] for r in out if r[left] is None] == [2, 3] and all(r["n_regions"] == 2 for r in out)
    spec = im.family_spectrogram(packed, columns, layout, slots, ["file"], "fft_spectrogram", "right", ids=["row_idx"])
    got = {(r["row_idx"], r["bin"]): (r["freq_hz"], r["value"]) for r in spec.collect()}
    assert len(got) == 320 and got[(3, 40)] == (20.0, 5.0)


def test_sums_within_rows_are_those_of_the_long_form(spark, two_files):
    lines, columns = two_files
    layout = im.instrument_layout(columns, ["file"])
    slots = im.cohort_slots(layout)
    packed = im.pack_lines(lines, ex.code_rows(lines), layout, slots)
    ids = ["file", "row_idx"]
    long = im.long_values(packed, slots, ids).groupBy(*ids, "instrument").agg(F.count(F.lit(1)).alias("n_values"), F.round(F.sum("value"), 6).alias("total"))
    direct = im.instrument_sums(packed, slots, ids).withColumn("total", F.round("total", 6))
    assert sorted(map(str, direct.where("n_values > 0").collect())) == sorted(map(str, long.collect()))
    assert direct.count() == 18 * len(slots) and direct.where("n_values = 0 AND total IS NOT NULL").count() == 0


def test_a_nation_is_exported_as_several_files(spark, monkeypatch):
    from tracelake.plans import catalog_panels as panels

    monkeypatch.setattr(panels, "FILE_KEYS", 60)
    lines = panels.panel_lines(spark, "/root/testdata/sf0.001")
    per = lines.groupBy(panels.nation_of().alias("nation")).agg(F.count_distinct("file").alias("n")).collect()
    assert max(r["n"] for r in per) > 1
    assert ex.code_rows(lines).count() == sum(r["n"] for r in per)
