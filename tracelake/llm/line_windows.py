"""Removing lines that repeat in windows of three, with DataFrame expressions only.

Every run of ``window`` consecutive lines of a text is hashed (two 64-bit hashes). A
window that occurs more than once in the whole table keeps its first occurrence, by
(id, hash of the text, line number); the lines of every later one are removed. Windows
are judged on the input, and overlapping ones are merged to spans of lines.

Windows are counted with map-side combine and joined back on their hash, so adaptive
execution splits a window that a large share of all documents have. A document's own
later windows come together in one row, which is bounded by its text.

Defined cases: lines end at ``\\n`` and are compared as they are; windows of blank lines
only do not count; a text of fewer lines than a window is left alone; null text stays null
and has no lines; null ids come first; rows of one id and one text share their result,
so repeated rows are kept as often as they come; other columns are passed on, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _window_hashes(lines: Column, window: int) -> Column:
    """(h, g, blank) of every window; two hashes of each line are taken first, then windows of them."""
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(window), x).alias("g"), (F.trim(x) == "").alias("blank")))
    last = F.size(lines) - window
    at = lambda i, k, name: F.get(F.col("_hashed"), i + F.lit(k))[name]
    return hashed, F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(
        F.xxhash64(*[at(i, k, "h") for k in range(window)]).alias("h"), F.xxhash64(*[at(i, k, "g") for k in range(window)]).alias("g"),
        F.forall(F.slice(F.col("_hashed"), i + F.lit(1), window), lambda x: x["blank"]).alias("blank"))))


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(_id, _text_hash, starts): sorted first line numbers of the windows that occurred earlier, for texts that have any."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), _lines(text_col).alias("_lines"))
    hashed, windows = _window_hashes(F.col("_lines"), window)
    each = (rows.withColumn("_hashed", hashed).select("_id", "_text_hash", F.posexplode(windows).alias("pos", "w")).where("not w.blank")
            .select("_id", "_text_hash", "pos", "w.h", "w.g"))
    place = F.struct("_id", "_text_hash", "pos")
    first = each.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = each.join(first, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("_id", "_text_hash").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def _kept(lines: Column, starts: Column, window: int) -> Column:
    """Lines outside the merged windows: the slices before, between and after the runs of ``starts``."""
    apart = lambda i: F.get(starts, i) > F.get(starts, i - 1) + F.lit(window - 1)
    heads = F.filter(starts, lambda x, i: (i == 0) | apart(i))
    tails = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | apart(i + 1))
    begin = F.concat(F.array(F.lit(0)), F.transform(tails, lambda x: x + F.lit(window)))
    end = F.concat(heads, F.array(F.size(lines)))
    return F.flatten(F.zip_with(begin, end, lambda b, e: F.slice(lines, b + F.lit(1), e - b)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with shortened texts, and the columns ``n_lines`` and ``n_removed`` (long) at the end."""
    starts = later_windows(docs, id_col, text_col, window)
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(id_col).alias("_own_id"), F.xxhash64(text_col).alias("_own_hash"))
    rows = own.join(starts, (F.col("_own_hash") == F.col("_text_hash")) & F.col("_own_id").eqNullSafe(F.col("_id")), "left")
    rows = rows.select("_row", "starts", F.split(F.col(f"_row.`{text_col}`"), "\n", -1).alias("_lines"))
    rows = rows.withColumn("_kept", F.when(F.col("starts").isNull(), F.col("_lines")).otherwise(_kept(F.col("_lines"), F.col("starts"), window)))
    n = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    text = F.when(F.col("starts").isNull(), F.col(f"_row.`{text_col}`")).otherwise(F.concat_ws("\n", "_kept"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in names],
                       n("_lines").alias("n_lines"), (n("_lines") - n("_kept")).alias("n_removed"))
