"""Join and merge queries."""

from pyspark.sql import functions as F

from ..operators import merge as mg
from ..operators.bins import assign_bins
from ..operators.ordered import join_keys
from .bindings import BIN_OF, EDGES, EP, KEY, epochs, recordings, table
from .registry import query

# Segments: event_id % 3; clock: the hour, so that segments overlap; two columns.
DEDUP = f"""
{EP.strip()},
sgm AS (SELECT patient_id, event_id % 3 AS segment, date_trunc('hour', ts) AS clock, event_id, CASE WHEN channel IN ('click', 'view') THEN value END AS c_a, CASE WHEN channel <> 'click' THEN raw_value END AS c_b FROM ep),
ddp AS (SELECT patient_id, segment, clock, arg_min(struct_pack(a := c_a, b := c_b), event_id) AS s FROM sgm GROUP BY 1, 2, 3),
lng AS (SELECT patient_id, segment, clock, 'c_a' AS col, s.a AS value FROM ddp UNION ALL SELECT patient_id, segment, clock, 'c_b', s.b FROM ddp),
dns AS (SELECT patient_id, segment, col, count(value) AS density FROM lng GROUP BY 1, 2, 3)
"""


def segment_long(spark, sf):
    df = epochs(spark, sf).select(
        "patient_id", (F.col("event_id") % 3).alias("segment"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("clock"), "event_id",
        F.when(F.col("channel").isin("click", "view"), F.col("value")).alias("c_a"), F.when(F.col("channel") != "click", F.col("raw_value")).alias("c_b"))
    first = mg.first_per_clock(df, ["patient_id", "segment"], "clock", "event_id", ["c_a", "c_b"])
    return mg.to_long(first, ["patient_id", "segment", "clock"], ["c_a", "c_b"])


@query("J1_segment_merge", f"""
WITH {DEDUP}, r AS (SELECT l.*, row_number() OVER (PARTITION BY patient_id, clock, col ORDER BY value IS NULL, density DESC, segment) AS k FROM lng l JOIN dns USING (patient_id, segment, col))
SELECT patient_id, clock, col AS "column", value FROM r WHERE k = 1
""")
def merge(spark, sf):
    return mg.merge_segments(segment_long(spark, sf), KEY, "segment", "clock")


@query("J2_merge_by_position", f"""
WITH {EP}, s AS (SELECT patient_id, event_id % 3 AS segment, event_id, ts, value, CASE WHEN event_id % 2 = 0 THEN raw_value END AS half FROM ep),
p AS (SELECT *, row_number() OVER (PARTITION BY patient_id, segment ORDER BY ts, event_id) - 1 AS pos FROM s),
l AS (SELECT patient_id, segment, pos, 'value' AS col, value AS v FROM p UNION ALL SELECT patient_id, segment, pos, 'half', half FROM p),
d AS (SELECT patient_id, segment, col, count(v) AS density FROM l GROUP BY 1, 2, 3),
r AS (SELECT l.*, row_number() OVER (PARTITION BY patient_id, pos, col ORDER BY v IS NULL, density DESC, segment) AS k FROM l JOIN d USING (patient_id, segment, col)),
t AS (SELECT patient_id, unnest(range(count(*))) AS row_idx FROM s GROUP BY 1)
SELECT t.patient_id, t.row_idx, a.v AS value, b.v AS half FROM t LEFT JOIN (FROM r WHERE k = 1 AND col = 'value') a ON a.patient_id = t.patient_id AND a.pos = t.row_idx
 LEFT JOIN (FROM r WHERE k = 1 AND col = 'half') b ON b.patient_id = t.patient_id AND b.pos = t.row_idx
""")
def by_position(spark, sf):
    df = epochs(spark, sf).select("patient_id", (F.col("event_id") % 3).alias("segment"), "event_id", "ts", "value",
                                  F.when(F.col("event_id") % 2 == 0, F.col("raw_value")).alias("half"))
    return mg.merge_by_position(df, KEY, "segment", ["ts", "event_id"], ["value", "half"])


@query("J3_winning_entry", f"""
WITH {DEDUP}, r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, col ORDER BY density DESC, segment) AS k FROM dns)
SELECT patient_id, col AS "column", segment, 'I' || segment || '_' || right(col, 1) AS code, 'family of ' || col AS label FROM r WHERE k = 1
""")
def winner(spark, sf):
    long = segment_long(spark, sf)
    density = mg.segment_density(long, KEY, "segment")
    entries = density.select("patient_id", "segment", "column", F.concat(F.lit("I"), F.col("segment"), F.lit("_"), F.right("column", F.lit(1))).alias("code"),
                             F.concat(F.lit("family of "), F.col("column")).alias("label"))
    return mg.winning_entry(entries, density, KEY, "segment", "column", ["code", "label"])


@query("J4_outcomes", """
SELECT o_orderkey, o_custkey, c_mktsegment AS outcome FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 12
""")
def outcomes(spark, sf):
    c = table(spark, sf, "customer").where(F.col("c_nationkey") < 12).select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("outcome"))
    return mg.attach(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])


@query("J5_column_stats", """
WITH s AS (SELECT l_suppkey AS file_id, l_partkey AS code, count(*) AS n, max(l_quantity) AS top FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2)
SELECT file_id, code, n, top FROM (SELECT DISTINCT l_suppkey AS file_id, l_partkey AS code FROM lineitem) LEFT JOIN s USING (file_id, code)
""")
def column_stats(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_partkey").alias("code"), "l_quantity", "l_linenumber")
    stats = li.where("l_linenumber > 3").groupBy("file_id", "code").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("top"))
    return mg.attach(li.select("file_id", "code").distinct(), stats, ["file_id", "code"])


@query("J6_default_reference", """
WITH ev AS (SELECT o_custkey, min(o_orderdate) AS c_time FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1999-05-05' END, c_time) AS ref FROM customer LEFT JOIN ev ON o_custkey = c_custkey
""")
def default_reference(spark, sf):
    ev = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(F.col("o_orderdate").cast("timestamp_ntz")).alias("c_time"))
    own = F.when(F.col("c_custkey") % 4 == 0, F.lit("1999-05-05 00:00:00").cast("timestamp_ntz"))
    df = table(spark, sf, "customer").select("c_custkey", own.alias("ref"))
    return mg.with_default_reference(df, ev, ["c_custkey"], "ref", "c_time").select("c_custkey", "ref")


@query("J7_bin_assignment", f"WITH {EP} SELECT event_id, {BIN_OF} AS bin_label FROM tl")
def bin_assignment(spark, sf):
    return assign_bins(recordings(spark, sf), EDGES).select("event_id", "bin_label")


@query("J8_study_filter", """
SELECT doc_id, lang, TRUE AS in_study FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL SELECT doc_id, lang, FALSE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def study(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    return mg.members(d, lab.where("quality = 1"), ["doc_id"]).withColumn("in_study", F.lit(True)).union(
        mg.orphans(d, lab, ["doc_id"]).withColumn("in_study", F.lit(False)))


@query("J9_prefix_join", """
WITH f AS (SELECT p_size || '_' || (p_partkey % 7) || '_' || p_partkey AS name, p_partkey FROM part), i AS (SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation UNION ALL SELECT n_nationkey || '_3' FROM nation)
SELECT p_partkey, id FROM f JOIN i ON name = id OR starts_with(name, id || '_')
""")
def prefix(spark, sf):
    s = lambda c: c.cast("string")
    f = table(spark, sf, "part").select("p_partkey", F.concat(s(F.col("p_size")), F.lit("_"), s(F.col("p_partkey") % 7), F.lit("_"), s(F.col("p_partkey"))).alias("name"))
    n = table(spark, sf, "nation")
    ids = n.select(s(F.col("n_nationkey")).alias("id")).union(n.select(F.concat(s(F.col("n_nationkey")), F.lit("_3"))))
    return mg.prefix_matches(f, ids, "name", "id").select("p_partkey", "id")


@query("J10_best_run", """
WITH r AS (SELECT o_custkey AS patient_id, o_orderkey AS run_id, (o_orderstatus = 'F')::INT AS ctx, (o_totalprice <= 300000)::INT AS fits, -(o_orderkey % 5) AS gaps, o_orderdate AS mtime FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY ctx DESC, fits DESC, gaps DESC, mtime DESC, run_id DESC) AS rn FROM r)
SELECT patient_id, run_id, ctx AS has_context FROM k WHERE rn = 1
""")
def best_run(spark, sf):
    r = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").cast("int").alias("has_context"),
        (F.col("o_totalprice") <= 300000).cast("int").alias("fits"), (-(F.col("o_orderkey") % 5)).alias("gaps"), F.col("o_orderdate").alias("mtime"))
    best = mg.best_run(r, KEY, [F.col(c) for c in ("has_context", "fits", "gaps", "mtime", "run_id")])
    return best.select("patient_id", "run_id", "has_context")
