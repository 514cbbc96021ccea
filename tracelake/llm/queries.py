"""Registered queries of this subpackage: thin bindings of the operators to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Query
from . import fm_index, language, line_windows, minhash, multi_index, packing, phrases, prefix_trie, repair, revisits, token_files, top_k, toxicity
from .common import joined_sha256, stored, table, word_tokenizer_path, work_dir

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer_path())


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=80)


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, word_tokenizer_path())
    files = token_files.read_token_files(spark, path)
    return token_files.with_start(token_files.token_checksums(files), files).select("doc_id", F.col("start"), "n_tokens", "ids_crc32")


_WORDS_2 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op2_benchmark_decontamination", f"""
WITH dw AS (SELECT doc_id, {_WORDS_2} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS_2} AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, unnest([w[i + 1:i + 10] for i in range(0, greatest(len(w) - 9, 1))]) AS win FROM iw WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM iwin),
places AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS pos FROM dw, lens WHERE len(w) >= n),
hits AS (SELECT a.doc_id, a.pos, a.n, i.item_id FROM (SELECT doc_id, pos, n, w[pos + 1:pos + n] AS win FROM places) a JOIN iwin i USING (win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op7_line_windows", """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM docs),
three AS (SELECT *, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
seen AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) AS k FROM three
         WHERE c IS NOT NULL AND (trim(line) <> '' OR trim(b) <> '' OR trim(c) <> '')),
gone AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM seen WHERE k > 1)
SELECT d.doc_id, coalesce(any_value(len(d.l)), 0)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(lines.line, chr(10) ORDER BY lines.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM docs d LEFT JOIN lines USING (doc_id) LEFT JOIN gone g ON g.doc_id = lines.doc_id AND g.pos = lines.pos GROUP BY d.doc_id
""")
def op7_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_windows.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op8_weak_supervision")
def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    voters, coefficients = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, voters, coefficients)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op6_language_backoff")
def op6_language_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = language.identify(docs, language.fit(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op9_sorted_access_top_k", """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, o.vec_id, list_sum([q.c[i] * o.c[i] for i in range(1, 1 + len(q.c))])::BIGINT AS score
      FROM v q JOIN v o ON q.vec_id % 50 = 0 AND o.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op9_sorted_access_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op3_phrase_automata")
def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.drop_repeated_passages(table(spark, sf_dir, "documents"))


_URL_PARTS = r"""'^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^?#]*)(?:\?([^#]*))?'"""


@query("op1_revisit_resolution", f"""
WITH r AS (SELECT 2 * page_id AS id, url, page_id * 60 AS t, md5(html) AS tag, length(html) AS n, page_id AS p FROM pages),
v AS (SELECT 2 * page_id + 1 AS id, url || CASE WHEN contains(url, '#') THEN '' ELSE '#again' END AS url,
             page_id * 60 + CASE WHEN page_id % 7 = 0 THEN -30 ELSE 5400 + 60 * (page_id % 3000) END AS t,
             CASE WHEN page_id % 5 = 0 THEN 'stale' ELSE 'W/' || md5(html) END AS tag, page_id AS p FROM pages),
k AS (SELECT id, t, tag, p, n, regexp_extract(url, {_URL_PARTS}, 1) AS host, regexp_extract(url, {_URL_PARTS}, 2) AS port,
             regexp_extract(url, {_URL_PARTS}, 3) AS path,
             list_sort([x for x in string_split(regexp_extract(url, {_URL_PARTS}, 4), '&')
                        if x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|sessionid|sid)(=|$)')]) AS q
      FROM (SELECT id, url, t, tag, n, p FROM r UNION ALL SELECT id, url, t, tag, NULL, p FROM v)),
u AS (SELECT id, t, tag, p, n, regexp_replace(lower(host), '^www\\.', '') || CASE WHEN port IN (':80', ':443') THEN '' ELSE port END ||
             regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM k),
a AS (SELECT v.id, v.url_key, v.tag, v.p, o.id AS response_id, o.tag AS old_tag, o.n,
             row_number() OVER (PARTITION BY v.id ORDER BY o.t DESC NULLS LAST, o.id DESC) AS k
      FROM (SELECT * FROM u WHERE n IS NULL) v LEFT JOIN (SELECT * FROM u WHERE n IS NOT NULL) o ON o.url_key = v.url_key AND o.t < v.t),
f AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_earlier_response' WHEN regexp_replace(tag, '^W/', '') = old_tag THEN 'resolved'
                     ELSE 'validator_mismatch' END AS outcome FROM a WHERE k = 1)
SELECT id AS record_id, url_key, CASE WHEN outcome = 'resolved' THEN response_id END AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=' || p || '; content-length: ' || n || '; content-type: text/html; etag: ' || tag
            ELSE 'cache-control: max-age=' || p || '; content-length: 0; etag: ' || tag END AS headers,
       CASE WHEN outcome = 'resolved' THEN old_tag END AS payload_digest
FROM f
""")
def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures derived from ``pages``: each page once in full, and once as a revisit, of which a seventh comes too early and a fifth has a stale tag."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("tag"), F.length("html").alias("n"))
    full = pages.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("record_type"), "url", F.timestamp_seconds(60 * F.col("page_id")).alias("captured_at"),
        F.create_map(F.lit("ETag"), "tag", F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("n").cast("string"),
                     F.lit("Cache-Control"), F.lit("no-store")).alias("headers"), F.col("tag").alias("payload_digest"))
    page = F.col("page_id")
    delay = F.when(page % 7 == 0, -30).otherwise(5400 + 60 * (page % 3000))
    again = pages.select(
        (2 * page + 1).alias("record_id"), F.lit("revisit").alias("record_type"),
        F.concat("url", F.when(F.contains("url", F.lit("#")), "").otherwise("#again")).alias("url"), F.timestamp_seconds(60 * page + delay).alias("captured_at"),
        F.create_map(F.lit("etag"), F.when(page % 5 == 0, "stale").otherwise(F.concat(F.lit("W/"), "tag")), F.lit("content-length"), F.lit("0"),
                     F.lit("cache-control"), F.concat(F.lit("max-age="), page.cast("string"))).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    found = revisits.resolve_revisits(full.unionByName(again))
    flat = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return found.withColumn("headers", flat)


def with_shared_heads(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations c rebuilt from the first h turns of conversation c - c % 5 and their own turns after the first h; h = crc32(c) % 9."""
    h = F.crc32(F.col("conv_id").cast("string")) % 9
    heads = turns.where("pos <= 8 AND conv_id % 5 = 0").withColumnRenamed("conv_id", "base")
    of = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h.alias("h"))
    sizes = heads.where("pos = 1").select("base", "n_turns")
    plan = of.join(sizes, "base", "left").select("conv_id", "base", "h", F.least(F.coalesce("n_turns", F.lit(0)), "h").alias("taken"))
    shared = plan.join(heads, "base").where("pos <= h").select("conv_id", "pos", "role", "text")
    own = turns.where(F.col("pos") > h).join(plan.select("conv_id", "h", "taken"), "conv_id")
    return shared.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "role", "text"))


#: CRC-32 (unsigned) of the ASCII text at ``{}``, by the table of bytes.
_CRC_TABLE = """crc_table AS (SELECT list(r ORDER BY v) AS tab FROM (SELECT v.range AS v,
    list_reduce([v.range] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS r FROM range(256) v))"""
_CRC = "xor(list_reduce([4294967295] || [ord(x) for x in string_split({}, '')], lambda x, b: xor(x // 256, tab[xor(x % 256, b) + 1])), 4294967295)"


@query("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base FROM t),
{_CRC_TABLE},
crc AS (SELECT conv_id, base, {_CRC.format("conv_id::VARCHAR")} AS x FROM c, crc_table),
h AS (SELECT conv_id, base, x % 9 AS h FROM crc),
size AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
r AS (SELECT h.conv_id, t.pos, role, text FROM h JOIN t ON t.conv_id = h.base AND t.pos <= h.h
      UNION ALL
      SELECT t.conv_id, t.pos - h.h + least(coalesce(n, 0), h.h), role, text FROM t JOIN h USING (conv_id) LEFT JOIN size ON size.conv_id = h.base WHERE t.pos > h.h),
p AS (SELECT conv_id, pos AS d, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY pos) AS path, max(pos) OVER (PARTITION BY conv_id) AS n FROM r
      UNION ALL SELECT conv_id, 0, '', [], coalesce((SELECT max(pos) FROM r WHERE r.conv_id = c.conv_id), 0) FROM c),
k AS (SELECT *, md5(path::VARCHAR) || d AS node, CASE WHEN d > 0 THEN md5(path[:d - 1]::VARCHAR) || (d - 1) END AS up FROM p),
nodes AS (SELECT node, any_value(up) AS up, any_value(d) AS d, min(conv_id) AS first, count(*) AS n, count(*) FILTER (WHERE d = k.n) AS n_ends,
                 (count(*) - 1) * any_value(strlen(text)) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = k.n), '')) AS ends
          FROM k GROUP BY node),
below AS (SELECT a.node, sum(CASE WHEN o.n = o.n_ends THEN 1 ELSE 0 END) AS leaves, sum(o.w) AS saved
          FROM nodes o JOIN k b ON b.node = o.node AND b.conv_id = o.first JOIN k a ON a.conv_id = b.conv_id AND a.d <= b.d GROUP BY a.node),
kids AS (SELECT up AS node, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up)
SELECT x.first::BIGINT AS conv_id, x.d::BIGINT AS depth, y.first::BIGINT AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x LEFT JOIN nodes y ON y.node = x.up LEFT JOIN kids ON kids.node = x.node JOIN below ON below.node = x.node
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    convs = turns.where("pos = 1").select("conv_id")
    return prefix_trie.prefix_trie(with_shared_heads(turns, convs), convs).drop("hi", "lo")


#: Of state q: the cheapest way on from row ``i``, as (cost, initials, lines); one column per state.
_WAY = """list_sort([x for x in [
    {{'c': w{q}.c + 2, 'a': 'D' || w{q}.a, 'l': w{q}.l}},
    CASE WHEN NOT gone AND keep[{q} + 1] >= 0 THEN {{'c': w[keep[{q} + 1] + 1].c + stays, 'a': 'K' || w[keep[{q} + 1] + 1].a, 'l': [role || ':' || text] || w[keep[{q} + 1] + 1].l}} END,
    CASE WHEN NOT gone THEN {{'c': w{t}.c + 1 + stays, 'a': 'R' || w{t}.a, 'l': ['{to}:' || text] || w{t}.l}} END] if x IS NOT NULL])[1]"""
_INSERTED = "list_sort([x{q}, {{'c': x{t}.c + 5, 'a': 'I' || x{t}.a, 'l': ['{to}:'] || x{t}.l}}])[1]"
_NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def _of_states(pattern: str, name: str) -> str:
    return ", ".join(pattern.format(q=q, t=t, to=to) + f" AS {name}{q}" for q, (t, to) in _NEXT.items())


@query("op11_conversation_repair", f"""
WITH RECURSIVE {_CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS how FROM conversations, crc_table),
dam AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN how = 1 THEN '' WHEN how = 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM src, range(2) k WHERE how <> 0 AND (k.range = 0 OR how = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pre,
               rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dam),
flt AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
               right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM num),
seq AS (SELECT conv_id, i, role, text, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS stays,
               CASE left(role, 1) WHEN 's' THEN [1, -1, -1, -1] WHEN 'u' THEN [2, 2, -1, 2] WHEN 'a' THEN [-1, -1, 3, -1] ELSE [-1, -1, -1, -1] END AS keep FROM flt),
way(conv_id, i, w0, w1, w2, w3) AS (
  SELECT conv_id, max(i) + 1, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}}, {{'c': 10, 'a': 'II', 'l': ['user:', 'assistant:']}}, {{'c': 5, 'a': 'I', 'l': ['assistant:']}},
         {{'c': 0, 'a': '', 'l': []::VARCHAR[]}} FROM seq GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_of_states(_INSERTED, "v")} FROM (
    SELECT conv_id, i, {_of_states(_WAY, "x")} FROM (
      SELECT s.*, w0, w1, w2, w3, [w0, w1, w2, w3] AS w FROM way JOIN seq s ON s.conv_id IS NOT DISTINCT FROM way.conv_id AND s.i = way.i - 1))),
best AS (SELECT conv_id, w0 FROM way WHERE i = 1),
agg AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
               count(*) FILTER (WHERE cut AND NOT blank AND NOT dup) AS truncated,
               count(*) FILTER (WHERE pre IS NOT NULL AND pre || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w0.c, 0)::BIGINT AS cost, coalesce(w0.a, '') AS audit,
       sha256(coalesce(array_to_string(w0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repair.repair(repair.damaged(conversations))
    lines = found.rows.select("conv", "at", "sub", F.concat_ws(":", "role", "text").alias("line"))
    digests = joined_sha256(lines, ["conv"], ["at", "sub"], "line", "\n", "repaired_sha256").withColumnRenamed("conv", "_of")
    out = conversations.select("conv_id").distinct().join(found.summary, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    out = out.join(digests, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op13_multi_index_neighbours")
def op13_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
