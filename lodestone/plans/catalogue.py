"""Registered queries on the driver's tables, each with DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compile as compiled
from ..operators import chart, extract, graph, index, overlap, records, search, spans, structure, taxonomy, trees, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    """Registers a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Search -------------------------------------------------------------------------------------------------------

TERMS = ["the", "thing", "and", "zzzz", "idiot", "license"]
_BM25 = """
WITH d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]+') f, regexp_extract_all(lower(text), '[a-z]+') b FROM documents),
s AS (SELECT count(*) n, avg(len(f) + len(b)) a FROM d),
q AS (SELECT unnest(['the','thing','and','zzzz','idiot','license']) term),
tf AS (SELECT doc_id, lang, source, term, len(list_filter(f, lambda x: x = term)) tff, len(list_filter(b, lambda x: x = term)) tfb, len(f) + len(b) l FROM d, q),
df AS (SELECT term, count(*) FILTER (WHERE tff + tfb > 0) df FROM tf GROUP BY term),
sc AS (SELECT doc_id, lang, source, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
  * ({w} * tff + tfb) * 2.2 / (({w} * tff + tfb) + 1.2 * (0.25 + 0.75 * l / a))) score
  FROM tf JOIN df USING (term), s WHERE tff + tfb > 0 {scope} GROUP BY doc_id, lang, source)
"""


def _bm25(docs: DataFrame, weight: float, scope: Column | None = None) -> DataFrame:
    focus, body = X.tokens(F.substring_index("text", "\n", 1)), X.tokens(F.col("text"))
    return index.bm25(docs, "doc_id", focus, body, TERMS, weight, scope)


@_query(_BM25.format(w="8.0", scope="") + "SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, doc_id LIMIT 60")
def bm25_search(spark, d):
    return _bm25(_t(spark, d, "documents"), 8.0).withColumn("score", _r6("score")).orderBy(F.desc("score"), "doc_id").limit(60)


@_query(_BM25.format(w="2.0", scope="AND lang = 'en' AND source <> 'src0'") + "SELECT doc_id, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, doc_id LIMIT 60")
def bm25_filtered_scope(spark, d):
    scored = _bm25(_t(spark, d, "documents"), 2.0, (F.col("lang") == "en") & (F.col("source") != "src0"))
    return scored.withColumn("score", _r6("score")).orderBy(F.desc("score"), "doc_id").limit(60)


@_query("SELECT term FROM (SELECT unnest(['the','thing','and','zzzz','idiot','license','qqqq']) term) q WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'fr' AND list_contains(regexp_extract_all(lower(text), '[a-z]+'), term))")
def unmatched_terms(spark, d):
    return index.unmatched([*TERMS, "qqqq"], _t(spark, d, "documents"), X.tokens(F.col("text")), F.col("lang") == "fr")


_COS = "list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@_query(f"SELECT v.vec_id AS evidence, round({_COS}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE v.label <> 3 ORDER BY round({_COS}, 6) DESC, v.vec_id LIMIT 20")
def dense_knn(spark, d):
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id = 7").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return vectors.knn(v, q, F.col("vec_id"), 20, F.col("label") != 3).withColumn("score", _r6("score"))


@_query(f"""WITH r AS (SELECT v.vec_id // 4 AS evidence, q.vec_id q, max({_COS}) score FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id IN (3, 11, 40)) q GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, evidence) n FROM r)
SELECT evidence, round(max(score), 6) AS score FROM n WHERE n <= 31 GROUP BY evidence ORDER BY max(score) DESC, evidence LIMIT 30""")
def dense_multi_window(spark, d):
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id in (3, 11, 40)").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return vectors.knn(v, q, F.floor(F.col("vec_id") / 4), 30).withColumn("score", _r6("score"))


@_query(_BM25.format(w="8.0", scope="") + """, a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) rank FROM sc QUALIFY rank <= 60),
b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) rank FROM documents QUALIFY rank <= 60)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, count(*) AS channels FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def rrf_fusion(spark, d):
    docs = _t(spark, d, "documents")
    a = search.ranked(_bm25(docs, 8.0).withColumn("score", _r6("score")), [F.desc("score"), F.col("doc_id")], 60)
    b = search.ranked(docs.select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 60)
    return search.fuse([a, b], "doc_id").withColumn("rrf", _r6("rrf"))


@_query("""WITH c AS (SELECT o_orderkey, 'status' feature, o_orderstatus v FROM orders UNION ALL SELECT o_orderkey, 'priority', CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END FROM orders
UNION ALL SELECT o_orderkey, 'size', CAST(floor(o_totalprice / 50000) AS BIGINT)::VARCHAR FROM orders)
SELECT o_orderkey, sum((v = e)::BIGINT)::BIGINT AS n_matched, count(*) AS n_known, round(sum((v = e)::BIGINT)::DOUBLE / count(*), 6) AS score
FROM c JOIN (VALUES ('status', 'F'), ('priority', '1-URGENT'), ('size', '3')) r(feature, e) USING (feature) WHERE v IS NOT NULL GROUP BY o_orderkey HAVING sum((v = e)::BIGINT) > 0""")
def structural_match(spark, d):
    o = _t(spark, d, "orders")
    cells = F.array(F.struct(F.lit("status").alias("feature"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("feature"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("value")), F.struct(F.lit("size").alias("feature"), F.floor(F.col("o_totalprice") / 50000).cast("string").alias("value")))
    request = spark.createDataFrame([("status", "F"), ("priority", "1-URGENT"), ("size", "3")], "feature string, value string")
    return structure.scored_cells(o.select("o_orderkey", F.inline(cells)), request, "o_orderkey").withColumn("score", _r6("score"))


@_query("""WITH l AS (SELECT l_orderkey k, list_sort(list(l_linenumber)) nos, list_sort(list(DISTINCT l_returnflag)) flags FROM lineitem GROUP BY 1),
m AS (SELECT o_orderkey, o_orderstatus = 'O' a, CASE WHEN o_orderkey % 7 <> 0 THEN nos = [1, 2] END b, CASE WHEN k IS NOT NULL THEN list_contains(flags, 'N') END c FROM orders LEFT JOIN l ON o_orderkey = k)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN a THEN 'status' END, CASE WHEN b THEN 'line_positions' END, CASE WHEN c THEN 'flags' END], lambda x: x IS NOT NULL), ',') AS matched,
array_to_string(list_filter([CASE WHEN NOT a THEN 'status' END, CASE WHEN NOT b THEN 'line_positions' END, CASE WHEN NOT c THEN 'flags' END], lambda x: x IS NOT NULL), ',') AS different,
(CASE WHEN a IS NULL THEN 1 ELSE 0 END + CASE WHEN b IS NULL THEN 1 ELSE 0 END + CASE WHEN c IS NULL THEN 1 ELSE 0 END)::INTEGER AS n_unknown,
round((coalesce(a, false)::INT + coalesce(b, false)::INT + coalesce(c, false)::INT)::DOUBLE / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT), 6) AS score FROM m WHERE a OR b OR c""")
def structural_labels(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("nos"), F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    x = _t(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("nos", F.when(F.col("o_orderkey") % 7 != 0, F.col("nos")))
    ints = F.array(F.lit(1), F.lit(2)).cast(x.schema["nos"].dataType)
    got = structure.scored(x, "o_orderkey", {
        "status": structure.compare(F.lit("O"), F.col("o_orderstatus"), "status", "text"),
        "line_positions": structure.compare(ints, F.col("nos"), "line_positions", "list"),
        "flags": structure.compare(F.array(F.lit("N")), F.col("flags"), "flags", "list"),
    })
    return got.select("o_orderkey", F.array_join("matched", ",").alias("matched"), F.array_join("different", ",").alias("different"), F.size("unknown").alias("n_unknown"), _r6("score").alias("score"))


@_query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(lower(text)) ORDER BY doc_id) n FROM documents) WHERE n = 1")
def group_dedupe_first(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", X.digest(F.lower("text")).alias("h"))
    return docs.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("x")).select("x.*")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def event_group_exclusion(spark, d):
    o = _t(spark, d, "orders")
    return search.exclude_groups(o.select("o_orderkey", "o_custkey"), "o_custkey", o.where("o_totalprice > 400000"))


@_query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 3 END AS tier,
row_number() OVER (ORDER BY CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 3 END, n_chars DESC, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id) ORDER BY place LIMIT 100""")
def tier_sort(spark, d):
    x = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id", "left")
    tier = search.tier((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 1, F.col("quality") == 0)
    ranked = search.ranked(x.withColumn("tier", tier), [F.col("tier"), F.desc("n_chars"), F.col("doc_id")], 100)
    return ranked.select("doc_id", "tier", F.col("rank").cast("long").alias("place"))


@_query("""WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) n FROM conversations),
r AS (SELECT conv_id, turn, n, size, size <= 600 taken, CASE WHEN size <= 600 THEN size ELSE 0 END used, CASE WHEN size <= 600 THEN 1 ELSE 0 END k FROM c WHERE n = 1
UNION ALL SELECT c.conv_id, c.turn, c.n, c.size, r.k < 3 AND r.used + c.size <= 600, r.used + CASE WHEN r.k < 3 AND r.used + c.size <= 600 THEN c.size ELSE 0 END, r.k + CASE WHEN r.k < 3 AND r.used + c.size <= 600 THEN 1 ELSE 0 END FROM r JOIN c ON c.conv_id = r.conv_id AND c.n = r.n + 1)
SELECT conv_id, turn, CAST(size AS BIGINT) AS size, taken, CAST(used AS BIGINT) AS used FROM r""")
def budget_pack(spark, d):
    return search.packed(_t(spark, d, "conversations"), "conv_id", ["turn"], F.char_length("text"), 3, 600)


@_query("SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS pos, (SELECT count(*) > 150 FROM part) AS has_more, CASE WHEN (SELECT count(*) > 150 FROM part) THEN 150 END AS next_offset FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def page_offset(spark, d):
    return search.page(_t(spark, d, "part").select("p_partkey"), ["p_partkey"], 100, 50).withColumn("pos", F.col("pos").cast("long"))


@_query("SELECT doc_id, substr(text, 201, 300) AS part, length(text) > 500 AS has_more FROM documents")
def char_paging(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.char_page(F.col("text"), 200, 300).alias("part"), (F.char_length("text") > 500).alias("has_more"))


# Trees and topics ---------------------------------------------------------------------------------------------


@_query("SELECT n_name AS title, n_regionkey AS parent, count(c_custkey) AS n_evidence FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def topic_counts(spark, d):
    topics = _t(spark, d, "nation").select(F.col("n_nationkey").alias("topic"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("title"))
    return taxonomy.counts(topics, _t(spark, d, "customer").select(F.col("c_nationkey").alias("topic"))).select("title", "parent", "n_evidence")


_NODES = "SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


def _edges(spark, d) -> list[DataFrame]:
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = _t(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return [n, s]


@_query(f"WITH t AS ({_NODES}) SELECT node, parent, (SELECT count(*) FROM t c WHERE c.parent = t.node) AS n_children FROM t")
def outline_children(spark, d):
    roots = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    for e in _edges(spark, d):
        roots = roots.unionByName(e.withColumnRenamed("child", "node"))
    return trees.children(roots, "node", "parent")


@_query(f"WITH RECURSIVE t AS ({_NODES}), c AS (SELECT parent AS ancestor, node AS descendant, 1 AS distance FROM t WHERE parent IS NOT NULL UNION ALL SELECT t.parent, c.descendant, c.distance + 1 FROM c JOIN t ON t.node = c.ancestor WHERE t.parent IS NOT NULL) SELECT ancestor, descendant, distance FROM c")
def outline_closure(spark, d):
    return trees.closure(_edges(spark, d)).select("ancestor", "descendant", "distance")


# A small alias table for the driver's invented languages.
ALIASES = {"en/article": ["the ", "and "], "en/verb": ["tion", "ing"], "de/article": ["der ", "die "], "de/noun": ["heit", "keit"], "fr/article": ["les ", "une "], "es/article": ["los ", "que "]}
_HITS = " UNION ALL ".join(f"SELECT doc_id, '{t}' topic, " + " + ".join(f"CASE WHEN contains(lower(text), '{a}') THEN {len(a)} ELSE 0 END" for a in own) + " score FROM documents" for t, own in ALIASES.items())


@_query(f"""WITH h AS (SELECT * FROM ({_HITS}) WHERE score > 0), t AS (SELECT doc_id, string_agg(topic || ':' || score, ',' ORDER BY score DESC, topic) topics FROM h GROUP BY doc_id),
r AS (SELECT doc_id, string_agg(root, ',' ORDER BY s DESC, root) roots FROM (SELECT doc_id, split_part(topic, '/', 1) root, sum(score) s FROM h GROUP BY 1, 2) GROUP BY doc_id)
SELECT doc_id, coalesce(topics, '') AS topics, coalesce(roots, '') AS roots FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN r USING (doc_id)""")
def classify_keywords(spark, d):
    x = _t(spark, d, "documents").select("doc_id", taxonomy.matches(F.col("text"), ALIASES).alias("m"))
    return x.select("doc_id", F.array_join(F.transform("m", lambda s: F.concat_ws(":", s["topic"], s["score"])), ",").alias("topics"), F.array_join(taxonomy.roots(F.col("m")), ",").alias("roots"))


@_query("SELECT doc_id, source, CASE WHEN contains(lower(source), 'src1') THEN 'one' WHEN contains(lower(source), 'src') THEN 'other' END AS route FROM documents")
def archive_route(spark, d):
    return taxonomy.routed(_t(spark, d, "documents").select("doc_id", "source"), "source", [("src", "other", 1), ("src1", "one", 2)], "route")


# Text ---------------------------------------------------------------------------------------------------------

_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\s*_`\\\\]+', ' ', 'g'))"


@_query(f"SELECT page_id, sha256({_PLAIN}) AS plain_sha256, length({_PLAIN}) AS n_plain FROM pages")
def text_plain(spark, d):
    return _t(spark, d, "pages").select("page_id", X.digest(X.plain(F.col("html"))).alias("plain_sha256"), F.char_length(X.plain(F.col("html"))).cast("long").alias("n_plain"))


@_query("""SELECT conv_id, turn, replace(array_to_string(regexp_extract_all(regexp_replace(lower(text), '([^\\pL\\pN_])', '\\1\\1', 'g'), '(?:^|[^\\pL\\pN_])((?:the|de|der) +(?:and|of|und|la|que))(?:$|[^\\pL\\pN_])', 1), '|'), '  ', ' ') AS phrases FROM conversations""")
def negation_terms(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.negated(F.col("text"), ["the", "de", "der"], ["and", "of", "und", "la", "que"]), "|").alias("phrases"))


@_query("""SELECT doc_id, i * 448 AS "start", least(i * 448 + 512, length(text)) AS "end" FROM (SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - 64) / 448.0) AS BIGINT), 1))) i FROM documents)""")
def text_windows(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.inline(spans.windows(F.col("text"), 512, 64)))
    return x.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n FROM documents),
r AS (SELECT doc_id, n, 0 chunk, CASE WHEN length(line) >= 1100 THEN 0 ELSE length(line) END size, length(line) >= 1100 f FROM l WHERE n = 1
UNION ALL SELECT l.doc_id, l.n, r.chunk + r.f::INT, CASE WHEN r.size + length(line) >= 1100 THEN 0 ELSE r.size + length(line) END, r.size + length(line) >= 1100 FROM r JOIN l ON l.doc_id = r.doc_id AND l.n = r.n + 1)
SELECT doc_id, chunk, count(*) AS n_lines FROM r GROUP BY doc_id, chunk""")
def chunk_by_size(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.explode(spans.chunks(F.split("text", "\n"), 1100)).alias("chunk"))
    return x.groupBy("doc_id", "chunk").agg(F.count("*").alias("n_lines"))


@_query("SELECT doc_id, n_lines, n_blank, sha256(a) AS first_sha256 FROM (SELECT doc_id, len(string_split(text, chr(10))) n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) n_blank, split_part(text, chr(10), 1) a FROM documents WHERE NOT regexp_matches(text, '[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AND right(text, 1) <> chr(10))")
def line_split(spark, d):
    x = _t(spark, d, "documents").select("doc_id", X.split_lines(F.col("text")).alias("l"))
    return x.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.size(F.filter("l", lambda v: F.trim(v) == "")).cast("long").alias("n_blank"), X.digest(F.get("l", F.lit(0))).alias("first_sha256"))


# Spans --------------------------------------------------------------------------------------------------------

_DAYS = "SELECT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) s, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30 e FROM orders"
_MERGED = f"""WITH o AS ({_DAYS}), a AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM o),
b AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) g FROM a), m AS (SELECT o_custkey, min(s) s, max(e) e FROM b GROUP BY o_custkey, g) """


def _days(spark, d) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return _t(spark, d, "orders").select("o_custkey", day.alias("s"), (day + 30).alias("e"))


@_query(_MERGED + "SELECT o_custkey, s, e FROM m")
def span_merge(spark, d):
    return spans.merged(_days(spark, d), ["o_custkey"], "s", "e", peers=False)


@_query(_MERGED + "SELECT * FROM (SELECT o_custkey, e AS gap_start, lead(s) OVER (PARTITION BY o_custkey ORDER BY s) AS gap_end FROM m) WHERE gap_end IS NOT NULL")
def coverage_gaps(spark, d):
    return spans.gaps(_days(spark, d), ["o_custkey"], "s", "e")


@_query("""WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) s FROM events)
SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'purchase' AND b.event_type = 'click' AND a.s - 3600 <= b.s + 3600 AND b.s <= a.s""")
def interval_overlap(spark, d):
    e = _t(spark, d, "events").withColumn("s", F.unix_timestamp("ts"))
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a_id"), (F.col("s") - 3600).alias("a_start"), F.col("s").alias("a_end"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("b_id"), F.col("s").alias("b_start"), (F.col("s") + 3600).alias("b_end"))
    return spans.overlapping(a, b, ["user_id"], 7200).select("user_id", "a_id", "b_id")


@_query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events")
def carry_forward(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return spans.carried(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id")), "last_click").select("event_id", "last_click")


@_query("""WITH u AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) d FROM events), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) g FROM u)
SELECT user_id, min(d) AS "start", max(d) AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def islands(spark, d):
    e = _t(spark, d, "events").select("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("d"))
    return spans.islands(e, ["user_id"], "d")


# Records ------------------------------------------------------------------------------------------------------


@_query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 3 AS INTEGER) AS part FROM documents")
def hash_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", records.hash_split(F.col("doc_id"), 3).alias("part"))


@_query("SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents) WHERE place <= 12")
def capped_sample(spark, d):
    return records.capped_sample(_t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 12).withColumn("place", F.col("place").cast("long"))


@_query(_BM25.format(w="8.0", scope="") + ", a AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) rank FROM sc QUALIFY rank <= 60) SELECT CAST(rank <= 20 AS BOOLEAN) AS top, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM a LEFT JOIN labels USING (doc_id) GROUP BY 1")
def eval_hit_rate(spark, d):
    top = search.ranked(_bm25(_t(spark, d, "documents"), 8.0).withColumn("score", _r6("score")), [F.desc("score"), F.col("doc_id")], 60)
    x = F.broadcast(top).join(_t(spark, d, "labels"), "doc_id", "left")
    return x.groupBy((F.col("rank") <= 20).alias("top")).agg(F.count("*").alias("n"), _r6(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).alias("hit_rate"))


@_query("SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentiles(spark, d):
    p95 = F.expr("percentile_disc(0.95) within group (order by value)")
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), _r6(F.median("value")).alias("p50"), _r6(p95).alias("p95"))


@_query("SELECT l_orderkey AS reference, count(*) AS n_targets, count(*) FILTER (WHERE coalesce(p_retailprice < 1500, false)) AS n_approved, bool_and(coalesce(p_retailprice < 1500, false)) AS ok FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
def reference_resolution(spark, d):
    refs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("reference"), F.col("l_partkey").alias("target"))
    targets = _t(spark, d, "part").select(F.col("p_partkey").alias("target"), (F.col("p_retailprice") < 1500).alias("approved"))
    return trees.resolved(refs, targets, "approved")


@_query("SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'noise' END, CASE WHEN n_chars % 2 = 0 AND quality = 1 THEN 'eligible' END, 'pending') AS status FROM documents LEFT JOIN labels USING (doc_id)")
def quality_gate(spark, d):
    x = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id", "left")
    status = records.effective(F.when(F.col("quality") == 0, "noise"), F.when(F.col("quality") == 1, "eligible"), F.col("n_chars") % 2 == 0)
    return x.select("doc_id", status.alias("status"))


@_query("SELECT coalesce(d.doc_id, b.item_id) AS doc_id, sha256(coalesce(b.text, d.text)) AS text_sha256, sha256(d.text) AS base_sha256, b.item_id IS NOT NULL AS reviewed FROM documents d FULL JOIN benchmark b ON d.doc_id = b.item_id")
def overlay_latest(spark, d):
    x = records.overlaid(_t(spark, d, "documents").select("doc_id", "text"), _t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id", "text", "base_sha256")
    return x.select("doc_id", X.digest(F.col("text")).alias("text_sha256"), "base_sha256", "reviewed")


@_query("SELECT coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS change FROM (SELECT doc_id k, sha256(text) h FROM documents) o FULL JOIN (SELECT item_id k, sha256(text) h FROM benchmark UNION ALL SELECT doc_id + 100, sha256(text) FROM documents WHERE doc_id >= 300) n ON o.k = n.k")
def incremental_changes(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", X.digest(F.col("text")).alias("h"))
    old = docs.select(F.col("doc_id").alias("k"), "h")
    new = _t(spark, d, "benchmark").select(F.col("item_id").alias("k"), X.digest(F.col("text")).alias("h")).unionByName(docs.where("doc_id >= 300").select((F.col("doc_id") + 100).alias("k"), "h"))
    return records.changes(old, new, "k", "h")


@_query("SELECT sha256(string_agg(sha256(n_name), '' ORDER BY n_nationkey)) AS corpus_hash FROM nation")
def canonical_hash(spark, d):
    return records.corpus_hash(_t(spark, d, "nation"), F.col("n_nationkey"), F.col("n_name"))


@_query("SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([CASE WHEN NOT coalesce(o_totalprice < 300000, false) THEN 'price' END, CASE WHEN NOT coalesce(o_orderstatus IN ('F', 'O'), false) THEN 'status' END]) rule FROM orders) WHERE rule IS NOT NULL")
def constraint_violations(spark, d):
    return records.violations(_t(spark, d, "orders"), "o_orderkey", {"price": F.col("o_totalprice") < 300000, "status": F.col("o_orderstatus").isin("F", "O")})


@_query("SELECT conv_id, max(turn) + 1 - count(DISTINCT turn) AS n_missing FROM conversations GROUP BY conv_id")
def missing_turns(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn")
    want = c.groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("turn"))
    return want.join(c.distinct(), ["conv_id", "turn"], "left").join(c.distinct().withColumn("_h", F.lit(1)), ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.count_if(F.col("_h").isNull()).alias("n_missing"))


# Charts -------------------------------------------------------------------------------------------------------


def casts(spark, d, *others: str) -> DataFrame:
    """One cast for each order: base-4 digits of its key, month branch and day of its date; and other columns of it."""
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(
        k.alias("chart_id"),
        F.array(*((F.floor(k / 4**i) % 4).cast("int") for i in range(6))).alias("v"),
        ((F.month("o_orderdate") + 1) % 12).cast("int").alias("month"),
        ((F.unix_date(F.to_date("o_orderdate")) + 17) % 60).cast("int").alias("day"),
        *others,
    )


_LINES = """WITH c AS (SELECT o_orderkey id, [CAST((o_orderkey // CAST(pow(4, i) AS BIGINT)) % 4 AS INT) for i in range(6)] v, (month(o_orderdate) + 1) % 12 m, (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 17) % 60 d FROM orders),
k AS (SELECT *, CAST(list_sum([(v[i + 1] % 2) << i for i in range(6)]) AS INT) code, CAST(list_sum([(CASE WHEN v[i + 1] IN (0, 3) THEN 1 ELSE 0 END) << i for i in range(6)]) AS INT) mask FROM c),
p AS (SELECT b, [0, 1, 3, 7, 15, 31, 23, 16][s + 1] ms, [6, 1, 2, 3, 4, 5, 4, 3][s + 1] shi, s, substr('土木水金土火木金', b + 1, 1) pe FROM range(8) t(b), range(8) u(s)),
h AS (SELECT CAST(xor(b | (b << 3), ms) AS INT) code, s, shi, b, strpos('木火土金水', pe) - 1 pe FROM p),
j AS (SELECT k.*, xor(k.code, k.mask) chg, h.s stage, h.shi, (h.shi + 2) % 6 + 1 ying, h.b pb, h.pe FROM k JOIN h USING (code)),
x AS (SELECT *, substr('未巳卯丑亥酉子寅辰午申戌寅辰午申戌子巳卯丑亥酉未辰午申戌子寅卯丑亥酉未巳丑亥酉未巳卯子寅辰午申戌', (CASE WHEN pos <= 3 THEN code & 7 ELSE code >> 3 END) * 6 + pos, 1) br,
substr('未巳卯丑亥酉子寅辰午申戌寅辰午申戌子巳卯丑亥酉未辰午申戌子寅卯丑亥酉未巳丑亥酉未巳卯子寅辰午申戌', (CASE WHEN pos <= 3 THEN chg & 7 ELSE chg >> 3 END) * 6 + pos, 1) nb,
substr('未巳卯丑亥酉子寅辰午申戌寅辰午申戌子巳卯丑亥酉未辰午申戌子寅卯丑亥酉未巳丑亥酉未巳卯子寅辰午申戌', pb * 6 + pos, 1) ub FROM j, range(1, 7) r(pos)),
y AS (SELECT *, strpos('子丑寅卯辰巳午未申酉戌亥', br) - 1 bi, strpos('子丑寅卯辰巳午未申酉戌亥', nb) - 1 ni, strpos('子丑寅卯辰巳午未申酉戌亥', ub) - 1 ui FROM x),
z AS (SELECT *, [4, 2, 0, 0, 2, 1, 1, 2, 3, 3, 2, 4] el FROM y),
l AS (SELECT *, v[pos] IN (0, 3) moving, ['兄弟', '子孙', '妻财', '官鬼', '父母'][(el[bi + 1] - pe + 5) % 5 + 1] rel, ['兄弟', '子孙', '妻财', '官鬼', '父母'][(el[ni + 1] - pe + 5) % 5 + 1] nrel,
['兄弟', '子孙', '妻财', '官鬼', '父母'][(el[ui + 1] - pe + 5) % 5 + 1] urel, (d % 12 - d % 10 + 12) % 12 vs, ['青龙', '朱雀', '勾陈', '螣蛇', '白虎', '玄武'][([0, 0, 1, 1, 2, 3, 4, 4, 5, 5][d % 10 + 1] + pos - 1) % 6 + 1] spirit FROM z),
q AS (SELECT *, bi IN ((vs + 10) % 12, (vs + 11) % 12) void, (bi - m + 12) % 12 = 6 mb, (bi - d % 12 + 12) % 12 = 6 dc, NOT list_contains(list(rel) OVER (PARTITION BY id), urel) hidden FROM l)
"""


@_query(_LINES + "SELECT id AS chart_id, pos AS position, br AS branch, rel AS relative, moving, nb AS new_branch, nrel AS new_relative, spirit, void, mb AS month_break, dc AS day_clash, pos = shi AS is_shi, pos = ying AS is_ying FROM q")
def chart_derive(spark, d):
    x = chart.lines(casts(spark, d))
    return x.select("chart_id", F.col("position").cast("long").alias("position"), chart.branch_name(F.col("branch")).alias("branch"), "relative", "moving", chart.branch_name(F.col("new_branch")).alias("new_branch"), "new_relative", "spirit", "void", "month_break", "day_clash", "is_shi", "is_ying")


@_query(_LINES + "SELECT id AS chart_id, pos AS position, ub AS hidden_branch, urel AS hidden_relative FROM q WHERE hidden")
def chart_hidden(spark, d):
    x = chart.lines(casts(spark, d)).where("hidden")
    return x.select("chart_id", F.col("position").cast("long").alias("position"), chart.branch_name(F.col("pure_branch")).alias("hidden_branch"), F.col("pure_relative").alias("hidden_relative"))


@_query(_LINES + "SELECT id AS chart_id, pos AS position, br || nb IN ('寅卯','巳午','申酉','亥子','丑辰','辰未','未戌','戌丑') AS advance, nb || br IN ('寅卯','巳午','申酉','亥子','丑辰','辰未','未戌','戌丑') AS retreat FROM q WHERE moving")
def chart_transform(spark, d):
    return chart.lines(casts(spark, d)).where("moving").select("chart_id", F.col("position").cast("long").alias("position"), "advance", "retreat")


def _positions(flag: str, name: str) -> str:
    return f"coalesce(string_agg(CASE WHEN {flag} THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos), '') AS {name}"


@_query(_LINES + f"SELECT id AS chart_id, {_positions('moving', 'moving_positions')}, {_positions('void', 'void_positions')}, {_positions('mb', 'month_break_positions')}, {_positions('dc', 'day_clash_positions')}, {_positions('hidden', 'hidden_positions')}, max(CASE WHEN pos = shi THEN rel END) AS shi_relative, max(CASE WHEN pos = ying THEN rel END) AS ying_relative, bool_and(pos > 3 OR (bi - list_extract(bs, pos + 3) + 12) % 12 = 6) AS six_clash FROM (SELECT *, list(bi ORDER BY pos) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) bs FROM q) GROUP BY id")
def chart_features(spark, d):
    return chart.features(casts(spark, d)).drop("name", "changed_name", "shi_ying", "six_harmony")


@_query(_LINES + """, life AS (SELECT id, pos, ((ni - [11, 2, 8, 5, 8][el[bi + 1] + 1]) + 12) % 12 st FROM q WHERE moving),
act AS (SELECT id, pos p, br FROM q WHERE moving UNION ALL SELECT DISTINCT id, 7, substr('子丑寅卯辰巳午未申酉戌亥', m + 1, 1) FROM q UNION ALL SELECT DISTINCT id, 8, substr('子丑寅卯辰巳午未申酉戌亥', d % 12 + 1, 1) FROM q),
e AS (SELECT q.id, p || '-' || pos who, act.br || q.br pr FROM act JOIN q ON q.id = act.id AND pos <> p),
f AS (SELECT id, 'transform_' || ['长生','沐浴','冠带','临官','帝旺','衰','病','死','墓','绝','胎','养'][st + 1] pt, CAST(pos AS VARCHAR) who FROM life WHERE st IN (0, 6, 7, 8, 9)
UNION ALL SELECT id, 'harm', who FROM e WHERE pr IN ('子未','丑午','寅巳','卯辰','申亥','酉戌','未子','午丑','巳寅','辰卯','亥申','戌酉')
UNION ALL SELECT id, 'zi_mao_punishment', who FROM e WHERE pr IN ('子卯','卯子')
UNION ALL SELECT id, 'self_punishment_branch', CAST(pos AS VARCHAR) FROM q WHERE br IN ('辰','午','酉','亥')
UNION ALL SELECT id, 'line_fanyin', CAST(pos AS VARCHAR) FROM q WHERE moving AND (bi - ni + 12) % 12 = 6
UNION ALL SELECT id, 'line_fuyin', CAST(pos AS VARCHAR) FROM q WHERE moving AND bi = ni
UNION ALL SELECT id, 'combination_08', CAST(pos AS VARCHAR) FROM q WHERE pos = shi AND spirit = '玄武'
UNION ALL SELECT id, 'combination_06', CAST(pos AS VARCHAR) FROM q WHERE rel = '子孙' AND spirit = '螣蛇')
SELECT pt AS pattern_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, count(DISTINCT who) AS places FROM f GROUP BY pt""")
def chart_patterns(spark, d):
    kinds = ["harm", "zi_mao_punishment", "self_punishment_branch", "line_fanyin", "line_fuyin", "combination_08", "combination_06"]
    f = chart.patterns(casts(spark, d), {*kinds, *(f"transform_{s}" for s in ("长生", "病", "死", "墓", "绝"))})
    # This query's SQL counts edges towards other lines, and lines one by one; chart_pattern_facts has all facts whole.
    f = f.where(~F.col("pattern_id").isin("harm", "zi_mao_punishment") | ~F.contains("participants", F.lit("c")))
    f = f.withColumn("participants", F.explode(F.when(F.col("pattern_id") == "combination_06", F.split("participants", "-")).otherwise(F.array("participants"))))
    return f.groupBy("pattern_id").agg(F.count("*").alias("n"), F.sum("chart_id").alias("ids"), F.countDistinct("participants").alias("places"))


_FACTS = _LINES.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, mv AS (SELECT * FROM q WHERE moving), lin AS (SELECT id, pos r, bi b FROM q), cal AS (SELECT DISTINCT id, 7 r, m b FROM q UNION ALL SELECT DISTINCT id, 8, d % 12 FROM q),
ac AS (SELECT id, pos r, bi b FROM mv UNION ALL SELECT * FROM cal), act AS (SELECT * FROM ac UNION ALL SELECT id, pos + 10, ni FROM mv), cur AS (SELECT * FROM lin UNION ALL SELECT * FROM cal),
e0 AS (SELECT ac.id, ac.r a, lin.r b, ac.b x, lin.b y FROM ac JOIN lin ON lin.id = ac.id AND lin.r <> ac.r UNION ALL SELECT id, pos + 10, pos, ni, bi FROM mv),
e AS (SELECT id, [a, b] refs, substr('子丑寅卯辰巳午未申酉戌亥', x + 1, 1) || substr('子丑寅卯辰巳午未申酉戌亥', y + 1, 1) pr, ([4, 2, 0, 0, 2, 1, 1, 2, 3, 3, 2, 4][y + 1] - [4, 2, 0, 0, 2, 1, 1, 2, 3, 3, 2, 4][x + 1] + 5) % 5 st FROM e0),
w AS (SELECT id, [pos] seen, ni, 1 n FROM mv UNION ALL SELECT w.id, list_append(w.seen, mv.pos), mv.ni, n + 1 FROM w JOIN mv ON mv.id = w.id AND mv.bi = w.ni AND NOT list_contains(w.seen, mv.pos)),
tri(t1, t2, t3) AS (VALUES (8, 0, 4), (5, 9, 1), (2, 6, 10), (11, 3, 7)), pun(t1, t2, t3, s) AS (VALUES (2, 5, 8, '2'), (1, 7, 10, '3')),
sy AS (SELECT s.*, y.pos yp, y.bi yb, y.br ybr, y.spirit ys FROM q s JOIN q y ON y.id = s.id AND y.pos = y.ying WHERE s.pos = s.shi),
hs AS (SELECT id, pos > 3 up, list(pos ORDER BY pos) refs, bool_and((bi - ni + 12) % 12 = 6) cl, bool_and(bi = ni) sa, count(*) = 3 AND bool_and(br || nb IN ('子未','丑午','寅巳','卯辰','申亥','酉戌','未子','午丑','巳寅','辰卯','亥申','戌酉')) ha FROM mv GROUP BY id, pos > 3),
hx AS (SELECT DISTINCT id, code & 7 lo, code >> 3 hi, chg & 7 nl, chg >> 3 nh, code <> chg mo FROM q),
op(a, b) AS (VALUES (7, 6), (6, 7), (2, 5), (5, 2), (4, 0), (0, 4), (1, 3), (3, 1)), oe(a, b) AS (VALUES (7, 0), (0, 7), (1, 6), (6, 1), (4, 3), (3, 4), (5, 2), (2, 5)),
co AS (SELECT q.id, 1 k, q.pos FROM q JOIN sy ON sy.id = q.id WHERE q.moving AND q.rel = '父母' AND q.spirit = '白虎' AND (q.el[sy.bi + 1] - q.el[q.bi + 1] + 5) % 5 = 2
UNION ALL SELECT id, 2, pos FROM q WHERE rel = '父母' AND (bi = d % 12 OR br || substr('子丑寅卯辰巳午未申酉戌亥', d % 12 + 1, 1) IN ('子丑','丑子','寅亥','亥寅','卯戌','戌卯','辰酉','酉辰','巳申','申巳','午未','未午') OR el[bi + 1] = el[d % 12 + 1])
UNION ALL SELECT id, 3, pos FROM mv WHERE (rel, nrel) IN (('父母', '妻财'), ('妻财', '父母'))
UNION ALL SELECT id, 4, pos FROM q WHERE pos = shi AND rel = '子孙' AND spirit = '青龙'
UNION ALL SELECT id, 5, pos FROM q WHERE rel = '子孙' AND spirit = '白虎' AND mb
UNION ALL SELECT id, 6, pos FROM q WHERE rel = '子孙' AND spirit = '螣蛇'
UNION ALL SELECT id, 7, pos FROM q WHERE pos = shi AND rel = '官鬼' AND spirit = '青龙'
UNION ALL SELECT id, 8, pos FROM q WHERE pos = shi AND spirit = '玄武'
UNION ALL SELECT id, 9, pos FROM mv WHERE rel = '兄弟' AND spirit = '玄武'
UNION ALL SELECT id, 10, pos FROM q WHERE pos = shi AND pos = 2 AND spirit = '勾陈'
UNION ALL SELECT id, 11, pos FROM q WHERE pos = shi AND pos = 5
UNION ALL SELECT id, 14, pos FROM q WHERE rel = '子孙' AND stage = 6 AND (spirit = '白虎' OR br = substr('寅亥申巳寅亥申巳寅亥申巳', d % 12 + 1, 1))
UNION ALL SELECT id, 15, pos FROM q WHERE rel = '妻财' AND mb AND EXISTS (SELECT 1 FROM q h WHERE h.id = q.id AND h.hidden AND h.urel = '官鬼')
UNION ALL SELECT id, 16, pos + 20 FROM q WHERE hidden AND EXISTS (SELECT 1 FROM q h WHERE h.id = q.id AND h.hidden AND h.urel = '妻财') AND EXISTS (SELECT 1 FROM q h WHERE h.id = q.id AND h.hidden AND h.urel = '子孙')),
cs AS (SELECT id, k, list(pos ORDER BY pos) refs FROM co GROUP BY id, k UNION ALL SELECT id, 12, [shi, ying] FROM sy WHERE (spirit, ys) IN (('白虎', '朱雀'), ('朱雀', '白虎'))
UNION ALL SELECT id, 13, [shi, ying] FROM sy WHERE el[bi + 1] = el[yb + 1] UNION ALL SELECT id, 17, [shi, ying] FROM sy WHERE br = ybr OR br || ybr IN ('丑寅','寅丑','辰巳','巳辰','未申','申未','戌亥','亥戌')),
f0 AS (SELECT id, 'transform_' || ['长生','','','','','','病','死','墓','绝','',''][(ni - [11, 2, 8, 5, 8][el[bi + 1] + 1] + 12) % 12 + 1] pt, 'xf_shang_c03' src, [pos, pos + 10] refs FROM mv WHERE (ni - [11, 2, 8, 5, 8][el[bi + 1] + 1] + 12) % 12 IN (0, 6, 7, 8, 9)
UNION ALL SELECT id, 'harm', 'xf_xia_c10_u0' || CASE st WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, refs FROM e WHERE pr IN ('子未','丑午','寅巳','卯辰','申亥','酉戌','未子','午丑','巳寅','辰卯','亥申','戌酉')
UNION ALL SELECT id, 'zi_mao_punishment', 'xf_xia_c04_s01', refs FROM e WHERE pr IN ('子卯', '卯子')
UNION ALL SELECT id, 'partial_three_punishments', 'xf_xia_c04_s02', refs FROM e WHERE pr IN ('寅巳','寅申','巳寅','巳申','申寅','申巳') UNION ALL SELECT id, 'partial_three_punishments', 'xf_xia_c04_s03', refs FROM e WHERE pr IN ('丑未','丑戌','未丑','未戌','戌丑','戌未')
UNION ALL SELECT id, 'self_punishment_branch', 'xf_xia_c04_s05', [pos] FROM q WHERE br IN ('辰','午','酉','亥')
UNION ALL SELECT id, 'line_fanyin', 'line_rule_4784', [pos, pos + 10] FROM mv WHERE (bi - ni + 12) % 12 = 6 UNION ALL SELECT id, 'line_fuyin', 'line_rule_4784', [pos, pos + 10] FROM mv WHERE bi = ni
UNION ALL SELECT id, 'geshan_chain', 'xf_xia_c09', list_append(seen, seen[len(seen)] + 10) FROM w WHERE n > 1
UNION ALL SELECT x.id, 'double_punishment', 'xf_xia_c04_s04', [x.pos, y.pos] FROM q x JOIN q y ON x.id = y.id AND x.pos < y.pos AND x.el[x.bi + 1] = y.el[y.bi + 1] WHERE x.moving OR y.moving OR (x.pos = x.shi AND y.pos = y.ying) OR (x.pos = x.ying AND y.pos = y.shi)
UNION ALL SELECT mv.id, 'relative_position_change', 'xf_xia_c08', [q.pos, mv.pos + 10] FROM mv JOIN q ON q.id = mv.id AND q.pos <> mv.pos AND q.rel = mv.nrel AND (q.bi = mv.ni OR q.el[q.bi + 1] = mv.el[mv.ni + 1])
UNION ALL SELECT x.id, 'three_harmony_candidate', 'line_rule_4520', [x.r, y.r, z.r] FROM tri, act x, act y, act z WHERE x.id = y.id AND y.id = z.id AND x.b = t1 AND y.b = t2 AND z.b = t3 AND NOT (x.r IN (7, 8) AND y.r IN (7, 8) AND z.r IN (7, 8))
UNION ALL SELECT x.id, 'half_harmony_candidate', 'line_rule_4520', [x.r, y.r] FROM tri, act x, act y WHERE x.id = y.id AND x.b = t1 AND y.b = t2 AND (x.r < 7 OR y.r < 7) AND (x.id, t3) NOT IN (SELECT id, b FROM act)
UNION ALL SELECT x.id, 'half_harmony_candidate', 'line_rule_4520', [x.r, y.r] FROM tri, act x, act y WHERE x.id = y.id AND x.b = t2 AND y.b = t3 AND (x.r < 7 OR y.r < 7) AND (x.id, t1) NOT IN (SELECT id, b FROM act)
UNION ALL SELECT x.id, 'three_punishments', 'xf_xia_c04_s0' || s, [x.r, y.r, z.r] FROM pun, cur x, cur y, cur z WHERE x.id = y.id AND y.id = z.id AND x.b = t1 AND y.b = t2 AND z.b = t3 AND (x.r < 7 OR y.r < 7 OR z.r < 7)
UNION ALL SELECT id, 'all_transform_harm', 'xf_xia_c10_u04', refs FROM hs WHERE ha UNION ALL SELECT id, 'line_change_clash', 'line_rule_4784', refs FROM hs WHERE cl UNION ALL SELECT id, 'line_change_same_branch', 'line_rule_4784', refs FROM hs WHERE sa
UNION ALL SELECT id, 'combination_' || lpad(CAST(k AS VARCHAR), 2, '0'), 'xf_shang_c02_u' || lpad(CAST(k AS VARCHAR), 2, '0'), refs FROM cs),
f AS (SELECT id, pt, src, refs, array_to_string(list_transform(refs, lambda r: CASE WHEN r < 10 THEN CAST(r AS VARCHAR) WHEN r < 20 THEN (r - 10) || 'c' ELSE (r - 20) || 'h' END), '-') who, true here FROM f0
UNION ALL SELECT id, 'hidden_flying_relation', 'xf_xia_c05', [pos, pos + 20], pos || ':' || concat_ws('/', CASE WHEN (bi - ui + 12) % 12 = 6 THEN '冲' END, CASE WHEN br || ub IN ('子丑','丑子','寅亥','亥寅','卯戌','戌卯','辰酉','酉辰','巳申','申巳','午未','未午') THEN '合' END, ['同五行', '生', '克', '受克', '受生'][(el[ui + 1] - el[bi + 1] + 5) % 5 + 1]), true FROM q WHERE hidden
UNION ALL SELECT id, 'upper_lower_fanyin', 'xf_xia_c07_u01', [], 'primary', true FROM hx WHERE (lo, hi) IN (SELECT (a, b) FROM op) UNION ALL SELECT id, 'upper_lower_fanyin', 'xf_xia_c07_u01', [], 'changed', mo FROM hx WHERE (nl, nh) IN (SELECT (a, b) FROM op)
UNION ALL SELECT id, 'trigram_change_fanyin', 'xf_xia_c07_u02', [], 'lower', true FROM hx WHERE (lo, nl) IN (SELECT (a, b) FROM op) UNION ALL SELECT id, 'trigram_change_fanyin', 'xf_xia_c07_u02', [], 'upper', true FROM hx WHERE (hi, nh) IN (SELECT (a, b) FROM op)
UNION ALL SELECT id, 'early_trigram_change_fanyin', 'line_rule_4784', [], 'lower', true FROM hx WHERE (lo, nl) IN (SELECT (a, b) FROM oe) UNION ALL SELECT id, 'early_trigram_change_fanyin', 'line_rule_4784', [], 'upper', true FROM hx WHERE (hi, nh) IN (SELECT (a, b) FROM oe))
"""


@_query(_FACTS + "SELECT id AS chart_id, pt AS pattern_id, who AS participants, src AS source FROM f")
def chart_pattern_facts(spark, d):
    return chart.patterns(casts(spark, d))


@_query(_LINES.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + """, mv AS (SELECT id, pos, bi, ni FROM q WHERE moving), w AS (SELECT id, CAST(pos AS VARCHAR) path, [pos] seen, ni, 1 n FROM mv
UNION ALL SELECT w.id, w.path || '>' || mv.pos, list_append(w.seen, mv.pos), mv.ni, n + 1 FROM w JOIN mv ON mv.id = w.id AND mv.bi = w.ni AND NOT list_contains(w.seen, mv.pos)) SELECT id AS chart_id, path FROM w WHERE n > 1""")
def chart_chain(spark, d):
    return chart.chains(casts(spark, d))


@_query(_LINES + """, g AS (SELECT id, count(*) FILTER (WHERE moving) nm, bool_or(hidden) hid, any_value(stage) stage, any_value(chg) chg FROM q GROUP BY id),
r AS (SELECT id, 'key_images' ck FROM g UNION ALL SELECT q.id, 'single_moving:primary:' || pos FROM q JOIN g ON g.id = q.id WHERE moving AND nm = 1
UNION ALL SELECT id, 'moving_relationships' FROM g WHERE nm > 1 OR (nm > 0 AND hid) UNION ALL SELECT id, 'static_day_clash:primary:' || pos FROM q WHERE NOT moving AND dc
UNION ALL SELECT id, 'palace_stage:primary' FROM g WHERE stage >= 6 UNION ALL SELECT g.id, 'palace_stage:changed' FROM g JOIN h ON h.code = g.chg WHERE nm > 0 AND h.s >= 6
UNION ALL SELECT id, 'tomb_candidate:primary:' || pos FROM q WHERE pos IN (shi, ying) AND (m = [7, 10, 4, 1, 4][el[bi + 1] + 1] OR d % 12 = [7, 10, 4, 1, 4][el[bi + 1] + 1] OR (moving AND ni = [7, 10, 4, 1, 4][el[bi + 1] + 1]) OR EXISTS (SELECT 1 FROM q o WHERE o.id = q.id AND o.moving AND o.pos <> q.pos AND o.bi = [7, 10, 4, 1, 4][q.el[q.bi + 1] + 1])))
SELECT id AS chart_id, ck AS check_id FROM r""")
def chart_review(spark, d):
    # The six checks that this query's SQL has; chart_review_all has all eight.
    return chart.review(casts(spark, d), sources=False).where(F.col("check_id") != "six_relations")


@_query(_FACTS + ORACLE_SQL["chart_review"].removeprefix(_LINES) + """
UNION ALL SELECT DISTINCT id, 'six_relations' FROM (SELECT x.id, x.moving, (x.bi - y.bi + 12) % 12 = 6 c, x.br || y.br IN ('子丑','丑子','寅亥','亥寅','卯戌','戌卯','辰酉','酉辰','巳申','申巳','午未','未午') h, (x.ni - y.ni + 12) % 12 = 6 nc, x.nb || y.nb IN ('子丑','丑子','寅亥','亥寅','卯戌','戌卯','辰酉','酉辰','巳申','申巳','午未','未午') nh, x.mask FROM q x JOIN q y ON x.id = y.id AND y.pos = x.pos + 3) GROUP BY id HAVING bool_and(c) OR bool_and(h) OR (max(mask) > 0 AND (bool_and(nc) OR bool_and(nh)))
UNION ALL SELECT DISTINCT f.id, 'pattern_source:' || src FROM f JOIN (SELECT id, list(pos) FILTER (WHERE moving OR pos IN (shi, ying)) fo FROM q GROUP BY id) o ON o.id = f.id WHERE here AND (len(refs) = 0 OR len(list_filter(refs, lambda r: r BETWEEN 11 AND 16 OR list_contains(fo, r))) > 0)""")
def chart_review_all(spark, d):
    return chart.review(casts(spark, d))


# Extraction, entities, accounting -----------------------------------------------------------------------------


@_query("SELECT doc_id, sha256(array_to_string([substr(string_split(text, chr(10))[1], 6), string_split(text, chr(10))[2][1:10]], chr(10))) AS span_sha256 FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def span_resolve(spark, d):
    x = _t(spark, d, "documents").where(F.size(F.split("text", "\n")) >= 2)
    return x.select("doc_id", X.digest(extract.resolved(F.col("text"), F.lit(1), F.lit(2), F.lit(5), F.lit(10))).alias("span_sha256"))


@_query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n FROM documents)
SELECT doc_id, n AS line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def line_offsets(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.posexplode(extract.offsets(F.split("text", "\n"))).alias("i", "o"))
    return x.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.col("o").cast("long").alias("offset"))


@_query("SELECT doc_id, sha256(CASE WHEN substr(t, 1, 1) = 'A' THEN 'alpha' || substr(t, 2) ELSE t END) AS edited_sha256 FROM (SELECT doc_id, CASE WHEN substr(text, 6, 1) = 'e' THEN substr(text, 1, 5) || '<e>' || substr(text, 7) ELSE text END t FROM documents)")
def edit_overlay(spark, d):
    edits = F.array(*(F.struct(F.lit(at).alias("at"), F.lit(old).alias("old"), F.lit(new).alias("new")) for at, old, new in ((0, "A", "alpha"), (5, "e", "<e>"), (2, "no such", "x"))))
    return _t(spark, d, "documents").select("doc_id", X.digest(extract.edited(F.col("text"), edits)).alias("edited_sha256"))


@_query("SELECT CAST(k AS INTEGER) AS k, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS value FROM (SELECT DISTINCT o_orderkey % 4 k FROM orders)")
def symbol_decode(spark, d):
    k = (F.col("o_orderkey") % 4).cast("int").alias("k")
    signs = F.array(F.lit("子 × ○"), F.lit("丑 ━━━"), F.lit("寅 - -"), F.lit("卯 ○"))
    return _t(spark, d, "orders").select(k).distinct().select("k", extract.symbol(F.get(signs, F.col("k"))).alias("value"))


@_query("""WITH e AS (SELECT a.o_orderkey a, b.o_orderkey b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) < 20000),
r AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) p FROM orders),
g AS (SELECT *, sum(CASE WHEN o_totalprice - p < 20000 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) i FROM r)
SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority, i) AS "group" FROM g""")
def duplicate_groups(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    near = F.abs(F.col("x.o_totalprice") - F.col("y.o_totalprice")) < 20000
    return graph.grouped(o, "o_orderkey", graph.blocked_pairs(o, "o_orderkey", ["o_custkey", "o_orderpriority"], near))


@_query("""WITH w AS (SELECT item_id, i * 8 AS pos, substr(text, CAST(i * 8 + 1 AS BIGINT), 32) piece FROM (SELECT item_id, text, unnest(range(CAST((length(text) - 32) // 8 + 1 AS BIGINT))) i FROM benchmark WHERE length(text) >= 32))
SELECT item_id AS q_id, doc_id AS d_id, count(DISTINCT pos) AS n_windows FROM w JOIN documents ON contains(text, piece) GROUP BY 1, 2""")
def shingle_overlap(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("q"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("d_id"), F.col("text").alias("d"))
    return overlap.overlaps(q, docs, longest=False)


@_query("""WITH b AS (SELECT item_id, translate(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\x{4e00}-\\x{9fff}]', '', 'g')), '已戍', '巳戌') q FROM benchmark), t AS (SELECT doc_id, translate(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\x{4e00}-\\x{9fff}]', '', 'g')), '已戍', '巳戌') d FROM documents),
w AS (SELECT item_id, q, i * 8 AS pos, substr(q, CAST(i * 8 + 1 AS BIGINT), 32) piece FROM (SELECT item_id, q, unnest(range(CAST((length(q) - 32) // 8 + 1 AS BIGINT))) i FROM b WHERE length(q) >= 32)),
h AS (SELECT item_id, doc_id, pos, substr(q, CAST(pos + 1 AS BIGINT)) qr, substr(d, strpos(d, piece)) dr FROM w JOIN t ON contains(d, piece))
SELECT item_id AS q_id, doc_id AS d_id, count(DISTINCT pos) AS n_windows, max(list_max(list_filter(range(32, least(length(qr), length(dr)) + 1), lambda k: substr(qr, 1, k) = substr(dr, 1, k)))) AS longest FROM h GROUP BY 1, 2""")
def shingle_overlap_normalized(spark, d):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), overlap.normalized(F.col("text")).alias("q"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("d_id"), overlap.normalized(F.col("text")).alias("d"))
    return overlap.overlaps(q, docs)


@_query("SELECT lang, source, count(*) AS total, count(quality) AS reviewed, min(CASE WHEN quality IS NULL THEN doc_id END) AS next_pending FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang, source")
def review_progress(spark, d):
    x = _t(spark, d, "documents").select("doc_id", "lang", "source").join(_t(spark, d, "labels"), "doc_id", "left")
    return compiled.progress(x, ["lang", "source"], "doc_id", "quality")


@_query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM benchmark) AS benchmark")
def release_manifest(spark, d):
    names = ["documents", "labels", "pages", "benchmark"]
    rows = compiled.manifest({n: _t(spark, d, n) for n in names})
    return rows.groupBy().agg(*(F.max(F.when(F.col("name") == n, F.col("rows"))).alias(n) for n in names))


@_query("SELECT doc_id, CASE WHEN quality = 0 THEN 'compare_only' WHEN quality IS NULL THEN 'database_only' ELSE 'routed' END AS bucket FROM documents LEFT JOIN labels USING (doc_id)")
def bucket_routing(spark, d):
    x = _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    return x.select("doc_id", compiled.bucket(F.col("quality")).alias("bucket"))


@_query("SELECT conv_id, turn, greatest(turn - 2, (SELECT min(turn) FROM conversations i WHERE i.conv_id = c.conv_id)) AS \"from\", least(turn + 2, (SELECT max(turn) FROM conversations i WHERE i.conv_id = c.conv_id)) AS \"to\" FROM conversations c")
def context_expansion(spark, d):
    return compiled.around(_t(spark, d, "conversations"), "conv_id", "turn", 2)


from . import builds, corpus  # noqa: E402,F401  they register their queries
