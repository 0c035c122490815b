"""Registered queries of the build plane: gates, compiled documents, trees of evidence, evaluation, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compile as compiled
from ..operators import evaluate, gates, search, trees
from .catalogue import _query, _r6, _t


@_query("""SELECT c_nationkey, count(*) AS total, array_to_string(list_sort(list(c_custkey))[1:10], ',') AS ids,
coalesce(array_to_string(list_sort(list(c_custkey) FILTER (c_acctbal > 5000))[1:10], ','), '') AS eligible_ids,
(SELECT string_agg(s || ':' || n, ',' ORDER BY s) FROM (SELECT CASE WHEN i.c_acctbal > 5000 THEN 'eligible' WHEN i.c_acctbal > 0 THEN 'noise' ELSE 'pending' END s, count(*) n FROM customer i WHERE i.c_nationkey = c.c_nationkey GROUP BY 1)) AS quality, count(*) > 10 AS has_more
FROM customer c GROUP BY c_nationkey""")
def related_cases(spark, d):
    status = F.when(F.col("c_acctbal") > 5000, "eligible").when(F.col("c_acctbal") > 0, "noise")
    out = trees.related(_t(spark, d, "customer").withColumn("status", status), "c_nationkey", "c_custkey", "status")
    return out.select("c_nationkey", "total", F.array_join("ids", ",").alias("ids"), F.coalesce(F.array_join("eligible_ids", ","), F.lit("")).alias("eligible_ids"), "quality", "has_more")


@_query("""WITH t AS (SELECT s_name AS id, 'S-' || (s_suppkey // 2) AS a FROM supplier),
r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Supplier#' || lpad(CAST(p_partkey % 60 AS VARCHAR), 9, '0') WHEN 1 THEN 'S-' || (p_partkey % 70) ELSE 'none' END AS reference FROM part)
SELECT p_partkey, reference, coalesce((SELECT min(id) FROM t WHERE id = reference), (SELECT min(id) FROM t WHERE a = reference)) AS id,
CASE WHEN reference IN (SELECT id FROM t) THEN 'id' WHEN reference IN (SELECT a FROM t) THEN 'alias' END AS via FROM r""")
def alias_lookup(spark, d):
    k = F.col("p_partkey")
    ref = F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 60).cast("string"), 9, "0"))).when(k % 3 == 1, F.concat(F.lit("S-"), (k % 70).cast("string"))).otherwise("none")
    targets = _t(spark, d, "supplier").select(F.col("s_name").alias("id"), F.array(F.concat(F.lit("S-"), F.floor(F.col("s_suppkey") / 2).cast("string"))).alias("aliases"))
    return trees.by_alias(_t(spark, d, "part").select("p_partkey", ref.alias("reference")), targets)


@_query("""WITH m AS (SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey // 3 * 3 END, o_orderkey) AS event FROM orders)
SELECT a.o_orderkey, a.event, coalesce(string_agg(b.o_orderkey, ',' ORDER BY b.o_orderkey), '') AS others FROM m a LEFT JOIN m b ON a.event = b.event AND a.o_orderkey <> b.o_orderkey GROUP BY ALL""")
def event_members(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select("o_orderkey", F.when(k % 4 != 0, F.floor(k / 3) * 3).cast("long").alias("declared"))
    return trees.members(o, "declared", "o_orderkey").select("o_orderkey", "event", F.array_join("others", ",").alias("others"))


@_query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) n FROM lineitem)
SELECT l_orderkey || CASE WHEN n > 1 THEN '.cast' || n ELSE '' END AS record_id, l_orderkey, n::INTEGER AS cast_index, l_partkey FROM l""")
def cast_expansion(spark, d):
    units = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("casts"))
    return trees.expanded_casts(units, "l_orderkey", "casts").select("record_id", "l_orderkey", F.col("cast_index").cast("int").alias("cast_index"), "cast.l_partkey")


@_query("""SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY o, l_returnflag) AS flags FROM (SELECT l_orderkey, l_returnflag, min(l_linenumber) o FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def first_seen(spark, d):
    return trees.in_order(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag").select("l_orderkey", F.array_join("l_returnflags", "").alias("flags"))


_AUDITS = """WITH a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'passed' END AS status FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'passed' FROM orders WHERE o_orderkey % 11 = 0)"""


@_query(_AUDITS + """, n AS (SELECT o_orderkey, count(*) n, any_value(o_custkey) c, any_value(o_orderstatus) s, bool_and(o_orderstatus IS NOT NULL) h, any_value(status) st FROM a GROUP BY 1),
v AS (SELECT o.o_orderkey, o_orderpriority, CASE WHEN n = 1 AND st = 'passed' AND c = o_custkey AND h AND s = o_orderstatus THEN 'calculated' ELSE 'not_run' END AS validation FROM orders o LEFT JOIN n USING (o_orderkey))
SELECT o_orderkey, validation, CASE WHEN validation = 'calculated' THEN o_orderpriority END AS o_orderpriority FROM v""")
def audit_binding(spark, d):
    o, k = _t(spark, d, "orders"), F.col("o_orderkey")
    first = o.where(k % 3 != 0).select("o_orderkey", "o_custkey", F.when(k % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 7 == 0, "failed").otherwise("passed").alias("status"))
    audits = first.unionByName(o.where(k % 11 == 0).select("o_orderkey", "o_custkey", "o_orderstatus", F.lit("passed").alias("status")))
    bound = gates.bound(o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), audits, "o_orderkey", ["o_custkey", "o_orderstatus"])
    return gates.exposed(bound, ["o_orderpriority"]).select("o_orderkey", "validation", "o_orderpriority")


_SPANS = "SELECT l_orderkey, l_returnflag, l_linenumber * 20 AS s, l_linenumber * 20 + CAST(l_quantity AS BIGINT) AS e FROM lineitem"


@_query(f"""WITH i AS (SELECT *, row_number() OVER () r FROM ({_SPANS}))
SELECT a.l_orderkey, a.l_returnflag AS role_a, b.l_returnflag AS role_b, count(*) AS n FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag < b.l_returnflag AND a.s < b.e AND b.s < a.e
WHERE NOT (a.l_returnflag = 'A' AND b.l_returnflag = 'N') GROUP BY ALL""")
def role_overlap(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linenumber") * 20).cast("long").alias("s"), (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("long")).alias("e"))
    return gates.role_overlaps(li, "l_orderkey", "l_returnflag", "s", "e", [("A", "N")])


@_query(f"""WITH i AS ({_SPANS}), o AS (SELECT * FROM i WHERE l_returnflag <> 'R'),
m AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY s, e) g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END new FROM o)),
w AS (SELECT l_orderkey, min(s) s, max(e) e FROM m GROUP BY l_orderkey, g)
SELECT l_orderkey, s, e, EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = i.l_orderkey AND w.s <= i.s AND i.e <= w.e) AS inside FROM i WHERE l_returnflag = 'R'""")
def span_containment(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linenumber") * 20).cast("long").alias("s"), (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("long")).alias("e"))
    return gates.contained(li.where("l_returnflag = 'R'").select("l_orderkey", "s", "e"), li.where("l_returnflag <> 'R'"), ["l_orderkey"], "s", "e")


@_query("""WITH i AS (SELECT l_orderkey, l_linenumber * 10 - 10 AS s, l_linenumber * 10 - CASE WHEN l_partkey % 9 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 13 = 0 THEN 3 ELSE 0 END AS e FROM lineitem),
m AS (SELECT *, coalesce(max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) r, max(e) OVER (PARTITION BY l_orderkey) l, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, e) n FROM i)
SELECT l_orderkey, 'gap' AS problem, r::BIGINT AS at FROM m WHERE s > r UNION ALL SELECT l_orderkey, 'double', s::BIGINT FROM m WHERE s < r UNION ALL SELECT l_orderkey, 'end', l::BIGINT FROM m WHERE n = 1 AND l <> 40""")
def slice_partition(spark, d):
    p, n = F.col("l_partkey"), F.col("l_linenumber") * 10
    li = _t(spark, d, "lineitem").select("l_orderkey", (n - 10).alias("s"), (n - F.when(p % 9 == 0, 2).otherwise(0) + F.when(p % 13 == 0, 3).otherwise(0)).alias("e"), F.lit(40).alias("total"))
    return gates.partition_problems(li, "l_orderkey", "s", "e", "total")


@_query("""WITH t AS (SELECT doc_id, text, length(text) n FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, text, n, unnest(range(0, greatest(n // 100, 0) + 1)) i FROM t),
p AS (SELECT doc_id, length(regexp_replace(substr(text, CAST(i * 100 + 1 AS INTEGER), 60), '[\\s\\x{00A0}\\x{0085}\\x{000B}]', '', 'g')) c, length(regexp_replace(substr(text, CAST(i * 100 + 61 AS INTEGER), 40), '[\\s\\x{00A0}\\x{0085}\\x{000B}]', '', 'g')) g FROM k)
SELECT doc_id, sum(c + g)::INTEGER AS total, sum(c)::INTEGER AS covered, count(*) FILTER (g > 0)::INTEGER AS gaps FROM p GROUP BY doc_id""")
def text_coverage(spark, d):
    cut = X.let(F.char_length("text"), lambda n: F.transform(F.sequence(F.lit(0), F.floor(n / 100).cast("int")), lambda i: F.struct((i * 100).alias("start"), F.least(i * 100 + 60, n).alias("end"))))
    docs = _t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", gates.text_coverage(F.col("text"), F.filter(cut, lambda x: x["end"] > x["start"])).alias("x")).select("doc_id", "x.*")


@_query("""SELECT sum(n)::BIGINT AS total, sum(k)::BIGINT AS n_ok, round(sum(k) / sum(n), 6) AS ratio, string_agg(s || ':' || n, ',' ORDER BY s) AS by_status FROM (SELECT o_orderstatus s, count(*) n, count(*) FILTER (o_totalprice > 100000) k FROM orders GROUP BY 1)""")
def coverage_report(spark, d):
    return gates.coverage_report(_t(spark, d, "orders"), "o_orderstatus", F.col("o_totalprice") > 100000).withColumn("ratio", _r6("ratio"))


@_query("""SELECT s AS name, count(DISTINCT k) AS n FROM (SELECT s_suppkey k, s_name s FROM supplier UNION SELECT s_suppkey, 'N' || (s_suppkey % 6) FROM supplier WHERE s_suppkey % 5 = 0) GROUP BY s HAVING count(DISTINCT k) > 1""")
def mapping_uniqueness(spark, d):
    k = F.col("s_suppkey")
    return gates.repeated_names(_t(spark, d, "supplier"), "s_suppkey", F.array(F.col("s_name"), F.when(k % 5 == 0, F.concat(F.lit("N"), (k % 6).cast("string")))))


@_query("""WITH m AS (SELECT doc_id, quality = 1 AS f FROM labels), i AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 = 1), n AS (SELECT doc_id, count(*) n FROM i GROUP BY 1)
SELECT * FROM (SELECT doc_id, CASE WHEN coalesce(f, false) AND n IS NULL THEN 'missing' WHEN NOT coalesce(f, false) AND n IS NOT NULL THEN 'extra' WHEN n > 1 THEN 'repeated' END AS problem FROM m FULL JOIN n USING (doc_id)) WHERE problem IS NOT NULL""")
def index_parity(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    index = docs.where("doc_id % 3 <> 0").unionByName(docs.where("doc_id % 10 = 1"))
    return gates.parity(_t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("searchable")), index, "doc_id", "searchable")


_DECLARED = "CASE o_orderkey % 5 WHEN 0 THEN 'eligible' WHEN 1 THEN 'noise' WHEN 2 THEN 'pending' WHEN 3 THEN 'approved' ELSE NULL END"


@_query(f"""WITH q AS (SELECT o_orderkey, {_DECLARED} s, CASE WHEN o_custkey % 3 = 0 THEN ' ' ELSE o_orderpriority END r, CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END w, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END f FROM orders)
SELECT o_orderkey, 'status' AS rule FROM q WHERE coalesce(s, '') NOT IN ('eligible', 'noise', 'pending') UNION ALL SELECT o_orderkey, 'reason' FROM q WHERE trim(r) = '' UNION ALL SELECT o_orderkey, 'reviewer' FROM q WHERE w IS NULL UNION ALL SELECT o_orderkey, 'feedback' FROM q WHERE s = 'eligible' AND f IS NULL""")
def quality_reviews(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 5
    o = _t(spark, d, "orders").select("o_orderkey", F.when(k == 0, "eligible").when(k == 1, "noise").when(k == 2, "pending").when(k == 3, "approved").alias("s"), F.when(c % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("r"), F.when(c % 7 != 0, F.col("o_orderstatus")).alias("w"), F.lit("q").alias("q"), F.when(c % 2 == 0, F.col("o_orderpriority")).alias("f"))
    return gates.qualities(o, "o_orderkey", "s", "r", "w", "q", "f")


@_query(f"""WITH q AS (SELECT o_orderkey, {_DECLARED} s, CASE WHEN o_custkey % 3 = 0 THEN ' ' ELSE o_orderpriority END b, CASE WHEN o_custkey % 7 <> 0 THEN o_orderstatus END w FROM orders)
SELECT o_orderkey, 'basis' AS rule FROM q WHERE s = 'approved' AND trim(b) = '' UNION ALL SELECT o_orderkey, 'reviewer' FROM q WHERE s = 'approved' AND w IS NULL""")
def approved_reviews(spark, d):
    c, k = F.col("o_custkey"), F.col("o_orderkey") % 5
    o = _t(spark, d, "orders").select("o_orderkey", F.when(k == 3, "approved").when(k == 0, "eligible").alias("s"), F.when(c % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("b"), F.when(c % 7 != 0, F.col("o_orderstatus")).alias("w"))
    return gates.reviews(o, "o_orderkey", "s", "b", "w")


@_query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(quality = 1, false) AND trim(coalesce(text, '')) <> '' ELSE doc_id % 3 <> 0 AND (doc_id % 5 <> 0 OR lang = 'en') END AS searchable FROM documents LEFT JOIN labels USING (doc_id)""")
def searchable_evidence(spark, d):
    k, docs = F.col("doc_id"), _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    role = F.when(k % 3 == 0, "heading_only").when(k % 5 == 0, "case_excerpt").otherwise("passage")
    flag = gates.searchable(F.when(k % 2 == 0, "case").otherwise("rule"), role, F.when(F.col("lang") == "en", "said"), F.when(F.col("quality") == 1, "eligible"), F.col("text"))
    return docs.select("doc_id", flag.alias("searchable"))


@_query("""WITH s AS (SELECT doc_id, text, sha256(text) h FROM documents), i AS (SELECT item_id, item_id * 3 AS doc_id, CASE WHEN item_id % 4 <> 0 THEN substr(text, 1, 40) END q FROM benchmark),
j AS (SELECT i.item_id, i.doc_id, CASE WHEN i.item_id % 5 = 0 THEN 'x' ELSE s.h END sh, CASE WHEN i.item_id % 3 = 0 THEN substr(s.text, 5, 30) ELSE q END q, s.text, s.h FROM i LEFT JOIN s USING (doc_id))
SELECT item_id, CASE WHEN h IS NULL THEN 'source' WHEN sh <> h THEN 'hash' WHEN q IS NOT NULL AND NOT contains(text, q) THEN 'text' END AS problem FROM j""")
def citation_integrity(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    k = F.col("item_id")
    items = _t(spark, d, "benchmark").select("item_id", (k * 3).alias("doc_id"), F.when(k % 4 != 0, F.substring("text", 1, 40)).alias("own"))
    made = items.join(docs, "doc_id", "left").select("item_id", "doc_id", F.when(k % 5 == 0, "x").otherwise(F.sha2("text", 256)).alias("source_hash"), F.when(k % 3 == 0, F.substring("text", 5, 30)).otherwise(F.col("own")).alias("quote"))
    return gates.citations(made, docs, "doc_id").select("item_id", "problem")


@_query("""WITH r AS (SELECT l_suppkey, l_partkey // 50 AS b, l_partkey AS s, l_partkey + l_linenumber AS e FROM lineitem),
m AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey, b ORDER BY s, e) g FROM (SELECT *, CASE WHEN s <= max(e + 1) OVER (PARTITION BY l_suppkey, b ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END new FROM r))
SELECT l_suppkey, b, min(s) AS s, max(e) AS e FROM m GROUP BY l_suppkey, b, g""")
def range_merge(spark, d):
    li = _t(spark, d, "lineitem").select("l_suppkey", F.floor(F.col("l_partkey") / 50).alias("b"), F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_linenumber")).alias("e"))
    return compiled.ranges(li, ["l_suppkey", "b"], "s", "e")


@_query("""SELECT l_orderkey, min(l_partkey) AS s, max(l_partkey + l_linenumber) AS e FROM lineitem GROUP BY 1""")
def line_envelope(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_linenumber")).alias("e"))
    return compiled.envelope(li, ["l_orderkey"], "s", "e")


@_query("""WITH s AS (SELECT conv_id, turn, sha256(text) AS text_sha256, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset, length(text) n FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, text_sha256, start_offset, (start_offset + n)::BIGINT AS end_offset FROM s WHERE start_offset < 600 AND start_offset + n > 200""")
def section_page(spark, d):
    c = _t(spark, d, "conversations").where("text is not null")
    out = compiled.sections(c, "conv_id", ["turn", "role"], "text").select("conv_id", "turn", "text_sha256", F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"))
    return compiled.on_page(out, 200, 400)


@_query("""WITH r AS (SELECT l_orderkey, l_linenumber id, l_linenumber * 40 a, l_linenumber * 40 + CAST(l_quantity AS BIGINT) * 2 b FROM lineitem), p AS (SELECT unnest(range(0, 10)) page)
SELECT l_orderkey, id AS a_id, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM r JOIN p ON a <= page * 50 + 49 AND page * 50 <= b GROUP BY ALL""")
def pages_touched(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("a_id"), (F.col("l_linenumber") * 40).cast("long").alias("a_start"), (F.col("l_linenumber") * 40 + F.col("l_quantity").cast("long") * 2).alias("a_end"))
    pages = li.select("l_orderkey").distinct().withColumn("b_id", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("b_start", (F.col("b_id") * 50).cast("long")).withColumn("b_end", (F.col("b_id") * 50 + 49).cast("long"))
    return compiled.touched(li, pages, ["l_orderkey"]).select("l_orderkey", "a_id", F.array_join("pages", ",").alias("pages"))


@_query("""WITH s AS (SELECT CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey - 3 END step, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END title, CASE WHEN c_custkey % 6 = 0 THEN [] ELSE [c_custkey * 2, c_custkey * 40] END ev FROM customer),
p AS (SELECT step, 'positive' problem FROM s WHERE step < 1 UNION SELECT step, 'unique' FROM s GROUP BY step HAVING count(*) > 1 UNION SELECT step, 'title' FROM s WHERE title = '' UNION SELECT step, 'evidence' FROM s WHERE len(ev) = 0
UNION SELECT step, CASE WHEN doc_id IS NULL THEN 'missing_evidence' ELSE 'source_not_allowed' END FROM (SELECT step, unnest(ev) e FROM s) LEFT JOIN documents ON doc_id = e WHERE doc_id IS NULL OR source = 'src1') SELECT * FROM p""")
def workflow_validation(spark, d):
    k = F.col("c_custkey")
    steps = _t(spark, d, "customer").select(F.when(k % 10 == 9, k - 1).otherwise(k - 3).alias("step"), F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("title"), F.lit("r").alias("route"), F.when(k % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k * 2, k * 40)).alias("evidence_ids"))
    units = _t(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("source").alias("source_id"))
    return compiled.workflow_problems(steps, units, F.col("source_id") != "src1")


@_query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE '【' || p_type || '】' || p_name END rule FROM part), t AS (SELECT p_partkey, nullif(regexp_extract(rule, '^[\\[【]([^\\]】]+)[\\]】]', 1), '') title FROM r), g AS (SELECT DISTINCT p_type title, left(p_type, 1) grp FROM part WHERE p_type < 'L')
SELECT p_partkey, title, grp FROM t LEFT JOIN g USING (title)""")
def rule_groups(spark, d):
    p = _t(spark, d, "part")
    rules = p.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("【"), F.col("p_type"), F.lit("】"), F.col("p_name"))).alias("rule"))
    groups = p.where("p_type < 'L'").select(F.col("p_type").alias("title"), F.substring("p_type", 1, 1).alias("grp")).distinct()
    return compiled.grouped_rules(rules, "rule", groups).select("p_partkey", "title", "grp")


@_query("""WITH u AS (SELECT o_orderkey k FROM orders), r AS (SELECT l_orderkey k FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_orderkey + 1000000 FROM lineitem WHERE l_orderkey % 100 = 0)
SELECT k AS o_orderkey, 'unrouted' AS problem FROM u WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT k, 'unknown' FROM r WHERE k NOT IN (SELECT k FROM u)""")
def total_accounting(spark, d):
    li = _t(spark, d, "lineitem")
    a = li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    b = li.where("l_orderkey % 100 = 0").select((F.col("l_orderkey") + 1000000).alias("o_orderkey"))
    return compiled.unaccounted(_t(spark, d, "orders"), [a, b], "o_orderkey")


@_query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) r FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, doc_id % 3 c, doc_id % 5 = 0 w, len([x FOR x IN r IF regexp_matches(x, '^[A-Z]')]) h, len([x FOR x IN r IF contains(x, 'the')]) s, len([x FOR x IN r IF contains(x, 'and')]) a FROM l),
f AS (SELECT doc_id, w, CASE WHEN c = 0 AND trim(text) = '' THEN 'zero_candidates_without_text_evidence' WHEN c = 0 AND (h > 0 OR s >= 3 OR a >= 4) THEN 'zero_candidates_with_chart_text_signals' WHEN c < h THEN 'fewer_candidates_than_chart_heading_signals' END x FROM c)
SELECT doc_id, concat_ws(',', x, CASE WHEN w THEN 'candidate_requires_review' END) AS reasons FROM f""")
def chart_signal_reasons(spark, d):
    k = F.col("doc_id")
    reasons = compiled.review_reasons(F.col("text"), k % 3, k % 5 == 0, "^[A-Z]", "the", "and")
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(reasons, ",").alias("reasons"))


@_query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) n FROM documents WHERE regexp_matches(text, '^[A-M]')) WHERE n <= 6""")
def source_sampler(spark, d):
    return compiled.starts(_t(spark, d, "documents"), "source", "doc_id", "text", "^[A-M]").select("source", "doc_id")


_WORDS = ["the", "and", "les", "der", "que", "license", "ist", "with"]


@_query(f"""WITH u AS (SELECT doc_id, source, lang, source || ':' || lang || (doc_id % 7) g, sha256(doc_id::VARCHAR) h, [x FOR x IN {_WORDS} IF contains(text, x)] t FROM documents WHERE text IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY h, doc_id) n FROM u WHERE len(t) >= 2), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) m FROM a WHERE n = 1)
SELECT h[1:16] AS id, array_to_string(t[1:3], ' ') AS query, doc_id AS anchor_id, source, g AS "group", CASE WHEN ('0x' || sha256(g)[1:8])::BIGINT % 3 = 0 THEN 'holdout' ELSE 'development' END AS split FROM b WHERE m <= 12""")
def proxy_queries(spark, d):
    group = F.concat(F.col("source"), F.lit(":"), F.col("lang"), (F.col("doc_id") % 7).cast("string"))
    return evaluate.proxy_queries(_t(spark, d, "documents"), "doc_id", "source", group, "text", _WORDS)


@_query("""WITH r AS (SELECT l_orderkey q, CASE WHEN l_linenumber % 2 = 0 THEN 'bm25' ELSE 'hybrid' END mode, l_suppkey % 20 id, l_partkey % 5 source, l_orderkey % 20 anchor, l_orderkey % 5 asource, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey) rank FROM lineitem),
h AS (SELECT mode, q, k, bool_or(rank <= k AND id = anchor) a, bool_or(rank <= k AND source = asource) s, count(DISTINCT CASE WHEN rank <= k THEN source END) u FROM r, (SELECT unnest([1, 3]) k) GROUP BY ALL)
SELECT mode, k, count(*) AS n, round(avg(a::INT), 6) AS anchor_rate, round(avg(s::INT), 6) AS source_rate, round(avg(u), 6) AS mean_sources FROM h GROUP BY mode, k""")
def mode_ablation(spark, d):
    from pyspark.sql.window import Window

    # Ranked by the columns that are aggregated by, so the runs are shuffled once; lines without a number rank by themselves, after the others.
    w = Window.partitionBy("q", "mode").orderBy(F.asc_nulls_last("l_linenumber"), F.asc_nulls_last("l_partkey"))
    rank = F.row_number().over(w) - F.when(F.col("l_linenumber").isNull(), F.count("l_linenumber").over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0)
    k = F.col("l_orderkey")
    runs = _t(spark, d, "lineitem").select(k.alias("q"), F.when(F.col("l_linenumber") % 2 == 0, "bm25").otherwise("hybrid").alias("mode"), (F.col("l_suppkey") % 20).alias("id"), (F.col("l_partkey") % 5).alias("source"), (k % 20).alias("anchor_id"), (k % 5).alias("anchor_source"), "l_linenumber", "l_partkey").withColumn("rank", rank)
    out = evaluate.ablation(runs, "mode", "q", [1, 3])
    return out.select("mode", "k", "n", _r6("anchor_rate").alias("anchor_rate"), _r6("source_rate").alias("source_rate"), _r6("mean_sources").alias("mean_sources"))


@_query("""WITH r AS (SELECT l_orderkey q, l_orderkey % 4 e, l_suppkey % 4 t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) rank FROM lineitem)
SELECT q, coalesce(max(CASE WHEN rank = 1 THEN e = t END), false) AS top1, bool_or(e = t AND rank <= 3) AS topk FROM r GROUP BY q""")
def topic_agreement(spark, d):
    from pyspark.sql.window import Window

    # What line number and part leave open is in the order of the table, so that every run gives the same rows.
    w = Window.partitionBy("q").orderBy(F.asc_nulls_last("l_linenumber"), F.asc_nulls_last("l_partkey"), "_at")
    r = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_orderkey") % 4).alias("e"), (F.col("l_suppkey") % 4).alias("t"), "l_linenumber", "l_partkey", F.monotonically_increasing_id().alias("_at"))
    r = r.withColumn("rank", F.row_number().over(w))
    return evaluate.agreement(r, "q", "e", "t", "rank")


@_query("""WITH p AS (SELECT o_orderkey, 1.0::DOUBLE / (60 + o_custkey % 50) rrf FROM orders), h AS (SELECT * FROM p ORDER BY rrf DESC, o_orderkey LIMIT 40), w AS (SELECT l_orderkey o_orderkey, max(l_discount) s FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT row_number() OVER (ORDER BY s DESC NULLS LAST, rrf DESC, o_orderkey)::INTEGER AS place, o_orderkey, s AS rerank FROM h LEFT JOIN w USING (o_orderkey)""")
def rerank_order(spark, d):
    from pyspark.sql.window import Window

    pool = _t(spark, d, "orders").select("o_orderkey", (F.lit(1.0) / (60 + F.col("o_custkey") % 50)).alias("rrf"))
    windows = _t(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("score"))
    out = search.reranked(pool, "o_orderkey", windows, 12)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("rerank"), F.desc("rrf"), "o_orderkey"))).select("place", "o_orderkey", "rerank")


_RULES = "SELECT doc_id, source, doc_id % 40 AS g, (doc_id * 37) % 800 AS s, (doc_id * 37) % 800 + length(coalesce(text, '')) AS e, CASE WHEN doc_id % 6 = 0 THEN repeat(' ', length(coalesce(text, ''))) ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id % 2 = 1 OR doc_id % 6 = 0"


@_query(f"""WITH r AS ({_RULES}), c AS (SELECT source, (doc_id * 53) % 800 AS s, (doc_id * 53) % 800 + 9 AS e FROM documents WHERE doc_id % 10 = 5),
g AS (SELECT DISTINCT r.g FROM r JOIN c ON r.source = c.source AND r.s < c.e AND c.s < r.e WHERE trim(regexp_replace(substr(t, (greatest(r.s, c.s) - r.s + 1)::INTEGER, (least(r.e, c.e) - greatest(r.s, c.s))::INTEGER), '\\s+', ' ', 'g')) <> '')
SELECT doc_id AS evidence_id FROM r WHERE g IN (SELECT g FROM g)""")
def rule_exclusion(spark, d):
    k = F.col("doc_id")
    docs = _t(spark, d, "documents")
    whole = F.coalesce("text", F.lit(""))
    text = F.when(k % 6 == 0, F.repeat(F.lit(" "), F.char_length(whole))).otherwise(whole)
    rules = docs.where((k % 2 == 1) | (k % 6 == 0)).select(k.alias("evidence_id"), (k % 40).alias("group_id"), F.col("source").alias("source_id"), ((k * 37) % 800).alias("start"), ((k * 37) % 800 + F.char_length(whole)).alias("end"), text.alias("text"))
    cases = docs.where(k % 10 == 5).select(F.col("source").alias("source_id"), ((k * 53) % 800).alias("start"), ((k * 53) % 800 + 9).alias("end"))
    return search.blocked_rules(rules, cases)
