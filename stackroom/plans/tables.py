"""Queries: hydration, joins, aggregates, sorting, set operations, hierarchies, mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import dedup as D
from ..operators import hierarchy as H
from ..operators import hydrate as Y
from ..operators import mutate as M
from ..operators import reports as R
from ..session import staged, table

EAV_SQL = "(SELECT p_partkey, 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part WHERE p_size > 5)"


def eav(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.expr("stack(3, 'brand', p_brand, 'type', p_type, 'size', if(p_size > 5, cast(p_size as string), null)) AS (field, value)")).where("value IS NOT NULL")


@query("eav_pivot", f"SELECT p_partkey, max(value) FILTER (field = 'brand') AS brand, max(value) FILTER (field = 'size') AS size FROM {EAV_SQL} WHERE field IN ('brand', 'size') GROUP BY p_partkey")
def eav_pivot(spark, sf_dir):
    return Y.pivot_fields(eav(spark, sf_dir), "p_partkey", "field", "value", ["brand", "size"])


@query("field_map", f"SELECT p_partkey, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM {EAV_SQL} GROUP BY p_partkey")
def field_map(spark, sf_dir):
    m = Y.field_map(eav(spark, sf_dir), "p_partkey", "field", "value")
    return m.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


@query("base_field_resolve", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN p_type WHEN p_size > 5 THEN p_size::VARCHAR END AS size FROM part")
def base_field_resolve(spark, sf_dir):
    mapping = spark.createDataFrame([("Brand#1", "size", "type")], "p_brand string, base_field string, field string")
    return Y.resolve_base_field(eav(spark, sf_dir), table(spark, sf_dir, "part"), mapping, "size", "p_partkey", "p_brand", "field", "value")


@query("nest_ordered", "SELECT l_orderkey, string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY l_orderkey")
def nest_ordered(spark, sf_dir):
    nested = Y.nest_ordered(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey"], "lines")
    return nested.select("l_orderkey", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_partkey"], x["l_suppkey"])), ",").alias("lines"))


@query("full_hydrate", "SELECT o_orderkey, c_name, coalesce((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS n_lines, coalesce((SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS flags FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def full_hydrate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    nested = {"lines": Y.nest_ordered(lines, "o_orderkey", "l_linenumber", ["l_partkey"], "lines"), "flags": Y.nest_values(lines, "o_orderkey", "l_returnflag", "flags")}
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return Y.hydrate(orders, "o_orderkey", nested).select("o_orderkey", "c_name", F.size("lines").cast("long").alias("n_lines"), F.array_join("flags", ",").alias("flags"))


@query("children_of", "SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR), '') AS children FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def children_of(spark, sf_dir):
    """Two link tables (open and other orders); parents without children stay."""
    orders = table(spark, sf_dir, "orders")
    parents = table(spark, sf_dir, "customer").select("c_custkey")
    links = [orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus <> 'O'")]
    found = Y.children_of(parents, links, "c_custkey", "o_custkey", "o_orderkey")
    return found.select("c_custkey", F.array_join(F.array_sort(F.transform("children", lambda x: x.cast("string"))), ",").alias("children"))


@query("children_empty_parent", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def children_empty_parent(spark, sf_dir):
    found = Y.children_of(table(spark, sf_dir, "customer").select("c_custkey"), [table(spark, sf_dir, "orders")], "c_custkey", "o_custkey", "o_orderkey")
    return found.where(F.size("children") == 0).select("c_custkey")


@query("semi_scope", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_scope(spark, sf_dir):
    scope = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(scope, "c_nationkey", "left_semi").select("c_custkey")


@query("anti_trash", "SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
def anti_trash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("existence_or", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def existence_or(spark, sf_dir):
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Y.mark(table(spark, sf_dir, "orders"), returned, "o_orderkey", "returned").where("o_totalprice > 400000 OR returned").select("o_orderkey")


@query("or_join_split", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey OR c_nationkey = s_suppkey")
def or_join_split(spark, sf_dir):
    return Y.join_either(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), ("c_custkey", "s_suppkey"), ("c_nationkey", "s_suppkey"), "c_custkey").select("c_custkey", "s_suppkey")


@query("two_hop", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(c_name, o_orderkey::VARCHAR, '?') AS owner FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'")
def two_hop(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return Y.two_hop(rows, table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), "l_orderkey", "o_orderkey", "o_custkey", "c_custkey", {"owner": "coalesce(c_name, cast(o_orderkey as string), '?')"})


@query("lookup_default", "SELECT o_orderkey, coalesce(c_name, '(parent key: ' || o_custkey || ')') AS title FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey")
def lookup_default(spark, sf_dir):
    return Y.lookup_default(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey", "c_name").select("o_orderkey", "title")


def edges(spark, sf_dir):
    """Region -> nation -> customer as a forest, with a cycle of two and a node whose parent is missing."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    odd = spark.createDataFrame([("x1", "x2", "X1"), ("x2", "x1", "X2"), ("y", "gone", "Y")], "key string, parent string, name string")
    return region.unionByName(nation).unionByName(customer).unionByName(odd)


EDGES = "(SELECT 'r' || r_regionkey AS key, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer UNION ALL SELECT * FROM (VALUES ('x1', 'x2', 'X1'), ('x2', 'x1', 'X2'), ('y', 'gone', 'Y')) v(a, b, c))"


@query("closure", f"WITH RECURSIVE e AS {EDGES}, t(ancestor, node) AS (SELECT key, key FROM e UNION SELECT e.parent, e.key FROM e WHERE parent IS NOT NULL UNION SELECT t.ancestor, e.key FROM t JOIN e ON e.parent = t.node) SELECT ancestor, node FROM t")
def closure(spark, sf_dir):
    return H.closure(edges(spark, sf_dir))


@query("closure_cycle", "SELECT * FROM (VALUES ('x1', 'x1'), ('x1', 'x2'), ('x2', 'x1'), ('x2', 'x2')) v(ancestor, node)")
def closure_cycle(spark, sf_dir):
    return H.closure(edges(spark, sf_dir).where("key LIKE 'x%'"))


@query("paths", f"WITH e AS {EDGES} SELECT a.key AS node, concat_ws('/', CASE WHEN a.key LIKE 'x%' THEN NULL ELSE c.name END, CASE WHEN a.key = 'y' THEN NULL ELSE b.name END, a.name) AS path FROM e a LEFT JOIN e b ON a.parent = b.key LEFT JOIN e c ON b.parent = c.key")
def paths(spark, sf_dir):
    return H.paths(edges(spark, sf_dir)).select("node", F.array_join("path", "/").alias("path"))


@query("subtree_items", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def subtree_items(spark, sf_dir):
    filed = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("collection"))
    return H.in_subtree(table(spark, sf_dir, "orders"), filed, edges(spark, sf_dir), "r2", "o_orderkey", "collection").select("o_orderkey")


@query("resolve_paths", f"WITH e AS {EDGES} SELECT 0 AS position, 'r1' AS spec, 1::BIGINT AS matches, 'r1' AS node UNION ALL SELECT 1, 'nothing/here', 0, NULL UNION ALL SELECT 2, 'X1', 1, 'x1'")
def resolve_paths(spark, sf_dir):
    return H.resolve(edges(spark, sf_dir), ["r1", "nothing/here", "X1"])


@query("self_join_parent", "SELECT n.n_nationkey, r.r_name AS parent FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3")
def self_join_parent(spark, sf_dir):
    e = edges(spark, sf_dir)
    up = e.select(F.col("key").alias("parent"), F.col("name").alias("parent_name")).where("parent < 'r3'")
    found = e.where("key LIKE 'n%'").join(up, "parent", "left")
    return found.select(F.substring("key", 2, 9).cast("int").alias("n_nationkey"), F.col("parent_name").alias("parent"))


@query("reconcile_full_outer", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'unexpected' WHEN b.doc_id IS NULL THEN 'missing' ELSE 'imported' END AS status FROM (SELECT doc_id FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def reconcile(spark, sf_dir):
    return Y.reconcile(table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "labels"), "doc_id")


@query("related_items", "SELECT p_partkey AS src, p_partkey + 1 AS related_key FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)")
def related_items(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    uri = F.format_string("http://host/users/1/items/%08d", (F.col("p_partkey") + 1).cast("long"))
    rel = part.select(F.col("p_partkey").alias("src"), F.lit(1).alias("position"), uri.alias("uri")).unionByName(part.select(F.col("p_partkey").alias("src"), F.lit(2).alias("position"), F.replace(uri, F.lit("users/1"), F.lit("groups/7")).alias("uri")))
    known = part.select(F.format_string("%08d", F.col("p_partkey").cast("long")).alias("key"))
    return Y.related(known, rel, "src", "position", "uri", "key").select("src", F.col("related_key").cast("long").alias("related_key"))


@query("lib_counts", "SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def lib_counts(spark, sf_dir):
    return R.counts_per(table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey").select("n_nationkey", "n_name", "n")


@query("string_agg", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def string_agg(spark, sf_dir):
    return R.string_agg(table(spark, sf_dir, "nation"), "n_regionkey", F.col("n_name"), ["n_nationkey"], out="names")


@query("distinct_tags", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part")
def distinct_tags(spark, sf_dir):
    return R.distinct_values(table(spark, sf_dir, "part"), F.split("p_name", " "))


@query("tag_index", "SELECT upper(substr(tag, 1, 1)) AS letter, count(*) AS n, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1")
def tag_index(spark, sf_dir):
    return R.letter_index(R.distinct_values(table(spark, sf_dir, "part"), F.split("p_name", " ")), "tag").withColumn("tags", F.array_join("tags", ","))


_HAS = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


@query("coverage", f"SELECT count(*) AS scanned, count(*) FILTER ({_HAS}) AS covered, count(*) FILTER (NOT {_HAS}) AS missing, round(100.0 * count(*) FILTER ({_HAS}) / count(*), 1)::DOUBLE AS percent FROM orders")
def coverage(spark, sf_dir):
    return R.coverage(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_returnflag") == "R")


@query("coverage_missing", f"SELECT o_orderkey FROM orders WHERE NOT {_HAS} ORDER BY o_orderkey LIMIT 50")
def coverage_missing(spark, sf_dir):
    return R.uncovered(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_returnflag") == "R")


@query("attachment_summary", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has_main, count(*) FILTER (l_linestatus <> 'O') AS attachments, bool_or(l_linestatus = 'O') AS has_notes FROM lineitem GROUP BY l_orderkey")
def attachment_summary(spark, sf_dir):
    return R.child_summary(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")


@query("synthesize", "SELECT conv_id, count(*) AS n_notes, string_agg(t, '|' ORDER BY t) AS notes FROM (SELECT conv_id, CASE WHEN length(trim(text)) > 40 THEN substr(trim(text), 1, 40) || '...' ELSE trim(text) END AS t FROM conversations WHERE role = 'user' AND trim(text) <> '') GROUP BY conv_id")
def synthesize(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return R.synthesize(c.select("conv_id").distinct(), c.where("role = 'user'"), "conv_id", "conv_id", F.col("text"), 40).withColumn("notes", F.array_join("notes", "|"))


@query("outcomes", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def outcomes(spark, sf_dir):
    return R.outcomes(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("enrich", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def enrich(spark, sf_dir):
    facts = table(spark, sf_dir, "labels").select(F.concat(F.lit("DOC"), "doc_id").alias("k"), "quality", "toxic")
    return R.enrich(table(spark, sf_dir, "documents").select("doc_id"), facts, F.concat(F.lit("doc"), "doc_id"), "k")


@query("flag_notices", "SELECT o_orderkey, count(*) AS notices FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey")
def flag_notices(spark, sf_dir):
    return R.flagged(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "o_orderkey", "l_orderkey")


@query("citation_graph", """
(SELECT 'reference' AS direction, l_suppkey AS work, p AS cited_by, s_nationkey < 12 AS in_library FROM (SELECT l_suppkey, min(l_linenumber) AS p FROM lineitem WHERE l_orderkey = 7 GROUP BY l_suppkey) JOIN supplier ON s_suppkey = l_suppkey ORDER BY p, l_suppkey LIMIT 20)""")
def citation_graph(spark, sf_dir):
    edges_ = table(spark, sf_dir, "lineitem").where("l_orderkey = 7").groupBy(F.col("l_orderkey").alias("citing"), F.col("l_suppkey").alias("cited")).agg(F.min("l_linenumber").alias("position"))
    works = edges_.select(F.col("cited").alias("work"), F.col("position").alias("cited_by")).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("work")), "work")
    held = table(spark, sf_dir, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("work"))
    found = R.citation_neighbours(edges_, works, held, 7)
    return found.where("direction = 'reference'").select("direction", "work", "cited_by", "in_library")


@query("recent_topk", "SELECT o_orderkey, c_name FROM (SELECT * FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 25) LEFT JOIN customer ON o_custkey = c_custkey")
def recent_topk(spark, sf_dir):
    narrow = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("c_custkey"))
    return Y.top_k_then(narrow, [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")], 25, "c_custkey", [table(spark, sf_dir, "customer")]).select("o_orderkey", "c_name")


@query("page_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def page_offset(spark, sf_dir):
    return Y.top_k_then(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], 20, "o_orderkey", [], 40)


@query("sort_creator", "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 30")
def sort_creator(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.lower(F.coalesce("c_name", F.lit(""))), "c_custkey").limit(30).select("c_custkey", "c_name")


@query("typed_listing", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100")
def typed_listing(spark, sf_dir):
    from ..operators.search import of_type, order_by

    return order_by(of_type(table(spark, sf_dir, "orders"), "f", "o_orderstatus"), [("o_orderdate", "desc")], "o_orderkey").limit(100).select("o_orderkey")


@query("union_links", "SELECT o_custkey AS parent, o_orderkey AS child FROM orders UNION ALL SELECT l_orderkey, l_partkey FROM lineitem")
def union_links(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"))
    return a.unionByName(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").alias("child")))


@query("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query("set_union_arrays", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['new', 'red']))), ',') AS tags FROM part")
def set_union_arrays(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.array(F.lit("new"), F.lit("red")))), ",").alias("tags"))


@query("union_distinct_key", "SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels)")
def union_distinct_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").unionByName(table(spark, sf_dir, "labels").select("doc_id")).dropDuplicates(["doc_id"])


# Duplicates -----------------------------------------------------------------------------------------

_NORM = r"trim(regexp_replace(lower(text), '[^a-zà-ÿ0-9]+', ' ', 'g'))"
_DOCS = f"(SELECT d.*, md5({_NORM}) AS k FROM documents d)"


def keyed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("k", F.md5(F.trim(F.regexp_replace(F.lower("text"), "[^a-zà-ÿ0-9]+", " "))))


def _members(spark, sf_dir):
    """The keys are computed once and written: the plans read them several times."""
    docs = staged(keyed(spark, sf_dir).drop("text"), "keyed")
    groups = D.duplicate_groups(D.match_keys(docs, "doc_id", {"text": F.col("k")}), "doc_id")
    return docs.join(groups.select(F.col("value").alias("k")), "k", "left_semi")


@query("dup_groups", f"SELECT 'text' AS kind, k AS value, count(DISTINCT doc_id) AS n, min(doc_id) AS first_key FROM {_DOCS} GROUP BY k HAVING count(DISTINCT doc_id) > 1")
def dup_groups(spark, sf_dir):
    return D.duplicate_groups(D.match_keys(keyed(spark, sf_dir), "doc_id", {"text": F.col("k")}), "doc_id")


@query("dup_page", f"SELECT k AS value, count(DISTINCT doc_id) AS n FROM {_DOCS} GROUP BY k HAVING count(DISTINCT doc_id) > 1 ORDER BY k LIMIT 10 OFFSET 5")
def dup_page(spark, sf_dir):
    return D.group_page(dup_groups(spark, sf_dir), 5, 10).select("value", "n")


@query("match_keys", "SELECT p_partkey, 'name' AS kind, p_name AS value FROM part UNION SELECT p_partkey, 'word', unnest(string_split(p_name, ' ')) FROM part")
def match_keys(spark, sf_dir):
    return D.match_keys(table(spark, sf_dir, "part"), "p_partkey", {"name": F.col("p_name"), "word": F.split("p_name", " ")})


@query("keeper_rank", f"SELECT k, doc_id FROM {_DOCS} WHERE k IN (SELECT k FROM {_DOCS} GROUP BY k HAVING count(DISTINCT doc_id) > 1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n_chars DESC, source, doc_id) = 1")
def keeper_rank(spark, sf_dir):
    return D.keepers(_members(spark, sf_dir), ["k"], [-F.col("n_chars"), F.col("source"), F.col("doc_id")]).select("k", "doc_id")


@query("auto_merge_qualify", f"SELECT k, count(DISTINCT doc_id) AS n, count(DISTINCT lang) AS kinds, count(DISTINCT source) AS ids, CASE WHEN count(DISTINCT lang) > 1 THEN 'mixed types' WHEN count(DISTINCT source) > 1 THEN 'differing identifiers' ELSE 'ok' END AS verdict FROM {_DOCS} GROUP BY k HAVING count(DISTINCT doc_id) > 1")
def auto_merge_qualify(spark, sf_dir):
    return D.qualify(_members(spark, sf_dir), ["k"], "doc_id", "lang", "source")


@query("merge_overlap")
def merge_overlap(spark, sf_dir):
    """The result depends on an order of decisions, which SQL can't express; tests use a loop."""
    docs = keyed(spark, sf_dir).select("doc_id", "k", F.md5(F.substring_index("text", "\n", 1)).alias("head"))
    keys = D.match_keys(docs, "doc_id", {"text": F.col("k"), "head": F.col("head")})
    groups = D.duplicate_groups(keys, "doc_id").select("kind", "value")
    m = keys.join(groups, ["kind", "value"], "left_semi").select(F.concat_ws(":", "kind", "value").alias("g"), F.col("doc_id").alias("item"))
    return D.standing_groups(m, "g", "item")


@query("merge_plan", f"""WITH m AS (SELECT k, doc_id, [source, lang] AS tags FROM {_DOCS} WHERE k IN (SELECT k FROM {_DOCS} GROUP BY k HAVING count(DISTINCT doc_id) > 1)),
keep AS (SELECT k, min(doc_id) AS keeper, arg_min(tags, doc_id) AS own FROM m GROUP BY k),
r AS (SELECT m.k, keeper, own, m.doc_id, unnest(tags) AS t FROM m JOIN keep USING (k) WHERE m.doc_id <> keeper)
SELECT k, keeper, count(DISTINCT doc_id) AS duplicates, coalesce(string_agg(DISTINCT t, ',' ORDER BY t) FILTER (NOT list_contains(own, t)), '') AS add_tags FROM r GROUP BY k, keeper""")
def merge_plan(spark, sf_dir):
    m = _members(spark, sf_dir).select("k", "doc_id", F.array("source", "lang").alias("tags"))
    plan = D.merge_plan(m, D.keepers(m, ["k"], [F.col("doc_id")]), "k", "doc_id", "tags")
    return plan.withColumn("add_tags", F.array_join("add_tags", ","))


@query("plan_token")
def plan_token(spark, sf_dir):
    return D.plan_token(merge_plan(spark, sf_dir), ["k", "keeper", "duplicates", "add_tags"])


@query("preprint_suppress", f"SELECT doc_id FROM {_DOCS} a WHERE NOT (source = 'src1' AND EXISTS (SELECT 1 FROM {_DOCS} b WHERE b.k = a.k AND b.source <> 'src1'))")
def preprint_suppress(spark, sf_dir):
    docs = keyed(spark, sf_dir)
    keys = D.match_keys(docs, "doc_id", {"text": F.col("k")})
    return D.suppress(docs, keys, "doc_id", F.col("source") == "src1", F.col("source") != "src1").select("doc_id")


@query("first_occurrence", "SELECT event_id, min(event_id) OVER (PARTITION BY user_id) AS first_position FROM events")
def first_occurrence(spark, sf_dir):
    return D.first_of_each(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "first_position")


# Mutation -------------------------------------------------------------------------------------------


@query("bulk_tag_update", "SELECT p_partkey, array_to_string(list_sort(CASE WHEN p_size > 25 THEN list_filter(list_distinct(list_append(string_split(p_name, ' '), 'big')), lambda x: x <> 'red') ELSE string_split(p_name, ' ') END), ',') AS tags FROM part")
def bulk_tag_update(spark, sf_dir):
    out = M.update_tags(table(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " ")), F.col("p_size") > 25, "tags", ["big"], ["red"])
    return out.select("p_partkey", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("bulk_tag_counts", "SELECT 'big' AS tag, 'add' AS action, count(*) FILTER (NOT list_contains(string_split(p_name, ' '), 'big')) AS n FROM part WHERE p_size > 25 UNION ALL SELECT 'red', 'remove', count(*) FILTER (list_contains(string_split(p_name, ' '), 'red')) FROM part WHERE p_size > 25")
def bulk_tag_counts(spark, sf_dir):
    return M.tag_counts(table(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " ")), F.col("p_size") > 25, "tags", ["big"], ["red"])


@query("extra_edit", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'type: ' || p_type || chr(10) || 'status: done' ELSE 'brand: ' || p_brand || chr(10) || 'type: ' || p_type END AS extra FROM part")
def extra_edit(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("extra", F.concat(F.lit("brand: "), "p_brand", F.lit("\ntype: "), "p_type"))
    return M.edit_extra(part, F.col("p_size") > 25, "extra", {"status": "done"}, ["Brand"]).select("p_partkey", "extra")


@query("relation_edges", "SELECT src, dst FROM (SELECT o_custkey AS src, o_custkey + 1 AS dst FROM orders UNION SELECT o_custkey + 1, o_custkey FROM orders) WHERE NOT (src = 1 AND dst = 2) AND NOT (src = 2 AND dst = 1)")
def relation_edges(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.lit("dc:relation").alias("predicate"), (F.col("o_custkey") + 1).alias("dst"))
    edges_ = M.add_relations(pairs.limit(0), pairs)
    gone = spark.createDataFrame([(1, "dc:relation", 2)], "src long, predicate string, dst long")
    return M.remove_relations(edges_, gone).select("src", "dst")


@query("membership_edit", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0 UNION SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 7 = 0")
def membership_edit(spark, sf_dir):
    filed = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sevens = filed.where("o_orderkey % 7 = 0")
    return M.file_items(M.unfile_items(filed, sevens, "o_orderkey", "o_custkey"), sevens.withColumn("o_custkey", F.lit(0).cast("long")), "o_orderkey", "o_custkey")


@query("reparent_children", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT CASE WHEN l_orderkey % 10 = 3 THEN l_orderkey - 1 ELSE l_orderkey END AS l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)")
def reparent_children(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    moves = lines.select("l_orderkey").distinct().where("l_orderkey % 10 = 3").withColumn("new_parent", F.col("l_orderkey") - 1)
    return M.reparent(lines, moves, "l_orderkey", "new_parent")


@query("trash_items", "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE lang = 'es'")
def trash_items(spark, sf_dir):
    bin_ = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents")
    return M.trash(docs, bin_, docs.where("lang = 'es'"), "doc_id")


@query("import_outcomes", "SELECT CASE WHEN k IN (SELECT doc_id FROM labels) THEN 'converged' ELSE 'created' END AS outcome, count(*) AS n FROM (SELECT CASE WHEN lang = 'fr' THEN NULL ELSE doc_id END AS k FROM documents) GROUP BY 1")
def import_outcomes(spark, sf_dir):
    library = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("match"), F.col("doc_id").alias("key"), F.array(F.lit("old")).alias("tags"))
    incoming = table(spark, sf_dir, "documents").select(F.when(F.col("lang") != "fr", F.col("doc_id")).alias("match"), F.array("source").alias("tags"))
    return R.outcomes(M.import_batch(library, incoming, "match", "key", "tags", "converge"), "outcome")
