"""Queries through the library object: a library whose works are the documents, whose attachments are the
pages and whose notes are the turns of the conversations, filed in nations below regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..library import Library
from ..operators.mutate import delete_nodes
from ..session import table

_WITH = """WITH works AS (SELECT 'D' || doc_id AS key, CASE lang WHEN 'de' THEN 'case' WHEN 'fr' THEN 'report' ELSE 'journalArticle' END AS item_type, CASE WHEN lang = 'es' THEN 7 ELSE 0 END AS group_id,
  lpad(doc_id::VARCHAR, 9, '0') AS date_added, lpad(n_chars::VARCHAR, 9, '0') AS date_modified, substr(split_part(text, chr(10), 1), 1, 60) AS title, (2000 + doc_id % 24) || '-05-00 05/' || (2000 + doc_id % 24) AS date,
  '10.1000/' || (doc_id // 2) AS doi, 'Name' || (doc_id % 50) AS last, lang, source, doc_id FROM documents),
trash AS (SELECT 'D' || doc_id AS key FROM labels WHERE toxic = 1),
live AS (SELECT * FROM works WHERE group_id = 0 AND key NOT IN (SELECT key FROM trash)),
tags AS (SELECT key, lang AS tag FROM works UNION SELECT key, source FROM works),
filed AS (SELECT key, 'n' || (doc_id % 25) AS collection FROM works),
notes AS (SELECT 'N' || conv_id || '-' || turn AS key, 'D' || conv_id AS parent, text AS note FROM conversations),
files AS (SELECT 'P' || page_id AS key, 'D' || page_id AS parent, CASE WHEN page_id % 3 = 0 THEN 'application/pdf' ELSE 'text/html' END AS mime FROM pages)
"""


def library(spark, sf_dir, scope: int | None = 0) -> Library:
    docs = table(spark, sf_dir, "documents").withColumn("key", F.concat(F.lit("D"), "doc_id"))
    none = F.lit(None).cast("string")
    kind = F.when(F.col("lang") == "de", "case").when(F.col("lang") == "fr", "report").otherwise("journalArticle")
    works = docs.select("key", kind.alias("item_type"), F.when(F.col("lang") == "es", 7).otherwise(0).cast("long").alias("group_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("date_added"), F.lpad(F.col("n_chars").cast("string"), 9, "0").alias("date_modified"), none.alias("parent"), none.alias("note"), none.alias("filename"), none.alias("mime"))

    def child(df, key, parent, item_type, note, mime):
        return df.select(key.alias("key"), F.lit(item_type).alias("item_type"), F.lit(0).cast("long").alias("group_id"), none.alias("date_added"), none.alias("date_modified"), F.concat(F.lit("D"), parent).alias("parent"), note.alias("note"), none.alias("filename"), mime.alias("mime"))

    notes = child(table(spark, sf_dir, "conversations"), F.concat(F.lit("N"), "conv_id", F.lit("-"), "turn"), F.col("conv_id"), "note", F.col("text"), none)
    files = child(table(spark, sf_dir, "pages"), F.concat(F.lit("P"), "page_id"), F.col("page_id"), "attachment", none, F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("text/html"))
    year = F.col("doc_id") % 24 + 2000
    values = {
        "title": F.when(F.col("lang") != "de", F.substring(F.substring_index("text", "\n", 1), 1, 60)),
        "caseName": F.when(F.col("lang") == "de", F.substring(F.substring_index("text", "\n", 1), 1, 60)),
        "date": F.concat(year, F.lit("-05-00 05/"), year),
        "DOI": F.concat(F.lit("10.1000/"), F.floor(F.col("doc_id") / 2)),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in values.items()]))
    fields = docs.select("key", pairs.alias("x")).select("key", "x.field", "x.value").where("value IS NOT NULL")
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), none.alias("parent"), F.col("r_name").alias("name"))
    tables = {
        "items": works.unionByName(notes).unionByName(files),
        "fields": fields,
        "creators": docs.select("key", F.lit(0).alias("position"), none.alias("first"), F.concat(F.lit("Name"), F.col("doc_id") % 50).alias("last"), none.alias("name")),
        "tags": docs.select("key", F.col("lang").alias("tag")).unionByName(docs.select("key", F.col("source").alias("tag"))),
        "collections": nation.unionByName(region).withColumn("group_id", F.lit(0).cast("long")),
        "membership": docs.select(F.col("key").alias("item"), F.concat(F.lit("n"), F.col("doc_id") % 25).alias("collection")),
        "trash": table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("D"), "doc_id").alias("key")),
        "libraries": spark.createDataFrame([(0, "user", "Mine"), (7, "group", "Team")], "group_id long, kind string, name string"),
    }
    return Library(spark, tables, scope)


@query("lib_item_count", _WITH + "SELECT count(*) AS n FROM live")
def lib_item_count(spark, sf_dir):
    return library(spark, sf_dir).item_count()


@query("lib_libraries", _WITH + "SELECT group_id, CASE group_id WHEN 0 THEN 'Mine' ELSE 'Team' END AS name, count(*) AS n_items FROM works GROUP BY group_id")
def lib_libraries(spark, sf_dir):
    return library(spark, sf_dir).list_libraries().select("group_id", "name", "n_items")


@query("lib_key_groups", _WITH + "SELECT key, group_id FROM works UNION ALL SELECT key, 0 FROM notes UNION ALL SELECT key, 0 FROM files")
def lib_key_groups(spark, sf_dir):
    return library(spark, sf_dir).key_groups()


@query("lib_wide", _WITH + "SELECT key, title, date, doi AS \"DOI\", last, (SELECT string_agg(tag, ',' ORDER BY tag) FROM tags t WHERE t.key = w.key) AS tags FROM works w WHERE group_id = 0")
def lib_wide(spark, sf_dir):
    """Every item of the scope, trash included; a case's name is its title."""
    wide = library(spark, sf_dir).wide.where("item_type NOT IN ('note', 'attachment')")
    return wide.select("key", "title", "date", "DOI", F.col("creators")[0]["last"].alias("last"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("lib_advanced_all", _WITH + "SELECT key FROM live WHERE lower(last) = 'name7' AND lang = 'en' AND date >= '2005' ORDER BY key LIMIT 500")
def lib_advanced_all(spark, sf_dir):
    conditions = [{"field": "creator", "operation": "is", "value": "name7"}, {"field": "tag", "operation": "is", "value": "EN"}, {"field": "year", "operation": "isAfter", "value": "2004"}]
    return library(spark, sf_dir).advanced_search(conditions, limit=500).select("key")


@query("lib_advanced_any", _WITH + "SELECT key FROM live WHERE item_type = 'report' OR contains(lower(title), 'thand') ORDER BY key LIMIT 500")
def lib_advanced_any(spark, sf_dir):
    conditions = [{"field": "itemType", "operation": "is", "value": "report"}, {"field": "title", "operation": "contains", "value": "Thand"}]
    return library(spark, sf_dir).advanced_search(conditions, "any", limit=500).select("key")


@query("lib_advanced_not", _WITH + "SELECT key FROM live WHERE lower(last) <> 'name7' AND (SELECT count(*) FROM filed f WHERE f.key = live.key AND collection = 'n3') = 0 ORDER BY key LIMIT 500")
def lib_advanced_not(spark, sf_dir):
    conditions = [{"field": "creator", "operation": "isNot", "value": "NAME7"}, {"field": "collection", "operation": "isNot", "value": "n3"}]
    return library(spark, sf_dir).advanced_search(conditions, limit=500).select("key")


@query("lib_subtree_search", _WITH + "SELECT key FROM live JOIN filed USING (key) JOIN nation ON collection = 'n' || n_nationkey WHERE n_regionkey = 2 ORDER BY key LIMIT 500")
def lib_subtree_search(spark, sf_dir):
    return library(spark, sf_dir).advanced_search([{"field": "collection", "operation": "is", "value": "r2"}], limit=500, include_subcollections=True).select("key")


@query("lib_search_items", _WITH + "SELECT key FROM live WHERE contains(lower(title), 'thand') OR contains(date, 'thand') OR contains(lower(last), 'thand') ORDER BY date_modified DESC, key LIMIT 50")
def lib_search_items(spark, sf_dir):
    return library(spark, sf_dir).search_items("Thand", limit=50).select("key")


@query("lib_search_by_tag", _WITH + "SELECT key FROM live JOIN filed USING (key) JOIN nation ON collection = 'n' || n_nationkey WHERE n_regionkey = 1 AND (lang = 'en' OR lang = 'fr') AND source <> 'src1' ORDER BY date_modified DESC, key LIMIT 100")
def lib_search_by_tag(spark, sf_dir):
    return library(spark, sf_dir).search_by_tag(["en OR fr", "-src1"], collection="r1", limit=100).select("key")


@query("lib_recent", _WITH + "SELECT key, title FROM live ORDER BY date_added DESC, key LIMIT 40")
def lib_recent(spark, sf_dir):
    return library(spark, sf_dir).get_recent(40).select("key", "title")


@query("lib_children", _WITH + "SELECT key, (SELECT count(*) FROM notes n WHERE n.parent = works.key) + (SELECT count(*) FROM files f WHERE f.parent = works.key) AS n FROM works WHERE group_id = 0")
def lib_children(spark, sf_dir):
    lib = library(spark, sf_dir)
    return lib.get_children(lib.wide.where("item_type NOT IN ('note', 'attachment')").select("key")).select("key", F.size("children").cast("long").alias("n"))


@query("lib_collection_items", _WITH + "SELECT key FROM live JOIN filed USING (key) JOIN nation ON collection = 'n' || n_nationkey WHERE n_regionkey = 3 ORDER BY key LIMIT 100 OFFSET 20")
def lib_collection_items(spark, sf_dir):
    return library(spark, sf_dir).get_collection_items("r3", True, 100, 20).select("key")


@query("lib_collections", "SELECT 'n' || n_nationkey AS key, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def lib_collections(spark, sf_dir):
    return library(spark, sf_dir).get_collections().select("key", F.array_join("path", "/").alias("path"))


@query("lib_tags", _WITH + "SELECT DISTINCT tag FROM tags JOIN works USING (key) WHERE group_id = 0")
def lib_tags(spark, sf_dir):
    return library(spark, sf_dir).get_tags()


@query("lib_tag_index", _WITH + "SELECT upper(substr(tag, 1, 1)) AS letter, count(DISTINCT tag) AS n FROM tags JOIN works USING (key) WHERE group_id = 0 GROUP BY 1")
def lib_tag_index(spark, sf_dir):
    return library(spark, sf_dir).tag_index().select("letter", "n")


@query("lib_notes", _WITH + "SELECT key, parent, substr(note, 1, 500) AS note FROM notes ORDER BY key LIMIT 200")
def lib_notes(spark, sf_dir):
    return library(spark, sf_dir).get_notes(limit=200)


@query("lib_duplicates", _WITH + "SELECT 'doi' AS kind, doi AS value, count(*) AS n, min(key) AS first_key FROM live GROUP BY doi HAVING count(*) > 1 ORDER BY value LIMIT 50 OFFSET 3")
def lib_duplicates(spark, sf_dir):
    return library(spark, sf_dir).find_duplicates("doi", 3, 50)


@query("lib_find_existing", _WITH + "SELECT page_id::VARCHAR AS candidate, key FROM pages JOIN live ON doi = '10.1000/' || page_id")
def lib_find_existing(spark, sf_dir):
    """Of every page, as a candidate with an identifier, the works that the library has."""
    candidates = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("candidate"), F.lit("doi").alias("kind"), F.concat(F.lit("10.1000/"), "page_id").alias("value"))
    return library(spark, sf_dir).find_existing(candidates).select("candidate", "key")


@query("lib_coverage", _WITH + "SELECT count(*) AS scanned, count(*) FILTER (key IN (SELECT parent FROM files WHERE mime = 'application/pdf')) AS covered, count(*) FILTER (key NOT IN (SELECT parent FROM files WHERE mime = 'application/pdf')) AS missing, round(100.0 * count(*) FILTER (key IN (SELECT parent FROM files WHERE mime = 'application/pdf')) / count(*), 1) AS percent FROM live")
def lib_coverage(spark, sf_dir):
    return library(spark, sf_dir).coverage()


@query("lib_enrich", _WITH + "SELECT key, n_regionkey AS fact FROM live LEFT JOIN nation ON doi = '10.1000/' || n_nationkey WHERE n_regionkey IS NOT NULL")
def lib_enrich(spark, sf_dir):
    facts = table(spark, sf_dir, "nation").select(F.concat(F.lit("10.1000/"), "n_nationkey").alias("doi"), F.col("n_regionkey").alias("fact"))
    return library(spark, sf_dir).enrich(facts).where("fact IS NOT NULL").select("key", "fact")


_MORE = """, marks AS (SELECT 'A' || page_id AS key, 'P' || page_id AS parent, 'D' || page_id AS work, url AS text FROM pages),
entries AS (SELECT 'F' || item_id AS key, lpad(item_id::VARCHAR, 9, '0') AS date_added, substr(text, 1, 40) AS title FROM benchmark)
"""


def extended(spark, sf_dir, scope: int | None = 0) -> Library:
    """The library with an annotation on every page, a feed whose items are the benchmark's, and relations
    between regions and nations, each under both forms of an address."""
    lib, none = library(spark, sf_dir, scope), F.lit(None).cast("string")
    kinds = dict(lib.tables["items"].dtypes)

    def items(df, **given):
        return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    pages, bench = table(spark, sf_dir, "pages"), table(spark, sf_dir, "benchmark")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    mark, entry = F.concat(F.lit("A"), "page_id"), F.concat(F.lit("F"), "item_id")
    place = F.concat(F.lit("NAT"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0"))
    added = [
        items(pages, key=mark, item_type=F.lit("annotation"), group_id=F.lit(0), parent=F.concat(F.lit("P"), "page_id")),
        items(bench, key=entry, item_type=F.lit("journalArticle"), group_id=F.lit(99), date_added=F.lpad(F.col("item_id").cast("string"), 9, "0")),
        items(nation, key=place, item_type=F.lit("map"), group_id=F.lit(0)),
    ]
    fields = [
        pages.select(mark.alias("key"), F.lit("annotationText").alias("field"), F.col("url").alias("value")),
        bench.select(entry.alias("key"), F.lit("title").alias("field"), F.substring("text", 1, 40).alias("value")),
        nation.select(place.alias("key"), F.lit("title").alias("field"), F.col("n_name").alias("value")),
    ]
    predicate = F.when(F.col("n_nationkey") % 2 == 0, "dc:relation").otherwise("owl:sameAs")
    forms = F.explode(F.array(F.concat(F.lit("http://lib.example/users/1/items/"), place), F.concat(F.lit("http://lib.example/groups/7/items/"), place)))
    tables = dict(lib.tables)
    for rows in added:
        tables["items"] = tables["items"].unionByName(rows)
    for rows in fields:
        tables["fields"] = tables["fields"].unionByName(rows)
    tables["relations"] = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("key"), F.col("n_nationkey").cast("int").alias("position"), predicate.alias("predicate"), forms.alias("uri"))
    tables["feeds"] = region.select((F.col("r_regionkey") + 99).cast("long").alias("group_id"), F.col("r_name").alias("name"), F.lit("http://feed.example").alias("url"), none.alias("last_check"), none.alias("last_update"), none.alias("last_error"), F.lit(60).alias("refresh_interval"))
    tables["feed_items"] = bench.select(entry.alias("key"), none.alias("read_time"), none.alias("translated_time"))
    return Library(spark, tables, scope)


@query("lib_annotations", _WITH + _MORE + "SELECT m.key, m.parent, m.work, m.text AS \"annotationText\", w.title AS work_title FROM marks m LEFT JOIN (SELECT * FROM works WHERE group_id = 0) w ON w.key = m.work")
def lib_annotations(spark, sf_dir):
    return extended(spark, sf_dir).get_annotations().select("key", "parent", "work", "annotationText", "work_title")


@query("lib_annotations_of", _WITH + _MORE + "SELECT key, parent FROM marks WHERE work = 'D17'")
def lib_annotations_of(spark, sf_dir):
    return extended(spark, sf_dir).get_annotations("D17").select("key", "parent")


@query("lib_notes_and_annotations", _WITH + _MORE + "SELECT key, parent, kind FROM (SELECT * FROM (SELECT key, parent, 'note' AS kind FROM notes WHERE contains(lower(note), 'com') ORDER BY key LIMIT 15) UNION ALL SELECT * FROM (SELECT key, parent, 'annotation' FROM marks WHERE contains(lower(text), 'com') ORDER BY key LIMIT 15)) ORDER BY kind DESC, key LIMIT 15")
def lib_notes_and_annotations(spark, sf_dir):
    return extended(spark, sf_dir).search_notes_and_annotations("com", 15).select("key", "parent", "kind")


@query("lib_attachment", _WITH + "SELECT f.key, f.parent, mime, title AS work_title FROM files f LEFT JOIN (SELECT * FROM works WHERE group_id = 0) w ON w.key = f.parent WHERE f.key = 'P21'")
def lib_attachment(spark, sf_dir):
    return library(spark, sf_dir).get_attachment("P21").select("key", "parent", "mime", "work_title")


@query("lib_all_keys", _WITH + _MORE + "SELECT key FROM works UNION SELECT key FROM notes UNION SELECT key FROM files UNION SELECT key FROM marks UNION SELECT key FROM entries UNION SELECT 'NAT' || lpad(n_nationkey::VARCHAR, 5, '0') FROM nation")
def lib_all_keys(spark, sf_dir):
    return extended(spark, sf_dir).all_keys()


@query("lib_feeds", "SELECT r_regionkey + 99 AS group_id, r_name AS name, CASE WHEN r_regionkey = 0 THEN (SELECT count(*) FROM benchmark) ELSE 0 END AS n_items FROM region")
def lib_feeds(spark, sf_dir):
    return extended(spark, sf_dir).list_feeds().select("group_id", "name", "n_items")


@query("lib_feed_items", _WITH + _MORE + "SELECT key, date_added, title, NULL::VARCHAR AS creators FROM entries ORDER BY date_added DESC, key LIMIT 30")
def lib_feed_items(spark, sf_dir):
    return extended(spark, sf_dir).feed_items(99, 30).select("key", "date_added", "title", "creators")


@query("lib_collection_children", _WITH + ", filed0 AS (SELECT key FROM live JOIN filed USING (key) JOIN nation ON collection = 'n' || n_nationkey WHERE n_regionkey = 4) SELECT key FROM filed0 UNION SELECT key FROM notes WHERE parent IN (SELECT key FROM filed0) UNION SELECT key FROM files WHERE parent IN (SELECT key FROM filed0)")
def lib_collection_children(spark, sf_dir):
    return library(spark, sf_dir).collection_items_with_children("r4", True).select("key")


@query("lib_tree", "SELECT 'n' || n_nationkey AS key, 1 AS depth, '  - ' || n_name || ' (n' || n_nationkey || ')' AS line FROM nation UNION ALL SELECT 'r' || r_regionkey, 0, '- ' || r_name || ' (r' || r_regionkey || ')' FROM region")
def lib_tree(spark, sf_dir):
    return library(spark, sf_dir).collection_tree()


@query("lib_related", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'dc:relation' ELSE 'owl:sameAs' END AS predicate, string_agg('NAT' || lpad(n_nationkey::VARCHAR, 5, '0') || '=' || n_name, ',' ORDER BY n_nationkey) AS related FROM nation WHERE n_regionkey = 2 GROUP BY 1")
def lib_related(spark, sf_dir):
    found = extended(spark, sf_dir).get_related_by_predicate("r2")
    return found.select("predicate", F.array_join(F.transform("related", lambda x: F.concat(x["related_key"], F.lit("="), x["title"])), ",").alias("related"))


@query("lib_delete_collection", "SELECT 'n' || (doc_id % 25) AS collection, count(*) AS n FROM documents JOIN nation ON n_nationkey = doc_id % 25 WHERE n_regionkey <> 1 AND n_nationkey <> 8 GROUP BY 1 UNION ALL SELECT 'collections left', (SELECT count(*) FROM nation WHERE n_regionkey <> 1 AND n_nationkey <> 8) + (SELECT count(*) FROM region WHERE r_regionkey <> 1)")
def lib_delete_collection(spark, sf_dir):
    """What is filed, and how many collections there are, after a region and a nation were deleted."""
    lib = library(spark, sf_dir)
    nodes, filed = delete_nodes(lib.collections, lib.membership, ["r1", "n8"], "key", "parent", "collection")
    left = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("collections left").alias("collection"), "n")
    return filed.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).unionByName(left)


@query("lib_add_citations", _WITH + "SELECT 'K' || page_id AS cite_key, CASE page_id % 4 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'thesis' WHEN 2 THEN 'preprint' END AS item_type, CASE WHEN page_id % 4 <> 3 THEN 'T' || page_id END AS title, CASE WHEN page_id % 4 = 3 THEN 'failed' WHEN d.key IS NULL THEN 'created' ELSE 'skipped' END AS outcome, CASE WHEN page_id % 4 <> 3 THEN d.key END AS existing_key FROM pages LEFT JOIN (SELECT doi, min(key) AS key FROM live GROUP BY doi) d ON d.doi = '10.1000/' || page_id WHERE page_id % 4 <> 3 UNION ALL SELECT NULL, NULL, NULL, 'failed', NULL FROM pages WHERE page_id % 4 = 3")
def lib_add_citations(spark, sf_dir):
    """A citation of every page, in three formats and one that can't be read, against the works' identifiers."""
    n = F.col("page_id").cast("string")
    bib = F.concat(F.lit("@article{K"), n, F.lit(", title={T"), n, F.lit("}, doi={10.1000/"), n, F.lit("}}"))
    csl = F.concat(F.lit('{"type": "thesis", "id": "K'), n, F.lit('", "title": "T'), n, F.lit('", "DOI": "https://doi.org/10.1000/'), n, F.lit('"}'))
    record = F.concat(F.lit('{"type": "posted-content", "id": "K'), n, F.lit('", "title": ["T'), n, F.lit('"], "DOI": "10.1000/'), n, F.lit('"}'))
    part = F.col("page_id") % 4
    text = F.when(part == 0, bib).when(part == 1, csl).when(part == 2, record).otherwise(F.lit('{"type": '))
    found = library(spark, sf_dir).add_citations(table(spark, sf_dir, "pages").select(text.alias("t")), "t")
    return found.select("cite_key", "item_type", "title", "outcome", "existing_key")
