"""A small library whose rows each provoke a rule; methods against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stackroom.functions import items as T
from stackroom.library import SCHEMAS, Library
from stackroom.operators import dedup, maintain, sync, vector
from stackroom.sources.index_table import IndexTable
from stackroom.streaming.streams import Watermarks

#: key: type, fields, creators, tags, collections
WORKS = {
    "UMLAUT01": ("journalArticle", {"title": "On Sight", "date": "2016-10-01 October 1, 2016", "DOI": "10.1234/ABC"}, [("Karl", "Müller", None)], ["méthode"], ["SUB"]),
    "UMLAUT02": ("journalArticle", {"title": "On Sound", "date": "2018-03-02 March 2, 2018"}, [("Karl", "Muller", None)], ["method"], []),
    "PERCENT1": ("journalArticle", {"title": "Gains of 50% a Year", "date": "2021-03-00 03/2021"}, [], ["policy"], ["TOP"]),
    "DASHES01": ("journalArticle", {"title": "Long–Short Term"}, [("Ana", "Smith-Jones", None)], [], []),
    "ORGNAME1": ("report", {"title": "The Sea", "date": "2015", "institution": "ACME"}, [(None, None, "Sea Board")], ["policy", "sea"], ["SUB"]),
    "CASE0001": ("case", {"caseName": "Roe v. Doe", "dateDecided": "1999-00-00 1999"}, [], [], []),
    "BARE0001": ("book", {}, [], [], []),
    "COPY0001": ("journalArticle", {"title": "<i>On</i> sight!", "DOI": "https://doi.org/10.1234/abc", "extra": "Citation Key: mueller16\narXiv: 2401.00001v2"}, [("K.", "Müller", None)], ["Méthode"], []),
    "TRASHED1": ("journalArticle", {"title": "Gone", "date": "2020"}, [], ["lost"], []),
}


@pytest.fixture(scope="module")
def lib(spark):
    items = [(k, w[0], 0, f"2024-01-{i + 1:02d} 00:00:00", f"2024-02-{28 - i:02d} 00:00:00", None, None, None, None) for i, (k, w) in enumerate(WORKS.items())]
    items += [("PDF00001", "attachment", 0, "", "", "UMLAUT01", None, "a.pdf", "application/pdf"), ("NOTE0001", "note", 0, "", "", "UMLAUT01", "<p>See <b>the light</b></p>", None, None), ("ANNOT001", "annotation", 0, "", "", "PDF00001", None, None, None), ("GROUP001", "book", 7, "2024-05-01 00:00:00", "", None, None, None, None)]
    fields = [(k, f, v) for k, w in WORKS.items() for f, v in w[1].items()] + [("ANNOT001", "annotationText", "bright words"), ("GROUP001", "title", "Of the group")]
    creators = [(k, i, *c) for k, w in WORKS.items() for i, c in enumerate(w[2])]
    data = {
        "items": items,
        "fields": fields,
        "creators": creators,
        "tags": [(k, t) for k, w in WORKS.items() for t in w[3]],
        "collections": [("TOP", None, "Physics", 0), ("SUB", "TOP", "Optics", 0), ("ALONE", "MISSING", "Alone", 0)],
        "membership": [(k, c) for k, w in WORKS.items() for c in w[4]],
        "trash": [("TRASHED1",)],
        "relations": [("UMLAUT01", 0, "dc:relation", "http://host/users/1/items/ORGNAME1"), ("UMLAUT01", 1, "dc:relation", "http://host/groups/9/items/ORGNAME1")],
        "libraries": [(0, "user", "My Library"), (7, "group", "Team"), (9, "feed", "News")],
    }
    return Library(spark, {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in data.items()})


def keys(df, column="key"):
    return {r[column] for r in df.collect()}


LIVE = set(WORKS) - {"TRASHED1"}


@pytest.mark.parametrize(
    "field, operation, value, expected",
    [
        ("creator", "is", "muller", {"UMLAUT01", "UMLAUT02", "COPY0001"}),
        ("author", "isNot", "müller", {"DASHES01", "ORGNAME1"}),
        ("creator", "contains", "smith-j", {"DASHES01"}),
        ("creator", "is", "Sea Board", {"ORGNAME1"}),
        ("tag", "is", "METHODE", {"UMLAUT01", "COPY0001"}),
        ("tags", "doesNotContain", "method", {"PERCENT1", "ORGNAME1"}),
        ("title", "contains", "50%", {"PERCENT1"}),
        ("title", "is", "long-short term", {"DASHES01"}),
        ("title", "beginsWith", "roe", {"CASE0001"}),
        ("title", "isNot", "On Sight", LIVE - {"UMLAUT01"}),
        ("date", "isAfter", "2017", {"UMLAUT02", "PERCENT1"}),
        ("date", "isBefore", "2000-01-01", {"CASE0001"}),
        ("date", "is", "03/2021", {"PERCENT1"}),
        ("date", "isNot", "03/2021", {"UMLAUT01", "UMLAUT02", "ORGNAME1", "CASE0001"}),
        ("year", "is", "2015", {"ORGNAME1"}),
        ("year", "isGreaterThan", "2016", {"UMLAUT02", "PERCENT1"}),
        ("publisher", "is", "acme", {"ORGNAME1"}),
        ("publisher", "isLessThan", "m", {"ORGNAME1"}),
        ("doi", "contains", "10.1234", {"UMLAUT01", "COPY0001"}),
        ("itemType", "is", "book", {"BARE0001"}),
        ("collection", "is", "SUB", {"UMLAUT01", "ORGNAME1"}),
        ("collections", "isNot", "SUB", LIVE - {"UMLAUT01", "ORGNAME1"}),
        ("dateAdded", "isBefore", "2024-01-03T00:00:00Z", {"UMLAUT01", "UMLAUT02"}),
    ],
)
def test_conditions(lib, field, operation, value, expected):
    assert keys(lib.advanced_search([{"field": field, "operation": operation, "value": value}])) == expected


def test_subcollections(lib):
    wanted = [{"field": "collection", "operation": "is", "value": "TOP"}]
    assert keys(lib.advanced_search(wanted)) == {"PERCENT1"}
    assert keys(lib.advanced_search(wanted, include_subcollections=True)) == {"PERCENT1", "UMLAUT01", "ORGNAME1"}
    assert keys(lib.get_collection_items("TOP", True)) == {"PERCENT1", "UMLAUT01", "ORGNAME1"} and keys(lib.get_collection_items("SUB")) == {"UMLAUT01", "ORGNAME1"}


def test_keywords(lib):
    assert keys(lib.search_items("Müller")) == {"UMLAUT01", "UMLAUT02", "COPY0001"}
    assert keys(lib.search_items("on s", tag="-method")) == {"UMLAUT01"}
    assert keys(lib.search_items("light", "everything", "note")) == {"NOTE0001"}
    i, found = lib.search_cascade("Müller 1812")
    assert i == 1 and keys(found) == {"UMLAUT01", "UMLAUT02", "COPY0001"}
    assert keys(lib.search_by_tag(["policy", "-sea"])) == {"PERCENT1"} and keys(lib.search_by_tag("policy", collection="TOP")) == {"PERCENT1", "ORGNAME1"}
    assert keys(lib.search_by_citation_key("mueller16")) == {"COPY0001"} and keys(lib.search_collections("opt ics")) == {"SUB"}


def test_scope(lib):
    assert keys(lib.switch(7).works) == {"GROUP001"} and keys(lib.switch("all").works) == LIVE | {"GROUP001"} and keys(lib.works) == LIVE
    assert {(r["group_id"], r["n_items"]) for r in lib.list_libraries().collect()} == {(0, 9), (7, 1), (9, 0)}
    assert lib.item_count().first()["n"] == len(LIVE)
    assert {r["key"]: r["group_id"] for r in lib.key_groups().collect()}["GROUP001"] == 7


def test_reading(lib):
    assert {r["key"]: list(r["children"]) for r in lib.get_children(["UMLAUT01", "BARE0001"]).collect()} == {"UMLAUT01": ["NOTE0001", "PDF00001"], "BARE0001": []}
    assert keys(lib.get_recent(2)) == {"COPY0001", "BARE0001"} and "TRASHED1" not in keys(lib.get_recent(100)) and "TRASHED1" in keys(lib.get_items(["TRASHED1"]))
    assert keys(lib.get_related("UMLAUT01"), "related_key") == {"ORGNAME1"}
    assert "lost" in keys(lib.get_tags(), "tag")
    assert [(r["key"], "/".join(r["path"])) for r in lib.get_collections().collect()] == [("ALONE", "Alone"), ("TOP", "Physics"), ("SUB", "Physics/Optics")]
    assert lib.get_notes("UMLAUT01").first()["key"] == "NOTE0001" and lib.search_notes("the light").first()["title"] == "On Sight"
    assert lib.search_annotations("bright").first()["work_title"] == "On Sight"
    assert lib.coverage().first()["covered"] == 1 and keys(lib.synthesize()) == {"UMLAUT01"}


def test_titles(lib, spark):
    row = lib.wide.where("key = 'CASE0001'").first()
    assert row["title"] == "Roe v. Doe" and row["date"] == "1999-00-00 1999"
    assert T.resolve_field("case", "title") == "caseName" and T.base_field_of("case", "caseName") == "title" and T.resolve_field("book", "title") == "title"
    fields = F.create_map(F.lit("nameOfAct"), F.lit("An Act"))
    assert spark.range(1).select(T.display_title(F.lit("statute"), fields, F.lit(None), F.lit(None))).first()[0] == "An Act"
    assert spark.range(1).select(T.display_title(F.lit("book"), fields, F.lit(None), F.lit(None))).first()[0] == "Untitled"


def test_duplicates(lib):
    found = {(r["kind"], r["value"], r["n"]) for r in lib.find_duplicates().collect()}
    assert found == {("doi", "10.1234/abc", 2), ("title", "on sight", 2)}
    assert ("arxiv", "2401.00001") in {(r["kind"], r["value"]) for r in lib.match_keys().where("key = 'COPY0001'").collect()}


def test_exports(lib):
    rows = lib.export_bibtex(["COPY0001", "UMLAUT01"]).collect()
    assert [r["key"] for r in rows] == ["COPY0001", "UMLAUT01"] and "author = {Müller, Karl}" in rows[1]["entry"] and "year = {2016}" in rows[1]["entry"]
    assert lib.fetch("UMLAUT01").first()["url"] == "https://doi.org/10.1234/ABC" and lib.cards().count() == len(LIVE)


def test_authors(spark):
    a = "array<struct<first:string,last:string,name:string>>"
    row = spark.createDataFrame([([("Jane", "Doé", None)], [("J.", "Roe", None), ("J.", "Doe", None)], [("X", "Other", None)])], f"registry {a}, page {a}, other {a}").select(T.reconcile_authors(F.col("registry"), F.col("page")).alias("p"), T.reconcile_authors(F.col("registry"), F.col("other")).alias("o")).first()
    assert [(c["first"], c["last"]) for c in row["p"]] == [("J.", "Roe"), ("Jane", "Doé")] and [c["last"] for c in row["o"]] == ["Doé"]


def test_empty_library(spark):
    none = Library(spark, {})
    assert none.works.count() == 0 and none.search_items("x").count() == 0 and none.find_duplicates().count() == 0 and none.coverage().first()["percent"] == 0.0


def test_standing_groups(spark):
    random.seed(3)
    members = {(random.randrange(60), random.randrange(40)) for _ in range(150)}
    used, want = set(), set()
    for g in sorted({g for g, _ in members}):
        mine = {i for h, i in members if h == g}
        if not mine & used:
            used |= mine
            want.add(g)
    df = spark.createDataFrame(list(members), "g int, item int")
    assert keys(dedup.standing_groups(df, "g", "item"), "g") == want
    assert keys(dedup.standing_groups(df, "g", "item", 3), "g") == set(sorted(want)[:3])


def test_index_refresh(spark, tmp_path):
    table, marks = IndexTable(spark, f"file://{tmp_path}/i", "id", "group_id"), Watermarks(spark, f"file://{tmp_path}/w")
    embed = vector.hash_embedder(32)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, body string, version int, lang string")
    first = rows(("a", "red green blue. " * 200, 1, "en"), ("b", "sun moon stars", 2, "en"), ("c", "", 2, "fr"))
    go = lambda df, **kw: maintain.refresh(df, table, marks, 0, "k", "body", "version", embed, ["lang"], **kw)
    assert go(first, current=first).watermark == 2
    assert table.read().where("parent = 'a'").count() > 1 and table.read().where("parent = 'c'").count() == 0
    second = rows(("a", "short now", 3, "en"), ("b", "sun moon stars", 2, "en"))
    out = go(second, current=None)
    assert (out.added, out.deleted, out.watermark) == (1, 0, 3) and table.read().where("parent = 'a'").count() == 1
    out = go(second, current=second.where("k = 'a'"))
    assert out.deleted == 1 and keys(table.read(), "parent") == {"a"}
    go(rows(("d", "moon and sun", 9, "de")), current=None)
    best = maintain.semantic_search(table, "sun moon", embed, 1, {"lang": {"$ne": "en"}}, 0).first()
    assert best["parent"] == "d" and "moon" in best["snippet"]


def test_pack_and_skip(spark):
    rows = spark.range(500).withColumn("size", F.col("id") % 90)
    packed = sync.pack(rows, "id", F.col("size"), 10, 300).groupBy("lane", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    assert packed.where("n > 10 OR s > 300").count() == 0 and packed.agg(F.sum("n")).first()[0] == 500
