"""A document library as a set of DataFrames, and its searches, readings and reports as methods.

Tables (a missing one counts as empty): items(key, item_type, group_id, date_added, date_modified,
parent, note, filename, mime), fields(key, field, value), creators(key, position, first, last,
name), tags(key, tag), collections(key, parent, name, group_id), membership(item, collection),
trash(key), relations(key, position, predicate, uri), libraries(group_id, kind, name), feeds(group_id,
name, url, last_check, last_update, last_error, refresh_interval), feed_items(key, read_time, translated_time).
Every method returns a lazy DataFrame. group_id 0 is the personal library; scope None is all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identifiers as I
from .functions import items as T
from .functions.text import citation_key, join_creators, title_key
from .operators import dedup, hierarchy, hydrate, predicates, reports, search
from .session import staged
from .sources.citations import read_citations, to_bibtex, to_markdown

#: Fixed schema of the tables.
SCHEMAS = {
    "items": "key string, item_type string, group_id long, date_added string, date_modified string, parent string, note string, filename string, mime string",
    "fields": "key string, field string, value string",
    "creators": "key string, position int, first string, last string, name string",
    "tags": "key string, tag string",
    "collections": "key string, parent string, name string, group_id long",
    "membership": "item string, collection string",
    "trash": "key string",
    "relations": "key string, position int, predicate string, uri string",
    "libraries": "group_id long, kind string, name string",
    "feeds": "group_id long, name string, url string, last_check string, last_update string, last_error string, refresh_interval int",
    "feed_items": "key string, read_time string, translated_time string",
}
#: Fields of the wide table, as base fields.
WIDE = ("title", "date", "abstractNote", "publicationTitle", "DOI", "ISBN", "url", "extra", "publisher", "volume", "issue", "pages")


class Library:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], scope: int | None = 0) -> None:
        self.spark, self.scope = spark, scope
        self.tables = {n: tables.get(n, spark.createDataFrame([], s)) for n, s in SCHEMAS.items()}

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.tables[name]
        raise AttributeError(name)

    def switch(self, scope) -> Library:
        """The same library with another scope."""
        return Library(self.spark, self.tables, search.parse_scope(scope))

    # Views ------------------------------------------------------------------------------------------

    @cached_property
    def wide(self) -> DataFrame:
        """One row per item of the scope, trash included: base fields as columns, nested creators, tags,
        collections. Each 1:n table is aggregated once; nothing fans out."""
        items = search.in_scope(self.tables["items"], self.scope)
        own = self.tables["fields"].join(items.select("key", "item_type"), "key")
        base = T.base_field_table(self.spark)
        named = own.join(F.broadcast(base), ["item_type", "field"], "left").select("key", F.coalesce("base_field", "field").alias("field"), "value", F.col("base_field").isNotNull().alias("mapped"))
        wide = named.where(F.col("field").isin(*WIDE)).groupBy("key").agg(*[F.coalesce(F.max(F.when((F.col("field") == n) & F.col("mapped"), F.col("value"))), F.max(F.when(F.col("field") == n, F.col("value")))).alias(n) for n in WIDE])
        nested = {
            "wide": wide,
            "creators": hydrate.nest_ordered(self.tables["creators"], "key", "position", ["first", "last", "name"], "creators"),
            "tags": hydrate.nest_values(self.tables["tags"], "key", "tag", "tags"),
            "collections": hydrate.nest_values(self.tables["membership"].withColumnRenamed("item", "key"), "key", "collection", "collections"),
        }
        return hydrate.hydrate(items, "key", nested)

    @property
    def live(self) -> DataFrame:
        return self.wide.join(self.tables["trash"], "key", "left_anti")

    @property
    def works(self) -> DataFrame:
        """Live items that are no children's types."""
        return self.live.where(~F.col("item_type").isin(*T.CHILD_TYPES))

    def _names(self):
        return F.transform("creators", lambda c: F.coalesce(c["name"], F.concat_ws(" ", c["first"], c["last"])))

    def condition_fields(self) -> dict[str, predicates.Field]:
        field = predicates.Field
        text = {n: field("scalar", F.col(n)) for n in WIDE if n != "date"}
        # Names match whole, by last name and, for substrings, as written.
        names = F.flatten(F.transform("creators", lambda c: F.filter(F.array(c["last"], c["name"], F.concat_ws(" ", c["first"], c["last"])), lambda x: F.coalesce(x, F.lit("")) != "")))
        year = F.when(I.year_of(F.col("date")) != "0000", I.year_of(F.col("date")))
        return text | {
            "date": field("dated", F.when(F.col("date") != "", I.display_date(F.col("date"))), F.substring("date", 1, 10)),
            "year": field("dated", year),
            "creator": field("multi", names),
            "tag": field("multi", F.col("tags")),
            "collection": field("membership", F.col("collections")),
            "itemType": field("scalar", F.col("item_type")),
            "dateAdded": field("scalar", I.iso_timestamp(F.col("date_added"))),
            "dateModified": field("scalar", I.iso_timestamp(F.col("date_modified"))),
        }

    # Search -----------------------------------------------------------------------------------------

    def advanced_search(self, conditions: Sequence[Mapping[str, str]], join_mode: str = "all", sort: Sequence[tuple[str, str]] = (), limit: int = 50, include_subcollections: bool = False) -> DataFrame:
        keys = (lambda k: [r["node"] for r in hierarchy.descendants(self.tables["collections"], [k]).collect()]) if include_subcollections else None  # a subtree of one user's collections
        return search.search(self.works, self.condition_fields(), conditions, join_mode, key="key", sort=sort, limit=limit, keys=keys)

    def search_items(self, query: str, mode: str = "titleCreatorYear", item_type: str = "-attachment", tag=None, collection: str | None = None, limit: int = 10) -> DataFrame:
        """Keywords, newest first; mode 'everything' also looks into abstracts, tags and notes."""
        rows = search.of_type(self.live, item_type, "item_type")
        if collection:
            rows = rows.where(F.array_contains("collections", collection))
        columns = [F.col("title"), F.col("date"), F.array_join(self._names(), "; ")]
        if mode == "everything":
            columns += [F.col("abstractNote"), F.array_join("tags", "; "), F.col("note")]
        else:
            rows = rows.where("item_type <> 'note'")
        return search.keyword_search(rows, query, columns, F.col("tags"), tag, "key", [("date_modified", "desc")], limit)

    def search_cascade(self, query: str, limit: int = 10, fallback=None) -> tuple[int, DataFrame]:
        """Keywords as given; with the year dropped; the first word; everything; then fallback()."""
        words = query.split()
        names = [w for w in words if not (len(w) == 4 and w.isdigit())]
        attempts = [lambda: self.search_items(query, limit=limit), lambda: self.search_items(" ".join(names) or query, limit=limit), lambda: self.search_items((names or words or [query])[0], limit=limit), lambda: self.search_items(query, "everything", limit=limit)]
        return search.cascade([*attempts, *([fallback] if fallback else [])])

    def search_by_tag(self, tag, item_type: str = "-attachment", collection: str | None = None, limit: int = 10) -> DataFrame:
        rows = search.of_type(self.live, item_type, "item_type")
        if collection:
            below = hierarchy.descendants(self.tables["collections"], [collection]).withColumnRenamed("node", "collection")
            rows = rows.join(self.tables["membership"].join(below, "collection", "left_semi").select(F.col("item").alias("key")), "key", "left_semi")
        wanted = predicates.tag_filter(F.col("tags"), tag)
        rows = rows if wanted is None else rows.where(wanted)
        return search.order_by(rows, [("date_modified", "desc")], "key").limit(search.clamp_limit(limit))

    def search_by_citation_key(self, key: str) -> DataFrame:
        own = self.tables["fields"].where("field = 'citationKey'").select("key", F.col("value").alias("citation_key"))
        return search.by_citation_key(self.works.join(own, "key", "left"), key, F.col("citation_key"), citation_key(F.col("extra")), "key")

    def search_notes(self, query: str, limit: int = 20) -> DataFrame:
        """Notes by their text without mark-up, with their parents' titles."""
        found = search.search_notes(self.live.where("item_type = 'note'"), "note", query, "key", limit)
        return hydrate.lookup_default(found.select("key", "parent", "snippet"), self.wide.select("key", "title"), "parent", "key", "title")

    def search_annotations(self, query: str, limit: int = 20) -> DataFrame:
        """Annotations by text or comment, with the work two hops up."""
        texts = hydrate.pivot_fields(self.tables["fields"], "key", "field", "value", ["annotationText", "annotationComment"])
        rows = self.live.where("item_type = 'annotation'").join(texts, "key").where(search.any_contains([F.col("annotationText"), F.col("annotationComment")], query))
        rows = rows.select("key", "parent", "annotationText", "annotationComment").orderBy("key").limit(limit)
        middle = self.wide.select(F.col("key").alias("m_key"), F.col("parent").alias("m_parent"), F.col("title").alias("m_title"))
        top = self.wide.select(F.col("key").alias("t_key"), F.col("title").alias("t_title"))
        return hydrate.two_hop(rows, middle, top, "parent", "m_key", "m_parent", "t_key", {"work": "coalesce(t_key, m_key)", "work_title": "coalesce(t_title, m_title, parent)"})

    def search_notes_and_annotations(self, query: str, limit: int = 20) -> DataFrame:
        """Notes and annotations together: (key, parent, kind, text, title of the work), notes first."""
        notes = self.search_notes(query, limit).select("key", "parent", F.lit("note").alias("kind"), F.col("snippet").alias("text"), "title")
        marked = F.coalesce(F.col("annotationText"), F.col("annotationComment"))
        marks = self.search_annotations(query, limit).select("key", "parent", F.lit("annotation").alias("kind"), marked.alias("text"), F.col("work_title").alias("title"))
        return notes.unionByName(marks).orderBy(F.desc("kind"), "key").limit(search.clamp_limit(limit, 20, 1000))

    def search_collections(self, query: str) -> DataFrame:
        up = self.tables["collections"].select(F.col("key").alias("parent"), F.col("name").alias("parent_name"))
        return search.in_scope(self.tables["collections"], self.scope).where(search.all_words(F.col("name"), query)).join(up, "parent", "left")

    # Reading ----------------------------------------------------------------------------------------

    def get_items(self, keys: Sequence[str], include_trashed: bool = True) -> DataFrame:
        return (self.wide if include_trashed else self.live).where(F.col("key").isin(list(keys)))

    def get_children(self, keys: Sequence[str] | DataFrame) -> DataFrame:
        parents = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
        links = [self.live.where(F.col("item_type") == t).select("parent", F.col("key").alias("child")) for t in T.CHILD_TYPES]
        return hydrate.children_of(parents, links, "key", "parent", "child")

    def get_recent(self, limit: int = 10, sort: str = "date_added", direction: str = "desc", collection: str | None = None) -> DataFrame:
        """Ranks bare keys; only the page is hydrated."""
        if sort not in ("date_added", "date_modified"):
            raise predicates.Unsupported(f"sort by {sort}")
        narrow = search.in_scope(self.tables["items"], self.scope).where(~F.col("item_type").isin(*T.CHILD_TYPES)).select("key", sort).join(self.tables["trash"], "key", "left_anti")
        if collection:
            narrow = narrow.join(self.tables["membership"].where(F.col("collection") == collection).select(F.col("item").alias("key")), "key", "left_semi")
        page = search.order_by(narrow, [(sort, direction)], "key").limit(search.clamp_limit(limit, 10, 1000))
        return page.select("key").join(self.wide, "key")

    def get_collection_items(self, collection: str, include_subcollections: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
        found = hierarchy.in_subtree(self.live, self.tables["membership"].withColumnRenamed("item", "key"), self.tables["collections"], collection, "key", "collection", recursive=include_subcollections)
        return found.orderBy("key").offset(search.clamp_offset(offset)).limit(search.clamp_limit(limit, 50, 1000))

    def collection_items_with_children(self, collection: str, include_subcollections: bool = False) -> DataFrame:
        """The items filed there and the attachments and notes of those without a parent, each key once."""
        filed = hierarchy.in_subtree(self.live, self.tables["membership"].withColumnRenamed("item", "key"), self.tables["collections"], collection, "key", "collection", recursive=include_subcollections)
        tops = filed.where("coalesce(parent, '') = ''").select(F.col("key").alias("parent"))
        below = self.live.where(F.col("item_type").isin("attachment", "note")).join(tops, "parent", "left_semi")
        return filed.unionByName(below).dropDuplicates(["key"])

    def collection_tree(self) -> DataFrame:
        """(key, depth, line) of every collection in the order of the tree, siblings by key; the line is indented."""
        rows = search.in_scope(self.tables["collections"], self.scope)
        steps = hierarchy.paths(rows.select("key", "parent", F.col("key").alias("name"))).select(F.col("node").alias("key"), F.col("path").alias("keys"))
        depth = F.size("keys") - 1
        line = F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), F.coalesce("name", F.lit("")), F.lit(" ("), "key", F.lit(")"))
        return rows.join(steps, "key").orderBy("keys", "key").select("key", depth.alias("depth"), line.alias("line"))

    def get_collections(self) -> DataFrame:
        """Collections with their paths, in the order of the tree."""
        rows = search.in_scope(self.tables["collections"], self.scope)
        return rows.join(hierarchy.paths(rows).withColumnRenamed("node", "key"), "key").orderBy("path", "key")

    def resolve_collections(self, specs: Sequence[str]) -> DataFrame:
        return hierarchy.resolve(search.in_scope(self.tables["collections"], self.scope), specs)

    def get_related(self, key: str) -> DataFrame:
        return hydrate.related(self.wide.select("key", "title"), self.tables["relations"].where(F.col("key") == key).withColumnRenamed("key", "src"), "src", "position", "uri", "key")

    def get_related_by_predicate(self, key: str) -> DataFrame:
        """(predicate, related: keys and titles in the relations' order); a target counts once per predicate."""
        target = F.regexp_extract("uri", r"/items/([A-Z0-9]{8})\b", 1)
        pointed = self.tables["relations"].where(F.col("key") == key).select("predicate", target.alias("related_key"), "position").where("related_key <> ''")
        once = pointed.groupBy("predicate", "related_key").agg(F.min("position").alias("position"))
        titled = once.join(self.wide.select(F.col("key").alias("related_key"), "title"), "related_key", "left")
        return hydrate.nest_ordered(titled, "predicate", "position", ["related_key", "title"], "related").orderBy("predicate")

    def get_tags(self, limit: int | None = None) -> DataFrame:
        """Distinct tags in scope, of trashed items too."""
        tags = reports.distinct_values(self.wide, F.col("tags")).orderBy("tag")
        return tags if limit is None else tags.limit(limit)

    def tag_index(self) -> DataFrame:
        return reports.letter_index(self.get_tags(), "tag").orderBy("letter")

    def get_notes(self, key: str | None = None, limit: int = 20, clip: int = 500) -> DataFrame:
        """Notes of an item, a note by its own key, or all."""
        notes = self.live.where("item_type = 'note'")
        notes = notes if key is None else notes.where((F.col("parent") == key) | (F.col("key") == key))
        return notes.select("key", "parent", F.substring("note", 1, clip).alias("note")).orderBy("key").limit(limit)

    def get_annotations(self, key: str | None = None, limit: int | None = None) -> DataFrame:
        """Annotations of an attachment or of a work's attachments, or all: with the work two hops up."""
        texts = hydrate.pivot_fields(self.tables["fields"], "key", "field", "value", ["annotationText", "annotationComment", "annotationColor", "annotationPageLabel"])
        files = self.wide.where("item_type = 'attachment'").select(F.col("key").alias("f_key"), F.col("parent").alias("f_parent"))
        rows = self.live.where("item_type = 'annotation'").select("key", "parent", "tags").join(files, F.col("parent") == F.col("f_key"), "left")
        rows = rows if key is None else rows.where((F.col("parent") == key) | (F.col("f_parent") == key))
        rows = rows.orderBy("key")
        rows = rows if limit is None else rows.limit(search.clamp_limit(limit, 20, 1000))
        titles = self.wide.select(F.col("key").alias("work"), F.col("title").alias("work_title"))
        return rows.join(texts, "key", "left").withColumn("work", F.coalesce("f_parent", "parent")).drop("f_key", "f_parent").join(titles, "work", "left")

    def get_attachment(self, key: str) -> DataFrame:
        """One attachment by its own key, with its work's title; no row for other types."""
        own = self.wide.where((F.col("key") == key) & (F.col("item_type") == "attachment")).select("key", "parent", "filename", "mime")
        return own.join(self.wide.select(F.col("key").alias("parent"), F.col("title").alias("work_title")), "parent", "left")

    def all_keys(self) -> DataFrame:
        """Every item's key, of any type and library, trashed ones too."""
        return self.tables["items"].select("key").distinct()

    def list_feeds(self) -> DataFrame:
        """Feeds with the number of their items, by name."""
        entries = self.tables["items"].select("key", F.col("group_id").alias("feed")).join(self.tables["feed_items"].select("key"), "key", "left_semi")
        return reports.counts_per(self.tables["feeds"], entries, "group_id", "feed", "n_items").orderBy("name", "group_id")

    def feed_items(self, group_id: int, limit: int = 20) -> DataFrame:
        """A feed's newest items with their creators as one text. Ranks bare keys; only the page is hydrated."""
        narrow = search.in_scope(self.tables["items"], group_id).select("key", "date_added").join(self.tables["feed_items"], "key")
        page = search.order_by(narrow, [("date_added", "desc")], "key").limit(search.clamp_limit(limit, 20, 1000))
        rows = page.drop("date_added").join(self.switch(group_id).wide, "key")
        names = F.filter(F.transform("creators", lambda c: F.when(c["last"].isNotNull(), F.concat_ws(", ", c["last"], c["first"]))), lambda x: x.isNotNull())
        date = F.expr("substr(date, instr(date, ' ') + 1)")
        return rows.select("key", "item_type", "date_added", "read_time", "translated_time", "title", F.col("abstractNote").alias("abstract"), date.alias("date"), "DOI", "url", F.when(F.size(names) > 0, F.array_join(names, "; ")).alias("creators"))

    def list_libraries(self) -> DataFrame:
        """Libraries with the number of their items, trash included."""
        return reports.counts_per(self.tables["libraries"], self.tables["items"].where(~F.col("item_type").isin(*T.CHILD_TYPES)), "group_id", "group_id", "n_items")

    def item_count(self) -> DataFrame:
        """Live items that are no children."""
        return self.works.agg(F.count(F.lit(1)).alias("n"))

    def key_groups(self) -> DataFrame:
        """key -> group id of every item of user and group libraries; feeds have none."""
        kinds = self.tables["libraries"].select("group_id", "kind")
        return self.tables["items"].join(kinds, "group_id", "left").select("key", F.when(F.col("kind") == "user", F.lit(0).cast("long")).when(F.col("kind") == "group", F.col("group_id")).alias("group_id"))

    # Reports and duplicates ---------------------------------------------------------------------------

    def match_keys(self) -> DataFrame:
        rows = self.works.withColumn("__title", title_key(F.col("title")))
        arxiv = F.array(I.arxiv_identity(F.col("url")), I.arxiv_identity(F.col("DOI")), I.arxiv_from_lines(F.col("extra")))
        return dedup.match_keys(rows, "key", {"doi": I.doi_key(F.col("DOI")), "arxiv": arxiv, "isbn": I.isbn_keys(F.col("ISBN")), "title": F.col("__title")})

    def find_duplicates(self, method: str = "both", offset: int = 0, limit: int = 50) -> DataFrame:
        keys = self.match_keys().where(F.col("kind").isin("doi", "title") if method == "both" else F.col("kind") == method)
        return dedup.group_page(dedup.duplicate_groups(keys, "key"), offset, limit)

    def find_existing(self, candidates: DataFrame) -> DataFrame:
        """candidates (candidate, kind, value) -> the library's items that carry the identifier, with it."""
        return candidates.join(self.match_keys(), ["kind", "value"]).select("candidate", "key", "kind", "value").distinct()

    def add_citations(self, texts: DataFrame, column: str, kind: str = "auto", if_exists: str = "skip") -> DataFrame:
        """Every entry of the texts as an item with its outcome: failed (error says why), skipped (the library
        has its identifier: existing_key is the least such item) or created. With if_exists 'duplicate'
        nothing is skipped. Titles never identify. Kinds are those of read_citations."""
        if if_exists not in ("skip", "duplicate"):
            raise predicates.Unsupported(f"if_exists {if_exists}")
        entries = staged(read_citations(texts, column, kind).withColumn("position", F.monotonically_increasing_id()), "entries")
        arxiv = F.array(I.arxiv_identity(F.col("url")), I.arxiv_identity(F.col("doi")), I.arxiv_from_lines(F.col("extra")))
        named = dedup.match_keys(entries, "position", {"doi": I.doi_key(F.col("doi")), "arxiv": arxiv, "isbn": I.isbn_keys(F.col("isbn"))})
        known = named.join(self.match_keys(), ["kind", "value"]).groupBy("position").agg(F.min("key").alias("existing_key"))
        skip = F.col("existing_key").isNotNull() & F.lit(if_exists == "skip")
        outcome = F.when(F.col("error").isNotNull(), "failed").when(skip, "skipped").otherwise("created")
        return entries.join(known, "position", "left").withColumn("outcome", outcome).drop("position")

    def coverage(self) -> DataFrame:
        return reports.coverage(self.works.select("key"), self.live.where("item_type = 'attachment'").select(F.col("parent").alias("link"), "mime"), "key", "link", F.col("mime") == "application/pdf")

    def synthesize(self, collection: str | None = None) -> DataFrame:
        works = self.works if collection is None else self.works.where(F.array_contains("collections", collection))
        return reports.synthesize(works.select("key", "title"), self.live.where("item_type = 'note'").select("parent", "note"), "key", "parent", F.col("note")).orderBy("title", "key")

    def enrich(self, facts: DataFrame, doi: str = "doi") -> DataFrame:
        return reports.enrich(self.works, facts, I.normalize_doi(F.col("DOI")), doi)

    # Export -------------------------------------------------------------------------------------------

    def export_bibtex(self, keys: Sequence[str]) -> DataFrame:
        """(position, key, entry) in the order of keys."""
        order = self.spark.createDataFrame([(i, k) for i, k in enumerate(dict.fromkeys(keys))], "position int, key string")
        fields = {"title": F.col("title"), "author": F.when(F.size("creators") > 0, F.replace(join_creators(F.col("creators")), F.lit("; "), F.lit(" and "))), "year": I.year_of(F.col("date")), "doi": F.col("DOI"), "journal": F.col("publicationTitle"), "url": F.col("url")}
        return order.join(self.wide, "key").select("position", "key", to_bibtex(F.col("key"), F.col("item_type"), fields).alias("entry")).orderBy("position")

    def cards(self, rows: DataFrame | None = None) -> DataFrame:
        rows = self.works if rows is None else rows
        return rows.select("key", to_markdown(F.col("title"), {"Type": F.col("item_type"), "Date": I.display_date(F.col("date")), "Authors": join_creators(F.col("creators")), "Tags": F.array_join("tags", ", ")}, F.col("abstractNote")).alias("card"))

    def fetch(self, key: str) -> DataFrame:
        """(id, title, text, url, metadata as JSON) of one item."""
        row = self.wide.where(F.col("key") == key)
        return row.select(F.col("key").alias("id"), "title", F.coalesce("abstractNote", F.lit("")).alias("text"), F.coalesce("url", F.concat(F.lit("https://doi.org/"), I.normalize_doi(F.col("DOI")))).alias("url"), F.to_json(F.struct("item_type", "date", "DOI", "tags")).alias("metadata"))
