"""Item types: which of a type's fields stands for a base field; titles, dates, texts and structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .identifiers import display_date
from .text import embedding_text, note_title, strip_tags

#: Fields of item types that stand for a base field of another name, type: {field: base}.
BASE_FIELDS = {
    "artwork": {"artworkMedium": "medium"},
    "audioRecording": {"audioRecordingFormat": "medium", "label": "publisher"},
    "bill": {"billNumber": "number", "codePages": "pages", "codeVolume": "volume", "legislativeBody": "authority"},
    "blogPost": {"blogTitle": "publicationTitle", "websiteType": "type"},
    "book": {"format": "medium"},
    "bookSection": {"bookTitle": "publicationTitle", "format": "medium"},
    "case": {"caseName": "title", "court": "authority", "dateDecided": "date", "docketNumber": "number", "firstPage": "pages", "reporterVolume": "volume"},
    "computerProgram": {"company": "publisher"},
    "conferencePaper": {"proceedingsTitle": "publicationTitle"},
    "dataset": {"format": "medium", "identifier": "number", "repository": "publisher", "repositoryLocation": "place"},
    "dictionaryEntry": {"dictionaryTitle": "publicationTitle"},
    "email": {"subject": "title"},
    "encyclopediaArticle": {"encyclopediaTitle": "publicationTitle"},
    "film": {"distributor": "publisher", "genre": "type", "videoRecordingFormat": "medium"},
    "forumPost": {"forumTitle": "publicationTitle", "postType": "type"},
    "hearing": {"documentNumber": "number", "legislativeBody": "authority"},
    "interview": {"interviewMedium": "medium"},
    "letter": {"letterType": "type"},
    "manuscript": {"institution": "publisher", "manuscriptType": "type"},
    "map": {"mapType": "type"},
    "patent": {"issueDate": "date", "issuingAuthority": "authority", "legalStatus": "status", "patentNumber": "number", "priorityDate": "originalDate"},
    "podcast": {"audioFileType": "medium", "episodeNumber": "number"},
    "preprint": {"archiveID": "number", "genre": "type", "repository": "publisher"},
    "presentation": {"presentationType": "type", "sessionTitle": "publicationTitle"},
    "radioBroadcast": {"audioRecordingFormat": "medium", "episodeNumber": "number", "network": "publisher", "programTitle": "publicationTitle"},
    "report": {"institution": "publisher", "reportNumber": "number", "reportType": "type"},
    "standard": {"organization": "authority"},
    "statute": {"dateEnacted": "date", "nameOfAct": "title", "publicLawNumber": "number"},
    "thesis": {"thesisType": "type", "university": "publisher"},
    "tvBroadcast": {"episodeNumber": "number", "network": "publisher", "programTitle": "publicationTitle", "videoRecordingFormat": "medium"},
    "videoRecording": {"studio": "publisher", "videoRecordingFormat": "medium"},
    "webpage": {"websiteTitle": "publicationTitle", "websiteType": "type"},
}
#: The item types as the schema spells them.
ITEM_TYPES = ("annotation", "artwork", "attachment", "audioRecording", "bill", "blogPost", "book", "bookSection", "case", "computerProgram", "conferencePaper", "dataset", "dictionaryEntry", "document", "email", "encyclopediaArticle", "film", "forumPost", "hearing", "instantMessage", "interview", "journalArticle", "letter", "magazineArticle", "manuscript", "map", "newspaperArticle", "note", "patent", "podcast", "preprint", "presentation", "radioBroadcast", "report", "standard", "statute", "thesis", "tvBroadcast", "videoRecording", "webpage")
CHILD_TYPES = ("attachment", "note", "annotation")


def base_field_table(spark: SparkSession) -> DataFrame:
    """(item_type, base_field, field)."""
    return spark.createDataFrame([(t, b, f) for t, m in BASE_FIELDS.items() for f, b in m.items()], "item_type string, base_field string, field string")


def resolve_field(item_type: str, base: str) -> str:
    return next((f for f, b in BASE_FIELDS.get(item_type, {}).items() if b == base), base)


def base_field_of(item_type: str, field: str) -> str:
    return BASE_FIELDS.get(item_type, {}).get(field, field)


def canonical_type(value: Column) -> Column:
    """The schema's spelling of an item type, whatever its case; null for no such type."""
    return F.create_map(*[F.lit(x) for t in ITEM_TYPES for x in (t.lower(), t)])[F.lower(F.trim(value))]


def resolved(item_type: Column, fields: Column, base: str) -> Column:
    """The base field's value of a map<field, value>, whatever the type calls it."""
    names = {t: f for t, m in BASE_FIELDS.items() for f, b in m.items() if b == base}
    own = F.lit(base)
    if names:
        own = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[item_type], own)
    return fields[own]


def display_title(item_type: Column, fields: Column, note: Column, filename: Column) -> Column:
    """A note's first line, an annotation's text, the type's title, the file name, or 'Untitled'."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.when(item_type == "note", note_title(note)).when(item_type == "annotation", F.coalesce(F.concat(F.lit("Annotation: "), F.substring(filled(fields["annotationText"]), 1, 80)), F.lit("Annotation"))).otherwise(F.coalesce(filled(resolved(item_type, fields, "title")), filled(fields["title"]), filled(filename), F.lit("Untitled")))


def shown_date(item_type: Column, fields: Column) -> Column:
    return display_date(resolved(item_type, fields, "date"))


def annotation_text(text: Column, comment: Column, tags: Column) -> Column:
    """Text, comment and tags of an annotation; '' without any."""
    return embedding_text(text, comment, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))


def searchable_text(title: Column, creators: Column, abstract: Column, extra: Column, notes: Column, fulltext: Column, most: int = 50_000) -> Column:
    """Labelled sections that are not empty; the full text cut to most characters."""
    parts = [("Title", title), ("Authors", creators), ("Abstract", abstract), ("Extra", extra), ("Notes", strip_tags(notes)), ("Content", F.substring(fulltext, 1, most))]
    return F.array_join(F.filter(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c)) for n, c in parts]), lambda x: x.isNotNull()), "\n\n")


def reconcile_authors(registry: Column, page: Column) -> Column:
    """Authors of a page in place of a registry's, if they name all of its and more, by folded last name:
    in the page's order, with the registry's entry for everyone it knows. registry and page:
    array<struct<first, last, name>>; single-field names decline."""
    from .text import fold

    key = lambda c: fold(c["last"])
    mine, theirs = F.array_distinct(F.transform(registry, key)), F.array_distinct(F.transform(page, key))
    more = (F.size(F.array_except(mine, theirs)) == 0) & (F.size(F.array_except(theirs, mine)) > 0)
    plain = ~F.exists(registry, lambda c: F.coalesce(c["name"], F.lit("")) != "")

    def entry(c, i):
        """The k-th of a page's equal last names takes the registry's k-th."""
        before = F.size(F.filter(F.slice(page, F.lit(1), i), lambda p: key(p) == key(c)))
        known = F.filter(registry, lambda r: key(r) == key(c))
        return F.coalesce(F.get(known, before), c)

    return F.when(plain & more, F.transform(page, entry)).otherwise(registry)
