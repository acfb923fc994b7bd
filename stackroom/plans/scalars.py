"""Queries: scalar functions, on small literal tables or on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import boxes as B
from ..functions import identifiers as I
from ..functions import items as K
from ..functions import text as T
from ..session import table
from ..sources import citations as C


def _rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def _expect(values):
    """Rows (i, out) as SQL: what the function must give, worked out by hand."""
    lit = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return "SELECT i::INT AS i, out::VARCHAR AS out FROM (VALUES " + ", ".join(f"({i}, {lit(v)})" for i, v in enumerate(values)) + ") t(i, out)"


def _cases(name, function, pairs):
    """A query of one function over literal inputs, against results worked out by hand."""

    def run(spark, sf_dir):
        return _rows(spark, [a for a, _ in pairs]).select("i", function(F.col("v")).cast("string").alias("out"))

    query(name, _expect([b for _, b in pairs]))(run)


_cases("doi_norm", I.normalize_doi, [("10.1234/abc", "10.1234/abc"), ("doi: 10.1234/ABC.", "10.1234/ABC"), ("https://doi.org/10.1000/x(1)y", "10.1000/x(1)y"), ("http://dx.doi.org/10.1000/q?z=1", "10.1000/q"), ("10.3319/TAO.2009.05.25.02(IWNOP)", "10.3319/TAO.2009.05.25.02(IWNOP)"), ("10.1234/foo).", "10.1234/foo"), ("https://example.org/10.1/x", None), ("10.12/x", None), ("", None), (None, None)])
_cases("doi_match_key", I.doi_key, [("10.1234/ABC", "10.1234/abc"), ("nothing", None)])
_cases("isbn_norm", I.normalize_isbn, [("0-306-40615-2", "9780306406157"), ("ISBN: 978-0-306-40615-7", "9780306406157"), ("ISBN-13 bad", None), ("080442957X", "9780804429573"), ("9780306406158", None), ("0306406153", None), (None, None), ("https://x.org/9780306406157", "9780306406157")])
_cases("isbn_set", lambda v: F.array_join(I.isbn_keys(v), ","), [("0-306-40615-2, 9780306406157; 080442957X", "9780306406157,9780804429573"), ("none", ""), (None, "")])
_cases("arxiv_norm", I.normalize_arxiv, [("arXiv:2401.00001v2", "2401.00001v2"), ("https://arxiv.org/pdf/2401.00001v2.pdf", "2401.00001v2"), ("hep-th/9901001", "hep-th/9901001"), ("math.GT/0309136", "math.GT/0309136"), ("2401.1", None), (None, None)])
_cases("arxiv_identity", I.arxiv_identity, [("2401.00001v2", "2401.00001"), ("10.48550/arXiv.2401.00001", "2401.00001"), ("https://doi.org/10.48550/arxiv.2401.00001v3", "2401.00001"), ("x", None)])
_cases("arxiv_extra", I.arxiv_from_lines, [("note: x\narXiv: 2401.00001v1 [cs]\n", "2401.00001"), ("no", None)])
_cases("title_key", T.title_key, [("The <i>Étude</i> of   B–C!", "etude of b c"), ("A/B testing", "a b testing"), ("An  Apple", "apple"), ("x &lt; y &amp; Straße", "x y strasse"), (None, "")])
_cases("title_query", T.title_query, [("The <i>Étude</i> of\n  B&amp;C", "The Étude of B&C"), ("DREAM<sub>(D)</sub>:", "DREAM (D) :"), ("a &lt;i&gt; b", "a <i> b"), ("a&nbsp;b", "a b"), ("<b> </b>", None), ("", None), (None, None)])
_cases("item_type_spelling", K.canonical_type, [("JOURNALarticle", "journalArticle"), (" webpage ", "webpage"), ("tvbroadcast", "tvBroadcast"), ("novel", None), ("", None), (None, None)])
_cases("title_key_ascii", T.ascii_title_key, [("The <i>Étude</i> of   B-C!", "etude of b c"), ("A/B testing", "a b testing"), (None, "")])
_cases("fold_text", T.fold, [("Müller", "muller"), ("Ångström–X", "angstrom-x"), ("STRASSE ß", "strasse ss"), ("Łódź", "lodz"), (None, "")])
_cases("strip_tags", T.strip_tags, [("<p>a <b>b</b></p>", "a b"), ("a <i\n>b</i> c", "a <i\n>b c"), (None, "")])
_cases("html_lines", T.html_to_lines, [("<p>a</p><p>b &amp; c</p>x<br/>y", "a\nb & c\nx\ny"), (None, "")])
_cases("keep_inline", T.keep_inline_markup, [("<p>H<sub>2</sub>O <a href='x'>z</a></p>", "H<sub>2</sub>O z")])
_cases("repair_print", T.repair_print, [("co-\noperate “now” ﬁne —  x", "cooperate \"now\" fine - x")])
_cases("spaceless", T.spaceless, [("A B\nc", "abc")])
_cases("note_title", T.note_title, [("<p>First line</p><p>second</p>", "First line"), ("", "Untitled Note")])
_cases("mojibake", T.repair_mojibake, [("MÃ¼ller &amp; Co\n", "Müller & Co"), ("Müller", "Müller")])
_cases("calm_capitals", T.calm_capitals, [("R SOLE", "R Sole"), ("O'NEAL-SMITH", "O'Neal-Smith"), ("McDonald", "McDonald"), ("van", "Van")])
_cases("citation_key_line", T.citation_key, [("x: y\nCitation Key: doe2020", "doe2020"), ("citationkey: a b ", "a b"), ("none", None)])
_cases("creators_round_trip", lambda v: T.join_creators(T.split_creators(v)), [("Doe, Jane; ACME", "Doe, Jane; ACME"), ("", "No authors listed")])
_cases("name_split", lambda v: F.concat_ws("|", T.split_name(v)["last"], T.split_name(v)["first"]), [("Jane Q. Doe", "Doe|Jane Q."), ("Doe, Jane", "Doe|Jane"), ("Plato", "Plato|")])
_cases("slash_date", I.slash_date, [("2020/07/07", "2020-07-07"), ("2020", "2020")])
_cases("display_date", I.display_date, [("2021-03-00 March 2021", "March 2021"), ("2020", "2020")])
_cases("year_field", I.year_of, [("2021-03-00 March 2021", "2021"), ("99", None)])
_cases("iso_timestamp", I.iso_timestamp, [("2021-03-04 05:06:07", "2021-03-04T05:06:07Z"), (None, None)])
_cases("base_name", I.base_name, [("storage:paper one.pdf", "paper one.pdf"), ("/a/b/c.html", "c.html"), ("C:\\x\\y.txt", "y.txt")])
_cases("source_kind", I.source_kind, [("@article{x, title={y}}", "bibtex"), ('{"type": "book"}', "csl_json"), ("10.1234/abc", "doi"), ("2401.00001", "arxiv"), ("https://example.org/x", "url"), ("9780306406157", "isbn"), ("~/x.pdf", "file"), ("what is this", None)])
_cases("colour_name", I.colour_name, [("#FFD400", "yellow"), ("#123456", "")])
_cases("token_estimate", T.estimate_tokens, [("abcdefg", "3"), ("", "1"), (None, "1")])
_cases("token_truncate", lambda v: T.truncate_tokens(v, 2), [("abcdefg", "abcd"), ("ab", "ab")])
_cases("page_for_offset", lambda v: T.page_of_offset(v, F.lit(4)), [("ab\fcd\fef", "2"), ("abcdef", None)])
_cases("multi_value_split", lambda v: F.array_join(T.split_multi_value(v, lambda x: I.normalize_doi(x).isNotNull()), "|"), [("10.1234/a, 10.1234/b\n10.1234/c", "10.1234/a|10.1234/b|10.1234/c"), ("10.1234/a,b", "10.1234/a,b"), (None, "")])
_cases("extra_lines", lambda v: T.edit_lines(v, {"Status": "done", "New": "1"}, ["gone"]), [("a: 1\nstatus: open\nGone: x\nstatus: twice", "a: 1\nStatus: done\nNew: 1"), (None, "Status: done\nNew: 1")])
_cases("tag_union", lambda v: F.array_join(T.union_ignoring_case(F.split(v, ","), F.array(F.lit("RED"), F.lit("new"))), ","), [("Red,blue,red", "Red,blue,new")])
_cases("caption_label", lambda v: F.concat_ws(" ", B.caption_parts(v)["kind"], B.caption_parts(v)["label"]), [("Figure 3. A plot", "figure 3"), ("Table 12: Values", "table 12"), ("Fig. S1: x", "figure S1"), ("In Figure 3 we", "")])


@query("attachment_bucket", "SELECT 0 AS i, 'pdf' AS out UNION ALL SELECT 1, 'html' UNION ALL SELECT 2, 'markdown' UNION ALL SELECT 3, 'text' UNION ALL SELECT 4, NULL UNION ALL SELECT 5, 'pdf'")
def attachment_bucket(spark, sf_dir):
    rows = spark.createDataFrame([(0, "a.PDF", None), (1, "x.htm", ""), (2, "n.md", None), (3, "q", "text/plain"), (4, "z.bin", None), (5, "z.bin", "application/pdf")], "i int, p string, m string")
    return rows.select("i", I.attachment_kind(F.col("p"), F.col("m")).alias("out"))


@query("attachment_choice", "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END, p_size DESC, p_partkey) = 1")
def attachment_choice(spark, sf_dir):
    from ..sources.files import choose_attachment

    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", F.element_at(F.array(F.lit("pdf"), F.lit("html"), F.lit("other")), (F.col("p_size") % 3 + 1).cast("int")).alias("kind"))
    return choose_attachment(part, "p_brand", "kind", "p_size", "p_partkey").select("p_brand", "p_partkey", "p_size")


@query("date_keys", "SELECT * FROM (VALUES (0, '2021-03-00'), (1, '1990-00-00'), (2, '0000-00-00'), (3, NULL), (4, '2024-05-06')) t(i, out)")
def date_keys(spark, sf_dir):
    rows = spark.createDataFrame([(0, "2021-03", "x"), (1, None, "Nov/Dec 1990"), (2, "", "undated"), (3, None, None), (4, "2024-5-6", "")], "i int, p string, d string")
    return rows.select("i", I.date_key(F.col("p"), F.col("d")).alias("out"))


@query("json_path", "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("bbox_iou", "SELECT * FROM (VALUES (0, 0.142857, 0.25, 0.5), (1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)) t(i, iou, share, across)")
def bbox_iou(spark, sf_dir):
    rows = spark.createDataFrame([(0, [0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 2.0, 2.0]), (1, [0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 1.0, 1.0]), (2, [0.1, 0.1, 0.5, 0.5], [0.1, 0.1, 0.5, 0.5])], "i int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    return rows.select("i", F.round(B.iou(a, b), 6).alias("iou"), F.round(B.share_inside(a, b), 6).alias("share"), F.round(B.horizontal_overlap(a, b), 6).alias("across"))


@query("bbox_union", "SELECT 0 AS i, '0.0,0.0,3.0,3.0' AS box, true AS near UNION ALL SELECT 1, '0.0,0.0,6.0,1.0', false")
def bbox_union(spark, sf_dir):
    rows = spark.createDataFrame([(0, [0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 2.0, 2.0]), (1, [0.0, 0.0, 1.0, 1.0], [5.0, 0.0, 1.0, 1.0])], "i int, a array<double>, b array<double>")
    return rows.select("i", F.array_join(F.transform(B.union_box(F.col("a"), F.col("b")), lambda x: x.cast("string")), ",").alias("box"), B.near(F.col("a"), F.col("b")).alias("near"))


@query("region_merge", "SELECT * FROM (VALUES (1, 0.1, 0.1, 0.41, 0.2), (1, 0.1, 0.7, 0.2, 0.2)) t(page, x, y, w, h)")
def region_merge(spark, sf_dir):
    rows = spark.createDataFrame([(1, 0.1, 0.1, 0.2, 0.2), (1, 0.31, 0.1, 0.2, 0.2), (1, 0.12, 0.12, 0.12, 0.12), (1, 0.1, 0.7, 0.2, 0.2), (1, 0.9, 0.9, 0.01, 0.01)], "page int, x double, y double, w double, h double")
    return B.merge_regions(rows, ["page"]).select("page", *[F.round(c, 6).alias(c) for c in "xywh"])


BIB = r"""@string{jx = "Journal of X"}
@article{doe2020, author = {Doe, Jane and {ACME and Sons}}, title = {A {B}{\'e}ta study}, journal = jx, year = 2020, month = mar, pages = {1--9}, doi = {10.1234/abc}}
@phdthesis{roe, author = "Richard Roe", title = "Deep things", school = "U", year = "1999"}"""


@query("bibtex_items", "SELECT * FROM (VALUES ('doe2020', 'journalArticle', 'A Béta study', 'Doe, Jane; ACME and Sons', '2020-03', 'Journal of X', '1-9'), ('roe', 'thesis', 'Deep things', 'Roe, Richard', '1999', NULL, NULL)) t(cite_key, item_type, title, creators, date, container, pages)")
def bibtex_items(spark, sf_dir):
    found = C.read_citations(spark.createDataFrame([(BIB,)], "t string"), "t", "bibtex")
    return found.select("cite_key", "item_type", "title", T.join_creators(F.col("creators")).alias("creators"), "date", "container", "pages")


@query("csl_items", "SELECT 'book' AS item_type, 'T' AS title, 'Doe, Jane' AS creators, '2020-01-02' AS date UNION ALL SELECT NULL, NULL, 'No authors listed', NULL")
def csl_items(spark, sf_dir):
    found = C.read_citations(spark.createDataFrame([('[{"type": "book", "title": "T", "author": [{"family": "Doe", "given": "Jane"}], "issued": {"date-parts": [[2020, 1, 2]]}}]',), ("not json",)], "t string"), "t", "csl_json")
    return found.select("item_type", "title", T.join_creators(F.col("creators")).alias("creators"), "date")


@query("bibtex_export", "SELECT c_custkey, '@misc{' || c_custkey || ',' || chr(10) || '  title = {' || replace(c_name, '#', chr(92) || '#') || '},' || chr(10) || '  note = {' || c_mktsegment || '}' || chr(10) || '}' AS entry FROM customer")
def bibtex_export(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", C.to_bibtex(F.col("c_custkey"), F.lit("document"), {"title": F.col("c_name"), "note": F.col("c_mktsegment"), "doi": F.lit(None)}).alias("entry"))


@query("markdown_card", "SELECT n_nationkey, '## ' || n_name || chr(10) || '**Region:** ' || n_regionkey AS card FROM nation")
def markdown_card(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", C.to_markdown(F.col("n_name"), {"Region": F.col("n_regionkey"), "Note": F.lit("")}).alias("card"))


@query("embedding_text", "SELECT doc_id, trim(lang) || ' ' || trim(source) AS t FROM documents")
def embedding_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.embedding_text(F.col("lang"), F.lit(None).cast("string"), F.col("source"), F.lit(" ")).alias("t"))
