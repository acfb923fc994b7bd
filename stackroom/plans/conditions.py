"""Queries: condition operators, several conditions, tag language, keyword searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.text import fold_sql
from ..operators import predicates as P
from ..operators import search as S
from ..session import table

#: documents with their labels: quality is missing for most, toxic documents are the trash.
ITEMS_SQL = "(SELECT d.*, l.quality::VARCHAR AS quality FROM documents d LEFT JOIN labels l USING (doc_id))"


def items(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left")


def fields():
    return {
        "text": P.Field("scalar", F.col("text")),
        "lang": P.Field("scalar", F.col("lang")),
        "source": P.Field("scalar", F.col("source")),
        "quality": P.Field("scalar", F.col("quality")),
        "n_chars": P.Field("scalar", F.col("n_chars").cast("string")),
        "year": P.Field("dated", F.col("quality")),
    }


def _one(name, field, operation, value, where):
    """A query of one condition and its SQL."""

    def run(spark, sf_dir):
        return items(spark, sf_dir).where(P.condition(fields(), field, operation, value)).select("doc_id")

    query(name, f"SELECT doc_id FROM {ITEMS_SQL} WHERE {where}")(run)


_lang, _quality, _text, _source = (fold_sql(c) for c in ("lang", "quality", "text", "source"))
_one("op_is", "lang", "is", "FR", f"{_lang} = 'fr'")
_one("op_is_not", "quality", "isNot", "1", f"NOT ({_quality} = '1')")
_one("op_contains", "text", "contains", "Étre", f"contains({_text}, 'etre')")
_one("op_does_not_contain", "quality", "doesNotContain", "0", f"NOT contains({_quality}, '0')")
_one("op_begins_with", "text", "beginsWith", "the", f"starts_with({_text}, 'the')")
_one("op_ends_with", "source", "endsWith", "1", f"ends_with({_source}, '1')")
_one("op_greater_than", "n_chars", "isGreaterThan", "2500", "n_chars > 2500")
_one("op_less_than", "n_chars", "isLessThan", "400", "n_chars < 400")
_one("op_range_missing", "quality", "isLessThan", "m", "quality IS NOT NULL")
_one("op_year_is_not", "year", "isNot", "1", "quality IS NOT NULL AND quality <> '1'")
_one("op_unfolded_like", "text", "contains", "50%_x", f"contains({_text}, '50%_x')")


@query("op_before", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') < '1993-06-15'")
def op_before(spark, sf_dir):
    f = {"date": P.Field("dated", F.date_format("o_orderdate", "yyyy-MM-dd"))}
    return table(spark, sf_dir, "orders").where(P.condition(f, "date", "isBefore", "1993-06-15")).select("o_orderkey")


@query("op_after", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') > '1996-12-31'")
def op_after(spark, sf_dir):
    f = {"date": P.Field("dated", F.date_format("o_orderdate", "yyyy-MM-dd"))}
    return table(spark, sf_dir, "orders").where(P.condition(f, "date", "isAfter", "1996-12-31")).select("o_orderkey")


FLAGSHIP_SQL = """
SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d
WHERE lower(d.lang) = 'en' AND contains(lower(d.text), 'the') AND d.n_chars > 500
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)
ORDER BY d.n_chars DESC NULLS LAST, d.doc_id LIMIT 20
"""


@query("adv_all", FLAGSHIP_SQL)
def adv_all(spark, sf_dir):
    """Conditions together, without the trash, longest first, 20 rows."""
    trash = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    wanted = [{"field": "lang", "operation": "is", "value": "en"}, {"field": "text", "operation": "contains", "value": "the"}, {"field": "n_chars", "operation": "isGreaterThan", "value": "500"}]
    found = S.search(table(spark, sf_dir, "documents"), {k: v for k, v in fields().items() if k not in ("quality", "year")}, wanted, trash=trash, key="doc_id", sort=[("n_chars", "desc")], limit=20)
    return found.select("doc_id", "lang", "source", "n_chars")


@query("adv_any", f"SELECT doc_id FROM {ITEMS_SQL} WHERE {_lang} = 'de' OR quality IS NOT NULL AND {_quality} = '0' OR n_chars < 200")
def adv_any(spark, sf_dir):
    wanted = [{"field": "lang", "operation": "is", "value": "de"}, {"field": "quality", "operation": "is", "value": "0"}, {"field": "n_chars", "operation": "isLessThan", "value": "200"}]
    return items(spark, sf_dir).where(P.all_or_any(fields(), wanted, "any")).select("doc_id")


@query("adv_mixed_negation", f"SELECT doc_id FROM {ITEMS_SQL} WHERE NOT ({_quality} = '1') AND NOT contains({_lang}, 'en') AND starts_with({_source}, 'src1')")
def adv_mixed_negation(spark, sf_dir):
    wanted = [{"field": "quality", "operation": "isNot", "value": "1"}, {"field": "lang", "operation": "doesNotContain", "value": "en"}, {"field": "source", "operation": "beginsWith", "value": "src1"}]
    return items(spark, sf_dir).where(P.all_or_any(fields(), wanted)).select("doc_id")


@query("adv_page", f"SELECT doc_id FROM {ITEMS_SQL} WHERE {_lang} = 'en' ORDER BY source NULLS LAST, doc_id LIMIT 25 OFFSET 50")
def adv_page(spark, sf_dir):
    found = S.search(items(spark, sf_dir), fields(), [{"field": "lang", "operation": "is", "value": "en"}], key="doc_id", sort=[("source", "asc")], limit=25, offset=50)
    return found.select("doc_id")


def _flags(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("flags"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")


_FLAGS = "(SELECT o_orderkey, list(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N') AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"


@query("multi_any", f"SELECT o_orderkey FROM {_FLAGS} WHERE list_contains(flags, 'R')")
def multi_any(spark, sf_dir):
    return _flags(spark, sf_dir).where(P.multi(F.col("flags"), "is", "r")).select("o_orderkey")


@query("multi_all_negated", f"SELECT o_orderkey FROM {_FLAGS} WHERE len(flags) > 0 AND NOT list_contains(flags, 'R')")
def multi_all_negated(spark, sf_dir):
    """Orders without values satisfy nothing, not even a negation."""
    return _flags(spark, sf_dir).where(P.multi(F.col("flags"), "isNot", "R")).select("o_orderkey")


@query("creator_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def creator_exists(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").where(P.compare(F.col("l_returnflag"), "a", "is")).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(hit, "o_orderkey", "left_semi").select("o_orderkey")


@query("creator_not_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def creator_not_exists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    hit = lines.where(P.compare(F.col("l_returnflag"), "a", "is"))
    return table(spark, sf_dir, "orders").join(lines.select("o_orderkey"), "o_orderkey", "left_semi").join(hit.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey")


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " "))


_TAGS = "string_split(lower(p_name), ' ')"


def _tags(name, entries, where):
    def run(spark, sf_dir):
        return parts(spark, sf_dir).where(P.tag_filter(F.col("tags"), entries)).select("p_partkey")

    query(name, f"SELECT p_partkey FROM part WHERE {where}")(run)


_tags("tag_dsl_and", ["red", "part"], f"list_contains({_TAGS}, 'red') AND list_contains({_TAGS}, 'part')")
_tags("tag_dsl_or", ["red OR blue||green"], f"list_contains({_TAGS}, 'red') OR list_contains({_TAGS}, 'blue') OR list_contains({_TAGS}, 'green')")
_tags("tag_dsl_exclude", ["-red"], f"NOT list_contains({_TAGS}, 'red')")
_tags("tag_dsl_mixed", ["red OR -part", "-blue", " - "], f"(list_contains({_TAGS}, 'red') OR NOT list_contains({_TAGS}, 'part')) AND NOT list_contains({_TAGS}, 'blue')")


@query("keyword_topk", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'the in') ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10")
def keyword_topk(spark, sf_dir):
    """The spelling with a dash is no other here: no text has it."""
    found = S.keyword_search(table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("the-in"), F.lit(""))), "The in", [F.col("text")], key="doc_id", sort=[("n_chars", "desc")])
    return found.select("doc_id", "n_chars")


@query("keyword_everything", "SELECT doc_id FROM documents WHERE contains(lower(text), 'anon') OR contains(lower(source), 'anon') OR contains(lower(lang), 'anon') ORDER BY doc_id LIMIT 100")
def keyword_everything(spark, sf_dir):
    return S.keyword_search(table(spark, sf_dir, "documents"), "anon", [F.col("text"), F.col("source"), F.col("lang")], key="doc_id", limit=100).select("doc_id")


@query("keyword_variants", "SELECT conv_id, turn FROM (SELECT conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM conversations) WHERE contains(t, 'für') OR contains(t, 'fuer') OR contains(t, 'fur')")
def keyword_variants(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(S.any_contains([F.col("text")], "für")).select("conv_id", "turn")


@query("search_cascade", "SELECT doc_id, 2 AS attempt FROM documents WHERE contains(lower(text), 'worthless') ORDER BY n_chars DESC, doc_id LIMIT 10")
def search_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    attempts = [docs.where(P.scalar(F.col("source"), "is", "worthless")), docs.where(P.scalar(F.col("lang"), "contains", "worthless")), docs.where(P.scalar(F.col("text"), "contains", "worthless"))]
    i, found = S.cascade([lambda a=a: a for a in attempts])
    return found.orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", F.lit(i).alias("attempt"))


@query("variant_union", "SELECT doc_id, min(a) AS attempt FROM (SELECT doc_id, 0 AS a FROM documents WHERE contains(lower(text), 'idiot') UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(lower(text), 'clown')) GROUP BY doc_id")
def variant_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = S.ranked_union([docs.where(S.any_contains([F.col("text")], w)).select("doc_id", "lang") for w in ("idiot", "clown")], "doc_id")
    return found.select("doc_id", "attempt")


@query("notes_search", r"SELECT conv_id, turn, substr(regexp_replace(text, '<[^\n]*?>', '', 'g'), 1, 200) AS snippet FROM conversations WHERE contains(lower(regexp_replace(text, '<[^\n]*?>', '', 'g')), 'the') ORDER BY conv_id, turn LIMIT 20")
def notes_search(spark, sf_dir):
    notes = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return S.search_notes(notes, "text", "the", "key").select("conv_id", "turn", "snippet")


@query("word_and_search", "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name), 'n') AND contains(lower(n_name), '1')")
def word_and_search(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(S.all_words(F.col("n_name"), "N 1")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


@query("whole_text_search", f"SELECT doc_id FROM documents WHERE contains({fold_sql("concat_ws(' ', text, lang, source)")}, 'en src1') ORDER BY doc_id LIMIT 50")
def whole_text_search(spark, sf_dir):
    return S.whole_text(table(spark, sf_dir, "documents"), ["text", "lang", "source"], "EN src1", "doc_id").select("doc_id")


@query("type_exclusion", "SELECT doc_id FROM documents WHERE lower(lang) <> 'en'")
def type_exclusion(spark, sf_dir):
    return S.of_type(table(spark, sf_dir, "documents"), "-EN", "lang").select("doc_id")


@query("scope_one", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def scope_one(spark, sf_dir):
    return S.in_scope(table(spark, sf_dir, "customer"), S.parse_scope("group:3"), "c_nationkey").select("c_custkey")


@query("scope_all_libraries", "SELECT count(*) AS n FROM customer")
def scope_all(spark, sf_dir):
    return S.in_scope(table(spark, sf_dir, "customer"), S.parse_scope("all"), "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("live_items_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def live_items(spark, sf_dir):
    return S.live(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id")


@query("citation_key_lookup", "SELECT doc_id FROM documents ORDER BY CASE WHEN source || '-' || doc_id = 'src7-7' THEN 0 WHEN doc_id = 3 THEN 1 ELSE 2 END, doc_id LIMIT 1")
def citation_key_lookup(spark, sf_dir):
    from ..functions.text import citation_key

    docs = table(spark, sf_dir, "documents").withColumn("extra", F.when(F.col("doc_id") == 3, F.lit("note: x\nCitation Key: src7-7")))
    return S.by_citation_key(docs, "src7-7", F.concat_ws("-", "source", "doc_id"), citation_key(F.col("extra")), "doc_id").select("doc_id")


@query("like_escape", "SELECT doc_id FROM documents WHERE text LIKE '%' || chr(92) || '%' || chr(92) || '%' || '%' ESCAPE chr(92)")
def like_escape(spark, sf_dir):
    pattern = P.like_pattern("contains", "%%")
    return table(spark, sf_dir, "documents").where(F.col("text").like(pattern)).select("doc_id")
