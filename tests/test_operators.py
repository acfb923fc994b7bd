"""Hierarchies, passages, sync guards, index tables, streams, citations: edges beyond the queries."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackroom.functions import boxes as B
from stackroom.functions import text as T
from stackroom.operators import hierarchy as H
from stackroom.operators import passages as G
from stackroom.operators import sync as N
from stackroom.sources import citations as C
from stackroom.sources.index_table import IndexTable
from stackroom.streaming import streams as W


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 80))
def test_passages_cover_the_text(text, size, overlap):
    whole = text.strip()
    found = G.passages(text, size, overlap)
    assert all(whole[s:e].strip() == p for p, s, e in found)
    covered = {i for _, s, e in found for i in range(s, e)}
    assert {i for i, c in enumerate(whole) if not c.isspace()} <= covered


def test_passages_snap():
    text = "One sentence here. " * 20
    assert all(p.endswith("here.") for p, _, _ in G.passages(text, 100, 10))
    assert G.passages(None) == [] and len(G.passages("x" * 5000, most=2)) == 2


def test_best_window():
    text = "x " * 300 + "alpha beta alpha " + "y " * 300
    snippet, start = G.best_window("alpha beta", text, 60)
    assert "alpha beta" in snippet and text[start : start + 60].strip() == snippet
    assert G.best_window("zz", "short") == ("short", 0) and G.best_window("q", None) == ("", 0)


def test_fuzzy():
    ratio, a, z = G.fuzzy_find("some text with a smal typo in it", "a small typo")
    assert ratio > 0.8 and "typo" in "some text with a smal typo in it"[a:z]
    assert G.fuzzy_find("abc", "b")[0] == 1.0


def test_closure_of_random_forest(spark):
    random.seed(5)
    parent = {i: random.randrange(i) if i else None for i in range(60)}
    edges = spark.createDataFrame(list(parent.items()), "key long, parent long")
    got = {(r["ancestor"], r["node"]) for r in H.closure(edges).collect()}
    want = set()
    for n in parent:
        a = n
        while a is not None:
            want.add((a, n))
            a = parent[a]
    assert got == want


def test_closure_of_chain(spark):
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "key long, parent long")
    assert H.closure(edges).count() == 40 * 41 // 2


def test_paths_of_chain_and_cycle(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(50)] + [(100, 101, "x"), (101, 100, "y")]
    got = {r["node"]: r["path"] for r in H.paths(spark.createDataFrame(rows, "key int, parent int, name string")).collect()}
    assert all(got[i] == [f"n{k}" for k in range(i + 1)] for i in range(50))
    assert got[100] == ["y", "x"] and got[101] == ["x", "y"]


def test_descendants_of_unknown(spark):
    edges = spark.createDataFrame([(1, None), (2, 1)], "key long, parent long")
    assert H.descendants(edges, [9]).count() == 0


def test_ambiguous_names(spark):
    nodes = spark.createDataFrame([("a", None, "X"), ("b", "a", "Same"), ("c", None, "Y"), ("d", "c", "same")], "key string, parent string, name string")
    found = {r["spec"]: (r["matches"], r["node"]) for r in H.resolve(nodes, ["Same", "y/SAME", "d", "no"]).collect()}
    assert found == {"Same": (2, None), "y/SAME": (1, "d"), "d": (1, "d"), "no": (0, None)}


def test_deletion_guards(spark):
    index = spark.range(100).withColumnRenamed("id", "k")
    assert N.deletions(index, None, "k") is None
    assert N.deletions(index, index.where("k < 0"), "k") is None
    assert N.deletions(index, index.where("k < 90"), "k").count() == 10
    with pytest.raises(N.MassDeletion):
        N.deletions(index, index.where("k < 60"), "k")
    assert N.deletions(index, index.where("k < 60"), "k", allow_mass=True).count() == 40


def test_watermarks_and_triggers():
    assert N.next_watermark(5, 9, False) == 5 and N.next_watermark(5, 9, True) == 9 and N.next_watermark(5, 3, True) == 5 and N.next_watermark(5, None, True) == 5
    assert not N.should_update("manual", None, 0) and N.should_update("startup", 0, 1) and N.should_update("daily", 0, 86400) and not N.should_update("every_7", 0, 86400)


def test_index_table(spark, tmp_path):
    t = IndexTable(spark, f"file://{tmp_path}/t", "id", "g")
    assert not t.exists() and t.count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "id string, g int, v string")
    t.upsert(rows(("a", 1, "x"), ("b#0", 2, "y")))
    t.upsert(rows(("a", 1, "z")))
    assert {(r["id"], r["v"]) for r in t.read().collect()} == {("a", "z"), ("b#0", "y")}
    assert t.lookup("b").count() == 1
    t.update(rows(("a", 1, "w")), ["v"])
    assert t.read().where("id = 'a'").first()["v"] == "w"
    t.delete(rows(("a", 1, "")))
    assert [r["id"] for r in t.ids().collect()] == ["b#0"]
    t.truncate()
    assert t.count() == 0


def test_upsert_stream_is_idempotent(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "id string, version int, v string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "q")], schema).coalesce(1).write.parquet(src)
    t = IndexTable(spark, f"file://{tmp_path}/out", "id")
    W.upsert_stream(W.file_stream(spark, src, schema), t, "version", f"{tmp_path}/c1").awaitTermination()
    spark.createDataFrame([("a", 1, "late"), ("c", 1, "n")], schema).coalesce(1).write.mode("append").parquet(src)
    W.upsert_stream(W.file_stream(spark, src, schema), t, "version", f"{tmp_path}/c1").awaitTermination()
    W.upsert_stream(W.file_stream(spark, src, schema), t, "version", f"{tmp_path}/c2").awaitTermination()
    assert {(r["id"], r["v"]) for r in t.read().collect()} == {("a", "y"), ("b", "q"), ("c", "n")}


def test_library_watermarks(spark, tmp_path):
    w = W.Watermarks(spark, f"file://{tmp_path}/w")
    assert w.get(0) is None
    w.put(0, 5)
    w.put(7, 9)
    assert (w.get(0), w.get(7), w.get(8)) == (5, 9, None)


def test_running_totals(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double").write.parquet(f"{tmp_path}/in")
    q = W.running_totals(W.file_stream(spark, f"{tmp_path}/in", "k string, v double"), "k", "v").writeStream.format("memory").queryName("totals").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["n"], r["total"]) for r in spark.table("totals").collect()} == {("a", 2, 3.0), ("b", 1, 5.0)}


def test_bibtex_errors_do_not_stop(spark):
    items = [C.bibtex_item(e) for e in C.parse_bibtex("@article{a, title={open\n@book{b, title={Fine}}")]
    assert items and C.parse_bibtex("") == []
    assert C.split_authors("A and {B and C} and D") == ["A", "{B and C}", "D"]
    assert C.untex(r"{\'e}l{\`e}ve \& co") == "élève & co"
    with pytest.raises(ValueError):
        C.coerce_csl("3")


def test_captions():
    pairs = B.match_captions([[0.1, 0.1, 0.3, 0.3], [0.6, 0.1, 0.3, 0.3]], [[0.1, 0.42, 0.3, 0.05], [0.6, 0.42, 0.3, 0.05]])
    assert [(r, c) for r, c, _, _ in pairs] == [(0, 0), (1, 1)] and all(x[3] == "high" for x in pairs)
    assert B.match_captions([], []) == []


def test_query_variants():
    assert T.query_variants("Müller")[0] == "Müller" and {"Muller", "Mueller"} <= set(T.query_variants("Müller"))
    assert T.query_variants("a b") == ["a b", "a-b"] and T.query_variants("") == []


def test_fold_agrees_with_constants(spark):
    words = ["Müller", "ÅNGSTRÖM", "straße", "Łódź", "a—b", "王"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.fold(F.col("w"))).collect()]
    assert got == [T.fold_value(w) for w in words]


def test_identifier_punctuation_is_stripped_to_the_end(spark):
    from stackroom.functions import identifiers as I

    values = ["10.1234/ab" + "." * 20, "10.1234/a(b)c" + ")" * 15, "10.1234/a(b)", "10.1234/x;,.];)", "10.1234/plain", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(I.normalize_doi(F.col("v"))).collect()]
    assert got == ["10.1234/ab", "10.1234/a(b)c", "10.1234/a(b)", "10.1234/x", "10.1234/plain", None]


def test_nearest_orders_by_the_exact_score(spark):
    from stackroom.operators import vector as V

    rows = spark.createDataFrame([(1, [1.0, 0.0001]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert V.nearest(rows, V.literal_vector([1.0, 0.0]), 1, "id", "v").first()["id"] == 2


def test_fuzzy_find_in_long_texts():
    """Against every window, over a text of more than 10,000 characters."""
    import difflib
    import random

    random.seed(5)
    text = "".join(random.choice("abc de") for _ in range(12_000))
    pattern = text[7_001:7_031].replace("a", "x", 2)[::-1][::-1] + "q"
    width = int(1.2 * len(pattern))
    match = difflib.SequenceMatcher(None, b=pattern, autojunk=False)
    best = (0.0, 0)
    for i in range(len(text) - len(pattern) + 1):
        match.set_seq1(text[i : i + width])
        if match.real_quick_ratio() > best[0] and match.quick_ratio() > best[0] and match.ratio() > best[0]:
            best = (match.ratio(), i)
    assert G.fuzzy_find(text, pattern)[:2] == best and G.fuzzy_find(text, pattern, best[0]) == (0.0, 0, 0)
    long = text[500:600].replace("d", "y")
    ratios = [difflib.SequenceMatcher(None, text[i : i + 120], long, autojunk=False).ratio() for i in range(901)]
    assert G.fuzzy_find(text[:1000], long)[:2] == (max(ratios), ratios.index(max(ratios)))


def test_window_bounds_hold():
    import difflib
    import random

    random.seed(6)
    for n in (1, 7, 23, 64, 70):
        text, pattern = ("".join(random.choice("ab é中") for _ in range(k)) for k in (300, n))
        width, places = max(1, int(1.2 * n)), max(1, 300 - n + 1)
        bounds = G._window_bounds(text, pattern, width, places)
        assert all(difflib.SequenceMatcher(None, text[i : i + width], pattern, autojunk=False).ratio() <= bounds[i] + 1e-9 for i in range(places))


def _most_like(pages, pattern):
    """(ratio, page, start, end) by SequenceMatcher over every window; page -1 if nothing is alike."""
    import difflib

    width, best = max(1, int(1.2 * len(pattern))), (0.0, -1, 0, 0)
    for k, t in enumerate(pages):
        if (a := t.find(pattern)) >= 0:
            return 1.0, k, a, a + len(pattern)
        for i in range(max(1, len(t) - len(pattern) + 1)):
            r = difflib.SequenceMatcher(None, t[i : i + width], pattern, autojunk=False).ratio()
            if r > best[0]:
                best = (r, k, i, min(len(t), i + width))
    return best


def test_fuzzy_pages_against_every_window(spark, monkeypatch):
    """Documents together, pages cut into parts, patterns of one word of bits and of more."""
    from pyspark.sql import functions as F

    random.seed(7)
    for trial in range(24):
        monkeypatch.setattr(G, "CHARS", random.choice([1, 17, 100, 1 << 20]))
        monkeypatch.setattr(G, "BLOCK", random.choice([1, 7, 1 << 14]))
        monkeypatch.setattr(G, "FEW", random.choice([0, 1 << 13]))
        letters, n = random.choice(["ab", "abc de", "ab é中😀"]), (1, 2, 23, 32, 33, 64, 65, 130)[trial % 8]
        text = lambda k: "".join(random.choice(letters) for _ in range(k))
        docs = [[text(random.choice([0, 1, n - 1, n, n + 9, 150])) for _ in range(random.randrange(4))] for _ in range(3)]
        pattern = text(n)
        assert G.fuzzy_pages(docs, pattern) == [_most_like(d, pattern) for d in docs]
    monkeypatch.undo()
    pattern = "the and of the in thand"
    docs = [["none", "a the and of thy in thands"], ["x", None, f"so {pattern}", pattern], ["", ""], [], None, ["\t" * 40]]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, pages array<string>")
    got = [tuple(r["f"]) for r in df.withColumn("f", G.find_in_pages(F.col("pages"), pattern)).orderBy("id").collect()]
    want = [_most_like([t or "" for t in d or []], pattern) for d in docs]
    assert got == [(max(k, 0 if d else -1) + 1, r, a, z, r >= 0.85) for d, (r, k, a, z) in zip(docs, want, strict=True)]
    assert [g[0] for g in got] == [2, 3, 1, 0, 0, 1]


def test_fuzzy_find_has_no_python_step_per_window():
    """Many windows have a bound above the best ratio; the Python calls don't grow with them."""
    import sys

    def calls(text):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event == "call"

        sys.setprofile(count)
        try:
            G.fuzzy_find(text, "the and of the in thand")
        finally:
            sys.setprofile(None)
        return n

    random.seed(8)
    text = "".join(random.choice("adefhinot  ") for _ in range(10_000))
    few, many = calls(text[:2_000]), calls(text)
    assert many < 2 * few, (few, many)


def test_descendants_walk_down(spark):
    from stackroom.operators import hierarchy as H

    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "gone")], "key string, parent string")
    found = lambda *roots: {r["node"] for r in H.descendants(edges, roots).collect()}
    assert found("b") == {"b", "c", "d"} and found("x") == {"x", "y"} and found("gone") == set() and found("a", "z") == {"a", "b", "c", "d", "z"}


def test_refresh_leaves_later_items(spark, tmp_path):
    """Items that arrive while the index is written are not passed over by the watermark."""
    from stackroom.operators import maintain, vector
    from stackroom.sources.index_table import IndexTable
    from stackroom.streaming.streams import Watermarks

    path = f"{tmp_path}/items"
    put = lambda rows, mode: spark.createDataFrame(rows, "key string, text string, version long").write.mode(mode).parquet(path)
    put([("a", "first text", 1), ("b", "second text", 2)], "overwrite")
    table, marks = IndexTable(spark, f"{tmp_path}/index"), Watermarks(spark, f"{tmp_path}/marks")

    class Late(IndexTable):
        def replace(self, df):
            super().replace(df)
            if not marks.table.exists():
                put([("c", "third text", 3)], "append")

    late = Late(spark, f"{tmp_path}/index")
    run = lambda t: maintain.refresh(spark.read.parquet(path), t, marks, 0, "key", "text", "version", vector.hash_embedder())
    assert run(late).watermark == 2 and run(late).watermark == 3
    assert {r["parent"] for r in table.read().select("parent").collect()} == {"a", "b", "c"}


def test_citation_formats_and_types():
    assert C.format_of("  @book{a, title={x}}") == "bibtex" and C.format_of(None) == "bibtex"
    assert C.format_of('[{"title": "x"}]') == "csl_json" and C.format_of('{"title" : ["x"]}') == "registry"
    record = C.registry_item({"type": "book-chapter", "title": ["A", "B"], "container-title": [], "ISBN": ["978-1", "978-2"], "author": [{"given": "J", "family": "Doe"}], "issued": {"date-parts": [[2020, 3]]}})
    assert (record["item_type"], record["title"], record["isbn"], record["date"]) == ("bookSection", "A", "978-1 978-2", "2020-03")
    assert record["container"] is None and record["creators"][0]["last"] == "Doe"
    assert C.csl_item({"type": "pamphlet"})["item_type"] == C.csl_item({"type": "no such"})["item_type"] == "document"
    assert C.bibtex_item({"type": "suppbook", "fields": {}})["item_type"] == "bookSection"
