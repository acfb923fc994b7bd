"""Quality rules, licence scan, URL filter, HTML extraction against brute force and by cases."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from stackroom.llm import html_text as H
from stackroom.llm import license_scan as L
from stackroom.llm import quality_rules as Q
from stackroom.llm import queries as R
from stackroom.llm import url_filter as U

MASK = (1 << 64) - 1


def documents(spark, sf_dir, n=120):
    """Real rows and the hard ones: null, empty, blank, very long, repeated, odd ids."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(n).collect()]
    rows += [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "word " * 30000), (9004, rows[3][1]), (9005, "a b c d e f g h " * 4), (9006, "One line\nOne line\n\nother # $ %"), (9007, "é ü　x y"), (9008, "x"), (9008, "x"), (None, "no id here at all")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "score": F.lit(None), "words": F.lit(1)})


def spark_hash(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h & MASK)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("broadcast", [True, False])
def test_quality_rules(spark, sf_dir, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(Q, "BROADCAST_IDS", 0)
    docs = documents(spark, sf_dir)
    labels = spark.createDataFrame([(i, i % 3 and 1, 0) for i in range(0, 120, 2)] + [(None, 1, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect() if r["doc_id"] is not None}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = lambda w: [spark_hash(x) % Q.BUCKETS for x in w] + [spark_hash(a, b) % Q.BUCKETS for a, b in zip(w, w[1:], strict=False)]
    raw, target = Counter(), Counter()
    for i, t in rows:
        g = grams(split(t))
        raw.update(g)
        if i in trusted:
            target.update(g)
    raws, targets = sum(raw.values()), sum(target.values())

    def weight(b):
        return round(1e6 * (math.log((target[b] + 1) / (targets + Q.BUCKETS)) - math.log((raw[b] + 1) / (raws + Q.BUCKETS))))

    def judge(i, t):
        w, t = split(t), t or ""
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        covered = {j for v in places.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if split(x)]
        g = grams(w)
        score = sum(weight(b) for b in g) / len(g) / 1e6 if g else 0.0
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        return (i, len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered), failed, not failed and score >= Q.THRESHOLD, score)

    got = [tuple(r) for r in Q.quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [judge(i, t) for i, t in rows]
    assert [g[:8] for g in sorted(got, key=key)] == [w[:8] for w in sorted(want, key=key)]
    assert all(abs(g[8] - w[8]) < 2e-6 for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True))


def test_quality_rules_keep_clean_and_drop_junk(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = Q.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).join(labels, "doc_id").where("NOT base_failed")
    clean = out.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.95


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.quality_rules(none, labels).collect() == []
    assert L.license_scan(none).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert U.filter_urls(pages).collect() == [] and H.extract_main_text(pages).collect() == []


def check_sql(spark, name, tables, query):
    """A query's function and its SQL over tables of this test."""
    c = duckdb.connect()
    for t, df in tables.items():
        c.execute(f"CREATE TABLE {t} ({', '.join(f'{n} {k.upper()}' for n, k in df.dtypes)})")
        if rows := [tuple(r) for r in df.collect()]:
            c.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(df.columns))})", rows)
    cursor = c.execute(R.ORACLES[name])
    names = [x[0] for x in cursor.description]
    out = query.select(*names)
    show = lambda r: tuple(repr(round(x, 6) if isinstance(x, float) else x) for x in r)
    assert sorted(map(show, out.collect())) == sorted(map(show, cursor.fetchall()))


BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
LICENSE_CASES = [
    (None, ""),
    ("", ""),
    ("All Rights Reserved", "reserved"),
    ("all  rights-reserved!", "reserved"),
    ("He has all the rights he wanted, though the table was reserved by her.", ""),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by,cc-by-nc-sa-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("This program is licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "gpl,lgpl-3.0"),
    ("licensed under the apache license version 2.0", "apache-2.0"),
    ("This is under the General Public License", "gpl"),
    (BSD_TEXT, "bsd"),
    ("// " + BSD_TEXT.replace("\n", "\n// "), "bsd"),
    (MPL_TEXT, "mpl-2.0"),
    (L.TEMPLATES[8][2], "mit"),
    ("words before " * 300 + L.TEMPLATES[10][2].replace(" ", "\n") + " and after" * 500, "bsd"),
    ("permission person software copy charge granted free obtaining hereby any this is to of a", ""),
    ("xcc by", ""),
    ("cc\nby", "cc-by"),
    ("é all rights reservedé", ""),
    ("a b " * 20000 + "\nAll rights reserved.", "reserved"),
]


def test_license_scan_cases(spark, sf_dir):
    texts = [t for t, _ in LICENSE_CASES]
    shuffled = " ".join(sorted(w for _, _, t in L.TEMPLATES for w in L._words(t)))
    rows = [*enumerate(texts), (3, "no licence under a repeated id"), (None, MPL_TEXT), (None, None), (900, (shuffled + " ") * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_sql(spark, "op4_license_scan", {"documents": df}, L.license_scan(df.withColumns({"n_words": F.lit(0), "labels": F.lit("x"), "row": F.lit(1), "t": F.lit("y")})))
    got = [(r["doc_id"], r["labels"]) for r in L.license_scan(df).collect()]
    assert sorted(x for x in got if x[0] is not None and x[0] != 900) == sorted([*((i, want) for i, (_, want) in enumerate(LICENSE_CASES)), (3, "")])
    assert sorted(x[1] for x in got if x[0] is None) == ["", "mpl-2.0"] and (900, "") in got


@pytest.mark.parametrize("broadcast", [True, False])
def test_license_join_is_exact(spark, monkeypatch, broadcast):
    """Against all windows times all templates, over random mixtures of template runs."""
    import random

    if not broadcast:
        monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    random.seed(2)
    every = [L._words(t) for _, _, t in L.TEMPLATES]
    texts = []
    for i in range(200):
        words = []
        for _ in range(random.randrange(1, 4)):
            run = list(random.choice(every))
            for _ in range(random.randrange(0, 1 + len(run) // 8)):
                run[random.randrange(len(run))] = random.choice(["x", "the", "license"])
            words += ["and"] * random.randrange(0, 40) + run[: random.randrange(len(run) // 2, len(run) + 1)]
        texts.append((i, "\n".join(words)))
    rows = L.template_rows(L.TEMPLATES, L.CONTAINMENT)
    docs = L.described(spark.createDataFrame(texts, "doc_id long, t string"), sorted({r[2] for r in rows}), min(r[5] for r in rows))
    ids = {r["row"]: r["doc_id"] for r in docs.select("row", "doc_id").collect()}
    got = {(ids[r["row"]], r["first"], r["label"], round(r["containment"], 9)) for r in L.block_hits(docs, rows).collect()}
    want = set()
    for i, t in texts:
        words = L._words(t)
        for k, (label, _, _) in enumerate(L.TEMPLATES):
            mine = [r for r in rows if r[0] == k]
            have, must, (size, need, stride) = {r[2] for r in mine}, {r[2] for r in mine if r[3]}, mine[0][4:]
            for first in range(0, len(words), stride):
                block = words[first : first + 2 * stride]
                both = have & {f"{a} {b}" for a, b in zip(block, block[1:], strict=False)}
                if len(both) >= need and must <= both:
                    want.add((i, first, label, round(len(both) / size, 9)))
    assert got == want and len(want) > 200


URLS = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://Example.ORG/es/x?y", "https://sub.example.org/en/17#z", "https://example.org/en/2", "http://fr.com/fr/", "http://x.com/de/a", "http://x.com/de", "http://com/fr/a", "http://xorg/", "ftp://a.org?q=/es/", "http://a.b.com//de/", "http://http://org/x"]


def test_url_filter_cases(spark):
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate([*URLS, URLS[6]])], "page_id long, url string, html string")
    check_sql(spark, "op5_url_filter", {"pages": df}, U.filter_urls(df.withColumns({"host": F.lit("x"), "verdict": F.lit(1)})))


def test_url_trie_precedence():
    t = U.UrlTrie([("allow", "com", ""), ("block", "bad.com", ""), ("allow", "bad.com", "/ok"), ("block", "com", "/x/"), ("allow", "com", "/x/"), ("block", "", "/nohost")])
    assert t.match("bad.com", "/no")[1] == "block" and t.match("a.bad.com", "/okay/z") == ("bad.com/ok", "allow")
    assert t.match("good.com", "/x/y")[1] == "block" and t.match("net", "/x/") is None and t.match("", "/nohost")[1] == "block"
    with pytest.raises(ValueError):
        U.UrlTrie(("allow", str(i), "") for i in range(U.MAX_RULES + 1))


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b &eacute;\n  c</p><aside>no</aside>", "a\nb é c"),
        ("<nav>menu</nav><div class='content'><h1>T</h1><p>one two three</p></div><div id=cookie-notice>ok</div><footer>f</footer>", "T\none two three"),
        ("<article><p>first words of it</p><form><input>send</form><ul><li>x<li>y</ul><section class='comments'><p>troll</p></section></article>", "first words of it\nx\ny"),
        ("<article>a<br>b<script>if (a<b) {}</script><style>p{}</style> c</article>", "a\nb c"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<div class=article-body><p>long text here now</p><div class='share-buttons'>tweet</div></div>", "long text here now"),
        ("<p>open <b>bold <i>both</b> still", "open bold both still"),
        ("<!-- <p>no</p> --><p>yes</p><!-- never closed <p>no</p>", "yes"),
        ("<p don't>it's</p><p title=\"x>y</p><a href='a>b'>l</a>", "it's\ny\nl"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>", "deep\nafter"),
        ("<h1>&lt;b&gt;</h1><p>x&nbsp;y</p>", "<b>\nx y"),
    ],
)
def test_html_cases(html, text):
    assert H.extract(html, None) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div class='content has-sidebar'><p>the article</p><div class='sidebar'>side</div></div>", "the article"),
        ("<div id='page' class='content-with-sidebar'><p>the article</p></div><p>rest</p>", "the article\nrest"),
        ("<div class='post comments-open'><p>the article</p><div class='post-comments'>troll</div></div>", "the article"),
        ("<div class='post'><div class='entry-header'><h1>Title</h1></div><p>the article</p></div>", "Title\nthe article"),
        ("<p>rest</p><div class='promo'><p>one two three four five</p></div>", "rest\none two three four five"),
        ("<div class='content'><p>short article</p><div class='comments'>many many more words of others</div></div>", "short article"),
        ("<div>" * 300 + "deep<aside>side<p>more</p></aside><div class='comments'>troll<div>x</div>y</div><nav>menu</nav> end" + "</div>" * 300, "deep\nend"),
        ("<div>" * 256 + "deep<nav>menu" + "</div>" * 256 + "<p>after</p>", "deep\nafter"),
    ],
)
def test_html_keeps_the_whole_article(html, text):
    assert H.extract(html, None) == text


def test_host_consensus(spark):
    """A page whose side column is longer than its article follows its host's other pages."""
    good = "<body><div class='col main1'><p>{}</p></div><div class='extra2'><p>{}</p></div></body>"
    long, short = "long story told here " * 20, "little thing "
    pages = [(i, "http://h.org/a", good.format(long, short)) for i in range(6)] + [(6, "http://h.org/b", good.format("the article of this page " * 4, "side talk " * 14)), (7, None, None), (8, "http://h.org/b", "<p>none of it</p>")]
    got = {r["page_id"]: r["text"] for r in H.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[0] == long.strip() and got[6].startswith("the article of this page") and got[7] == "" and got[8] == "none of it"


def test_html_on_pages(spark, sf_dir):
    """Against a direct reading of the test pages' own template."""
    from html import unescape

    for r in H.extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_host_votes_against_brute_force(spark, sf_dir):
    """Counts, ties, winners and texts as a loop over the pages of each host gives them."""
    import random

    random.seed(7)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    part = lambda c, n: f"<div class='{c}'>" + "".join(f"<p>{' '.join(random.choices('ab cd ef gh'.split(), k=9))}</p>" for _ in range(n)) + "</div>"
    for i in range(60):
        body = part(random.choice(["content a1", "story b2", "x"]), random.randrange(1, 5)) + part(random.choice(["content a1", "side2 y", "x"]), random.randrange(0, 4))
        rows.append((9000 + i, random.choice([f"http://h{i % 4}.org/p", None, "none"]), random.choice([f"<body>{body}</body>", body, None, ""])))
    votes = defaultdict(Counter)
    host = lambda u: re.split("[/?#]", u.split("://", 1)[1])[0].lower() if u and "://" in u else ""
    for _, u, h in rows:
        if (path := H.vote(h)) is not None:
            votes[host(u)][path] += 1
    winner = {k: min(c, key=lambda p: (-c[p], -p.count("/"), p)) for k, c in votes.items()}
    want = sorted((i, H.extract(h, winner.get(host(u))), winner.get(host(u)) or "") for i, u, h in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["host_path"] or "") for r in H.extract_main_text(df).collect()) == want


@pytest.mark.parametrize("depth", [10, 300, 5000])
def test_html_skips_at_any_depth(depth):
    page = "<body>" + "<div>" * depth + "<nav>menu menu</nav><aside>advert</aside><form><p>sign up</p></form><div class='comments'>reader</div><p>the article itself</p>" + "</div>" * depth + "<p>and its end</p></body>"
    assert H.extract(page, None) == "the article itself\nand its end"
