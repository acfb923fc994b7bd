"""Main text of web pages by consensus host paths.

Pass 1 parses every page and scores its containers: words of the container that are not in
links, less those in links, over all blocks below it, with a bonus for the element names
and class words that hold articles and a penalty for those that hold menus, notices and
adverts. Every page votes for the generalised path (tags with their classes, digits as #)
of its best container; Spark counts the votes per (host, path), combined in the map tasks, and
keeps each host's winner. Pass 2 parses again and takes the text from the winning path's
containers, or from the page's own best container where the page lacks that path or holds
little of its text there. The winners, one row per host, are broadcast only if they are at most
BROADCAST_HOSTS rows; more are joined by a shuffle, whose hot hosts AQE splits.

Within the container everything that is not the article is left out: the elements in SKIP,
and elements whose class or id names a part that is not the article. A name that only tells of
such a part (has-sidebar, comments-open) or heads the article (entry-header) skips nothing, and
on a page without text in an element named as article, one that holds most of the words outside
links is kept whatever its name, but comments only where there is nothing else.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import sliced
from .common import read, shared_table
from .url_filter import url_parts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SKIP = frozenset("script style noscript template iframe svg math canvas object nav header footer aside form button select input textarea label fieldset menu dialog head title audio video map xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCKS - frozenset(["br", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"])
#: Opening the key ends an open one of the values, up to the nearest of the stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CONTAINERS = frozenset("article main section div body td blockquote".split())
GOOD = regex.compile(r"(?:^|[\s_-])(?:article|content|post|entry|main|story|text|body|page)(?=$|[\s_-]|\d)", regex.I)
BAD = regex.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|footer|sidebar|side|aside|widget|cookie\w*|consent|notice|popup|modal|overlay|comment\w*|disqus|respond|reply|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|toolbar|masthead|skip|legal|copyright|disclaimer|tag-?list|pagination|pager)(?=$|[\s_-]|\d)", regex.I)
#: Class words that tell of a part elsewhere, and heads of the article: they make no element BAD.
TELLS = regex.compile(r"(?<!\S)(?:(?:\S*[_-])?(?:has|with|no)[_-]\S*|\S*[_-]open|(?:article|content|post|entry|story)[_-]header)(?!\S)", regex.I)
DISCUSSION = regex.compile(r"(?:^|[\s_-])(?:comment\w*|disqus|respond|reply)(?=$|[\s_-]|\d)", regex.I)
TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", regex.S)
ATTRIBUTE = regex.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.I)
#: A page keeps its host's path only if that holds this share of the text of its own best container.
SHARE = 0.5
#: Elements that are nested deeper count as part of the one at this depth, as in browsers; they are skipped all the same.
MAX_DEPTH = 256
#: Winners (a host and a path, under 1 KB each) that may be broadcast.
BROADCAST_HOSTS = 20_000


class Page:
    """Blocks of one page: (text, words less twice those in links, path of container numbers), and its containers:
    (path, bonus, level). Content in skipped elements is never collected; where one skipped by its
    class or id holds most of the page, the page is parsed once more without skipping it."""

    def __init__(self, html: str, spared: frozenset[int] = frozenset()) -> None:
        self.blocks: list[tuple[str, int, tuple[int, ...]]] = []
        self.containers: list[tuple[str, float, int]] = []
        self.text: list[str] = []
        self.linked = self.links = 0
        self.deeper: Counter[str] = Counter()
        self.stack: list[tuple[str, str, int, bool, tuple[int, ...]]] = []  # name, path, container or -1, skipped by name, numbers of those skipped by class or id
        self.buried: list[tuple[str, int, bool, int]] = []  # skipped below MAX_DEPTH: name, open ones of the name, skipped by name, number
        self.spared, self.named, self.held, self.unlinked = spared, [], Counter(), 0
        self._open("", "", False)
        at, end = 0, len(html)
        while at < end:
            less = html.find("<", at)
            if less < 0:
                self._data(html[at:])
                break
            found = TOKEN.match(html, less)
            if found is None:
                self._data(html[at : less + 1])
                at = less + 1
                continue
            if less > at:
                self._data(html[at:less])
            at = found.end()
            name = (found["name"] or "").lower()
            if not name:
                continue
            if found["close"]:
                self._end(name)
                continue
            closed = found["rest"].endswith("/")
            self._start(name, found["rest"])
            if name in RAW and not closed:
                stop = regex.compile(rf"</{name}(?=[\s/>]|\Z)", regex.I).search(html, at)
                if name not in SKIP:
                    self._data(html[at : stop.start() if stop else end])
                at = stop.start() if stop else end
        self._flush()
        if self.held and not spared and not any(self.containers[c][1] > 0 for _, _, path in self.blocks for c in path):
            total = self.unlinked + self.held[-1]
            large = [k for k, n in self.held.items() if k >= 0 and 2 * n > total and (n == total or not self.named[k])]
            if large:
                self.__init__(html, frozenset(large))

    def _open(self, name: str, label: str, skip: bool, bonus: float = 0.0, number_of: int = -1) -> None:
        top = self.stack[-1] if self.stack else ("", "", -1, False, ())
        path = f"{top[1]}/{label}" if label else ""
        number = -1
        if not name or name in CONTAINERS:
            number = len(self.containers)
            self.containers.append((path, bonus, len(self.stack)))
        self.stack.append((name, path, number, skip or top[3], top[4] if number_of < 0 else (*top[4], number_of)))
        self.links += name == "a"

    def _start(self, name: str, rest: str) -> None:
        if name in BLOCKS:
            self._flush()
        if name in ENDS_P:
            self._implied({"p"}, CONTAINERS | {"li", "table", "td"})
        if name in ENDS:
            self._implied(*ENDS[name])
        if name in VOID:
            return
        deep = len(self.stack) >= MAX_DEPTH
        self.deeper[name] += deep
        marks = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if "=" in rest else {}
        if not marks:
            if deep:
                self._bury(name, name in SKIP)
            else:
                self._open(name, name, name in SKIP, 2.0 if name in {"article", "main"} else 0.0)
            return
        words = f"{marks.get('class', '')} {marks.get('id', '')}".strip()
        good, bad = bool(GOOD.search(words)), bool(BAD.search(words)) and bool(BAD.search(TELLS.sub(" ", words)))
        skip = name in SKIP or marks.get("role", "").lower() in {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}
        number = -1
        if bad and not skip and name not in {"html", "body", "article", "main"}:
            number = len(self.named)
            self.named.append(bool(DISCUSSION.search(words)))
            number = -1 if number in self.spared else number
        if deep:
            self._bury(name, skip, number)
            return
        bonus = (2.0 if name in {"article", "main"} else 1.0 if good else 0.0) - (1.0 if bad else 0.0)
        label = name + "".join(f".{regex.sub(r'[0-9]+', '#', c)}" for c in sorted({*marks.get("class", "").split()}))
        self._open(name, label, skip, bonus, number)

    def _bury(self, name: str, skip: bool, number: int = -1) -> None:
        if skip or number >= 0:
            self.buried.append((name, self.deeper[name], skip, number))

    def _implied(self, names: set, stops) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                self._flush()
                self._close(i)
                if names != {"p"} and "td" in names and len(names) > 2:
                    continue  # a row ends its cell, then itself
                return
            if self.stack[i][0] in stops:
                return

    def _close(self, i: int) -> None:
        """Ends the elements from place i of the stack on."""
        self.links -= sum(s[0] == "a" for s in self.stack[i:])
        self.buried.clear()
        del self.stack[i:]

    def _end(self, name: str) -> None:
        if self.deeper[name]:
            if name in BLOCKS:
                self._flush()
            for i, (n, count, _, _) in enumerate(self.buried):
                if n == name and count == self.deeper[name]:
                    del self.buried[i:]
                    break
            self.deeper[name] -= 1
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                if any(s[0] in BLOCKS for s in self.stack[i:]):
                    self._flush()
                self._close(i)
                return
        if name in BLOCKS:
            self._flush()

    def _data(self, raw: str) -> None:
        top = self.stack[-1]
        if top[3] or any(x[2] for x in self.buried):
            return
        if numbers := (*top[4], *(x[3] for x in self.buried)):
            if not self.links:
                n = len(raw.split())
                self.held.update(dict.fromkeys((-1, *numbers), n))
            return
        text = entities.unescape(raw)
        if self.links:
            self.linked += len(text.split())
        self.text.append(text)

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.unlinked += text.count(" ") + 1 - self.linked
            self.blocks.append((text, text.count(" ") + 1 - 2 * self.linked, tuple(s[2] for s in self.stack if s[2] >= 0)))
        self.text, self.linked = [], 0

    def scores(self) -> list[float]:
        """Of each container: words outside links less words in links, times the bonus."""
        words = [0.0] * len(self.containers)
        for _, n, path in self.blocks:
            for c in path:
                words[c] += n
        return words

    def best(self) -> int | None:
        """The container of the article: most words and bonus; of equals the innermost."""
        if not self.blocks:
            return None
        words = self.scores()
        return max(range(len(words)), key=lambda c: (words[c] * (1 + 0.25 * self.containers[c][1]), self.containers[c][2]))

    def joined(self, chosen: set[int]) -> str:
        return "\n".join(text for text, _, path in self.blocks if not chosen.isdisjoint(path))


def vote(html: str | None) -> str | None:
    """Path of the page's best container."""
    page = Page(html or "")
    best = page.best()
    return None if best is None else page.containers[best][0]


def extract(html: str | None, path: str | None) -> str:
    """The text below the containers at path, or below the page's own best."""
    page = Page(html or "")
    best = page.best()
    if best is None:
        return ""
    own = page.joined({best})
    if path is None or path == page.containers[best][0]:
        same = {c for c, x in enumerate(page.containers) if x[0] == page.containers[best][0]}
        return page.joined(same)
    agreed = page.joined({c for c, x in enumerate(page.containers) if x[0] == path})
    return agreed if len(agreed) >= SHARE * len(own) else own


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 1):
        found = [vote(h) for h in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(found, pa.string())], ["host", "path"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 2):
        texts = [extract(h, p) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), b.column(3)], ["page_id", "url", "text", "n_chars", "host_path"])


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars, host_path (the host's winner).

    Null and empty html give empty text. Pages without host vote together as one host. Of paths
    with equal votes the deeper, then the first by code point wins. Rows that repeat a page vote
    again; other columns are ignored; an empty table gives an empty result.
    """
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_parts(F.col(url_col))[0].alias("host"))
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string").where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(-F.col("n"), -F.length(F.regexp_replace("path", "[^/]", "")), F.col("path"))
    winners = shared_table(votes.groupBy("host").agg(F.min_by("path", order).alias("host_path")), "winners")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    chosen = pages.join(winners, "host", "left").select("page_id", "url", "html", "host_path")
    kind = dict(pages.dtypes)
    return chosen.mapInArrow(_texts, f"page_id {kind['page_id']}, url string, text string, n_chars long, host_path string")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages"))
