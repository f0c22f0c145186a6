"""Main text of HTML pages by a vote of each host's pages on where it stands.

A page is read once: its shown blocks with the path of their container, and every container's score.
A path is made of tags and classes, numbers generalised, so that pages of one template share it. The
pages of a host vote on paths with their containers' scores; then each page's text is taken again from
its blocks, by the first of its host's winning paths that it has, or by its own best container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import lean, slices, whole_texts
from tremolo.llm.warc import _Page
from tremolo.session import Stage

# Elements and names by what they hold.
#: Not shown, or no part of an article.
NOT_TEXT = set("head title script style noscript template svg math iframe object canvas audio video map nav aside footer form button select textarea menu dialog datalist".split())
#: Within a line of text; every other element begins and ends a block.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rb rp rt ruby s samp small source span strike strong sub sup time tt u var wbr br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that hold text themselves; other blocks can be an article's container.
LEAVES = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr th caption pre blockquote figure figcaption address details summary fieldset legend hgroup center hr".split())
#: What an element that begins closes, if it is open nearer than the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Words of a class, id or role that name what isn't the article.
OTHERS = set(
    "ad ads advert adverts advertisement advertisements advertising adslot adsbygoogle sponsor sponsored sponsors promo promos promotion banner sidebar sidebars side rail widget widgets "
    "menu menus menubar nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead footer contentinfo complementary skip cookie cookies consent gdpr notice notices notification "
    "notifications alert alerts alertdialog announcement popup modal overlay dialog subscribe subscription newsletter signup signin login register share sharing social related recommended "
    "recommendations trending comment comments commentlist disqus reply replies respond pager pagination paging search searchbox searchform form copyright".split()
)
#: Words that name the article.
ARTICLE = set("article post entry story content main text body".split())
#: A word after one of these says how the element is laid out, not what it is.
LAYOUT = {"with", "has", "no", "without", "is", "not"}
#: How much a container's own tag or name counts.
NAMED, ELEMENT, PAGE = 1.3, 1.6, 0.7
#: Containers below this share of their page's best don't stand for election.
STANDS = 0.05
#: A path wins if it has this share of the votes that all of its host's pages could give.
WINS = 0.05
#: Winners of all hosts are broadcast up to so many bytes; beyond that hosts are salted by this.
BROADCAST_BYTES, SALT = 64 << 20, 16

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Numbers in class names: a single digit mostly tells columns apart, longer ones are identifiers.
_DIGITS = re.compile(r"\d{2,}")
#: A tag that the page's end cuts off.
_CUT_OFF = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
PARSED = "page_id long, url string, own string, candidates array<struct<path:string,score:bigint>>, blocks array<struct<path:string,text:string>>"
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("own", pa.string()),
    ("candidates", pa.list_(pa.struct([("path", pa.string()), ("score", pa.int64())]))),
    ("blocks", pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))),
])


def words(value: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(value)]


class _Element:
    """An open element: its tag, whether its text counts, and its container (itself, if it can be one)."""

    __slots__ = ("tag", "shown", "inside", "container")

    def __init__(self, tag: str, shown: bool, inside: bool, container: int):
        self.tag, self.shown, self.inside, self.container = tag, shown, inside, container


class _Blocks(HTMLParser):
    """Blocks of a page's shown text with their containers. Containers: [parent, path, weight, prose, all text]."""

    parse_marked_section = _Page.parse_marked_section

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.containers: list[list] = [[-1, "/", PAGE, 0, 0]]
        self.open = [_Element("", True, False, 0)]
        self.blocks: list[tuple[int, str]] = []
        self.line: list[str] = []
        self.linked = self.links = 0

    def flush(self) -> None:
        """Ends the block at hand."""
        if self.line:
            text = " ".join("".join(self.line).split())
            if text:
                at = self.open[-1].container
                self.blocks.append((at, text))
                self.containers[at][3] += 0 if 2 * self.linked > len(text) else len(text) - self.linked
                self.containers[at][4] += len(text)
            self.line.clear()
        self.linked = 0

    def close_to(self, tags: set[str], within: set[str] = frozenset()) -> None:
        """Closes the nearest open element of ``tags``, and all in it, unless one of ``within`` stands nearer."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self.flush()
                del self.open[k:]
                return
            if self.open[k].tag in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.line.append(" ")
        if tag == "a":
            self.links = 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in ("html", "body"):
            if tag == "body":
                self.close_to({"head"})
            return
        a = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop", "hidden", "style")}
        named = words(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}") if a else []
        other = any(w in OTHERS and (k == 0 or named[k - 1] not in LAYOUT) for k, w in enumerate(named))
        article = any(w in ARTICLE for w in named)
        parent = self.open[-1]
        if tag in ("article", "main"):
            other &= not article
        if tag == "header" or "header" in named:
            other |= not (parent.inside or (article and tag != "header"))
        shown = parent.shown and not (tag in NOT_TEXT or other or "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", "")) is not None)
        if tag in INLINE:
            if not shown and parent.shown:  # the rest of the block goes on after it
                self.open.append(_Element(tag, False, parent.inside, parent.container))
            return
        self.flush()
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        elif tag not in NOT_TEXT or tag in ("nav", "aside", "footer", "form", "menu", "dialog"):
            self.close_to({"p"}, {"td", "th", "button", "table"})
        parent = self.open[-1]
        at = parent.container
        if shown and parent.shown and tag not in LEAVES:
            classes = sorted({_DIGITS.sub("#", c) for c in a.get("class", "").split()})
            path = self.containers[at][1] + ".".join([tag, *classes]).replace("/", "") + "/"
            is_body = a.get("itemprop") == "articleBody"
            weight = ELEMENT if tag == "article" or is_body else NAMED if tag == "main" or article else 1.0
            self.containers.append([at, path, weight, 0, 0])
            at = len(self.containers) - 1
        inside = parent.inside or tag in ("article", "main") or (article and not other)
        self.open.append(_Element(tag, shown and parent.shown, inside, at))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML knows no empty form of other elements than the void ones

    def handle_endtag(self, tag):
        if tag == "a":
            self.links = 0
        if tag in ("p", "br") and not any(e.tag == tag for e in self.open):
            self.flush() if tag == "p" else self.line.append(" ")
        elif tag in INLINE:
            if self.open[-1].tag == tag:
                self.open.pop()
        elif tag not in VOID:
            self.close_to({tag})

    def handle_data(self, data):
        if self.open[-1].shown:
            self.line.append(data)
            if self.links:
                self.linked += len(data)
        else:
            self.containers[self.open[-1].container][4] += len(data)


def read_blocks(source: str) -> tuple[str | None, list[tuple[str, int]], list[tuple[str, str]]]:
    """(own best path, (path, score) of the containers that stand, (path, text) of the blocks) of a page.

    A container's score is the prose in it, less links, times what its name counts and the root of
    prose's share of all text in it; in thousandths of the page's best. Malformed markup is read as far as it goes.
    """
    page = _Blocks()
    page.feed(_CUT_OFF.sub("", source))
    page.close()
    page.flush()
    for parent, _, _, prose, whole in page.containers[:0:-1]:  # children stand after their parents
        page.containers[parent][3] += prose
        page.containers[parent][4] += whole
    scores = [weight * prose * (prose / whole) ** 0.5 if prose else 0.0 for _, _, weight, prose, whole in page.containers]
    best = max(range(len(scores)), key=lambda k: (scores[k], k))
    if not scores[best]:
        return None, [], [(page.containers[at][1], text) for at, text in page.blocks]
    stand: dict[str, int] = {}
    for (_, path, *_), score in zip(page.containers, scores):
        if score >= STANDS * scores[best]:
            stand[path] = max(stand.get(path, 0), round(1000 * score / scores[best]))
    return page.containers[best][1], list(stand.items()), [(page.containers[at][1], text) for at, text in page.blocks]


def parse(pages: DataFrame) -> DataFrame:
    """PARSED: a row for each page, with its own best path, candidates and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                rows = []
                for page_id, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                    own, stand, blocks = read_blocks(source or "")
                    rows.append({"page_id": page_id, "url": url, "own": own, "candidates": [dict(path=p, score=s) for p, s in stand], "blocks": [dict(path=p, text=t) for p, t in blocks]})
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return whole_texts(pages.select("page_id", "url", "html")).mapInArrow(lean(run), PARSED)


def host(url: Column) -> Column:
    """The lower-case host of an address; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def elect(parsed: DataFrame) -> DataFrame:
    """(host, paths): each host's winning paths, most votes first, ties by path. Pages without a host hold no vote.

    Votes are summed by host and path before they are shuffled. A host has at most 1/WINS winners for each
    path that a page has on average.
    """
    known = parsed.where(F.col("host") != "").select("host", "candidates")
    votes = known.select("host", F.explode("candidates").alias("c")).groupBy("host", "c.path").agg(F.sum("c.score").alias("votes"))
    pages = known.where(F.size("candidates") > 0).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    won = votes.join(pages, "host").where(F.col("votes") >= WINS * 1000 * F.col("pages"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path")))
    return won.groupBy("host").agg(ranked["path"].alias("paths"))


def _with_winners(parsed: DataFrame, winners: DataFrame) -> DataFrame:
    """Adds each page's host's paths: by broadcast if their counted bytes are few, else by salted hosts, as one may hold most pages."""
    size = winners.agg(F.sum(F.length(F.concat_ws("", "paths")) + F.length("host") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return parsed.join(F.broadcast(winners), "host", "left")
    salted = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return parsed.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


def main_text(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, host, path, by_host, text.

    ``path`` is the winning path that the text was taken by (null if the page has no prose), ``by_host`` tells whether
    its host's vote named it; ``text`` has the blocks below it in page order, one a line, white space folded.
    Null and empty pages have empty texts, as have pages that hold nothing but menus and the like; pages with a
    null url, or one without a host, go by their own best container; repeated rows each get a row and a vote;
    ties go to the path that sorts first; pages of any length are read whole; an empty table gives no rows; only the three columns
    are read, so others can't clash. Elements that aren't shown, and those that are named as no part of an
    article, are left out wherever they stand, a header only outside the article; a line break is white space;
    each cell of a table is a block.
    """
    stage = Stage(pages.sparkSession, "extract")
    parsed = stage.write(parse(pages).withColumn("host", host(F.col("url"))))
    winners = stage.write(elect(parsed))
    mine = _with_winners(parsed, winners)
    stands = F.transform("candidates", lambda c: c["path"])
    voted = F.get(F.filter("paths", lambda p: F.array_contains(stands, p)), F.lit(0))
    chosen = mine.withColumn("path", F.coalesce(voted, "own")).withColumn("by_host", voted.isNotNull())
    inside = F.filter("blocks", lambda b: b["path"].startswith(F.col("path")))
    text = F.when(F.col("path").isNull(), "").otherwise(F.array_join(F.transform(inside, lambda b: b["text"]), "\n"))
    return chosen.select("page_id", "url", "host", "path", "by_host", text.alias("text"))
