"""HTML extraction against planted articles in templates of many kinds, and a plain reading of the given pages."""

import html
import random
import re

from tremolo.llm import extract
from tremolo.llm.queries import op13_extract

SF = "/root/testdata/sf0.001"


def test_given_pages_by_their_template(spark):
    """The given pages hold one article element, with paragraphs that aren't always closed."""
    rows = {r.page_id: r for r in op13_extract(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        want = "\n".join(filter(None, blocks))
        assert (rows[p.page_id].text, rows[p.page_id].url, rows[p.page_id].n_chars) == (want, p.url, len(want))


WORDS = "the river carries small boats past old houses where people talk about weather and bread".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(rng, kind, k):
    """(html, main text) of a template; its other parts are prose as well."""
    title, paras = prose(rng, 5), [prose(rng, rng.randrange(15, 60)) for _ in range(rng.randrange(3, 9))]
    want = "\n".join([title, *paras])
    p = "".join(f"<p>{x}</p>" for x in paras)
    nav = "<nav><ul>" + "".join(f"<li><a href='/{x}'>{x}</a>" for x in WORDS[:6]) + "</ul></nav>"
    comment = f"<section class='comments'><h2>Comments</h2>{''.join(f'<article><p>{prose(rng, 90)}</p></article>' for _ in range(6))}</section>"
    if kind == 0:
        return f"<html><head><title>x</title></head><body>{nav}<main><article><h1>{title}</h1>{p}<footer>{prose(rng, 9)}</footer></article>{comment}</main></body></html>", want
    if kind == 1:
        return f"<body><div id='cookie-notice'>{prose(rng, 40)}</div><div class=wrap>{nav}<div class='post-{k} story'><h1>{title}</h1>{p}</div><aside><p>{prose(rng, 60)}</p></aside></div><form><p>{prose(rng, 30)}</p></form>", want
    if kind == 2:  # no name tells the column beside the text, nor where the text is
        return f"<div class=a1><div class=b7><h1>{title}</h1>{p}</div><div class=b9><p>{' '.join(f'<a href=#>{w}</a>' for w in WORDS)}</div></div>", want
    return f"<header><p>{prose(rng, 20)}</p></header><div class='entry-content'><header><h1>{title}</h1></header>{p}<div class='ad-slot'>{prose(rng, 30)}</div></div><div class=sidebar>{prose(rng, 80)}</div>", want


def test_templates_of_hosts(spark):
    rng = random.Random(3)
    made = [(k, f"https://h{k % 4}.example:80/p/{k}?q#f", *page(rng, k % 4, k)) for k in range(120)]
    df = spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string").selectExpr("*", "'t' as text", "1 as host", "2 as path")
    got = {r.page_id: r for r in extract.main_text(df).collect()}
    for k, _, _, want in made:
        assert got[k].text == want, (k % 4, got[k])
        assert got[k].by_host and got[k].host == f"h{k % 4}.example"


def test_the_vote_overrules_a_page(spark):
    """A short article under long unnamed remarks: alone the remarks win, the other pages of the host name the article's place."""
    rng = random.Random(4)
    row = lambda n, m: f"<div class=x1><h1>T</h1><p>{prose(rng, n)}</p></div><div class=x2><p>{prose(rng, m)}</p></div>"
    pages = [(k, "http://one.example/a", row(200, 20)) for k in range(9)] + [(9, "http://one.example/b", row(30, 200)), (10, None, row(30, 200)), (11, "no address", row(200, 30))]
    got = {r.page_id: r for r in extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k].path == "/div.x1/" for k in range(10)) and got[9].text.startswith("T\n") and got[9].by_host
    assert got[10].path == "/div.x2/" and not got[10].by_host and got[11].path == "/div.x1/"


def test_markup_of_all_kinds(spark):
    cases = [
        (None, ""), ("", ""), ("just text", "just text"), ("<nav>menu</nav><footer>f</footer>", ""), ("<article></article>", ""),
        ("<article><p>a&nbsp;&amp; b &lt;c&gt; &copy &#8364; &#x41; &bogus; &am</p></article>", "a & b <c> © € A &bogus; &am"),
        ("<article><p>one<p>two<b>three</b> f<i>o</i>ur<br>five\n\t six<ul><li>x<li>y <ul><li>z</ul></ul><table><tr><td>p<td>q<tr><td>r</table>tail", "one\ntwothree four five six\nx\ny\nz\np\nq\nr\ntail"),
        ("<article><script>var a='</p><p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><![CDATA[no]]><![if x]><p>and</p></article>", "yes\nand"),
        ("<article><p>text <span class=ad>buy</span>goes <button>press</button> on</p><p hidden>no</p><p style='display: none'>no</p></article>", "text goes\non"),
        ("<ARTICLE><P>Upper</P></DIV></SECTION><P>case", "Upper\ncase"), ("<p>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<div>" * 3000 + "<p>deep", "deep"),
        ("<article class='post no-sidebar'><p>kept words</p></article><article class=comment><p>gone</p></article>", "kept words"),
        ("<main><h1>Head</h1><blockquote><p>said</p></blockquote><pre> a  b </pre><figure><img src=x><figcaption>seen</figcaption></figure></main>", "Head\nsaid\na b\nseen"),
        ("<article><p>" + "w " * 60000 + "</p></article>", ("w " * 60000).strip()), ("<p>a<", "a<"), ("<article>x<p", "x"), ("<head><title>t</title><body><p>b", "b"),
    ]
    rows = [(k, f"http://c{k}.example/", h) for k, (h, _) in enumerate(cases)] + [(None, None, None), (2, "http://c2.example/", "just text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract.main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == ("" if r.page_id is None else cases[r.page_id][1]), (r.page_id, r.text[:200])
    assert extract.main_text(df.limit(0)).count() == 0


def test_hosts_beyond_a_broadcast(spark, monkeypatch):
    pages = [(k, f"http://s{k % 3}.example/{k}", f"<div class=m><p>some words of page {k}</p></div>") for k in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = sorted(map(tuple, extract.main_text(df).collect()))
    monkeypatch.setattr(extract, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, extract.main_text(df).collect())) == want
