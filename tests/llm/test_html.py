import random
import time

from cairn.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a><li>B</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; tail</h1></header><p>One <b>bold</b>
 text&nbsp;x<br>next<p class="lead">Two &lt;b&gt; <!-- no --> &#233;<div class="ad">Buy</div><ul><li>first<li>second</ul>
<form><p>mail</p><input></form><aside>side</aside><section id="comments"><p>nice</p></section><p hidden>h</p></article>
<div class="sidebar">s</div><footer>&copy; x</footer></body></html>"""


def test_content_of_a_page():
    assert html.Page(PAGE).text() == "Head & tail\n\nOne bold text x next\n\nTwo <b> é\n\nfirst\n\nsecond"


def test_odd_pages():
    text = lambda s: html.Page(s).text()
    assert text("") == "" and text("plain  text") == "plain text" and text("<p>a<p>b") == "a\n\nb"
    assert text("<p>a<!-- open") == "a" and text("<script>x") == "" and text("a < b <c") == "a < b <c"
    assert text('<p title="a>b">x</p>') == "x"
    assert text("<div>" * 3000 + "deep" + "</div>" * 10) == "deep"
    assert text("<main><p>m</p></main><p>o</p>") == "m"
    assert text("<p>" + "long " * 50_000 + "</p>") == " ".join(["long"] * 50_000)


def test_templates(spark):
    rows = []
    for k in range(12):
        rows.append((k, f"http://Big.example/{k}", f"<body><div class=top>Welcome to us</div><div><p>story {k} here</p><p>shared words</p></div><div>Call now</div></body>", "x"))
    rows += [(20, "http://small.example/1", "<div>Call now</div><p>text</p>", "x"), (21, None, None, "x"), (22, "odd", "", "x"), (0, rows[0][1], rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for bound in (10_000, 0):  # broadcast; salted join
        got = html.extract(pages, broadcast_rows=bound).select("page_id", "text", "host").collect()
        assert len(got) == len(rows)
        by = {r["page_id"]: r["text"] for r in got}
        assert all(by[k] == f"story {k} here\n\nshared words" for k in range(12))
        assert by[20] == "Call now\n\ntext" and by[21] == "" and by[22] == ""
    assert html.extract(pages.limit(0)).count() == 0


def test_articles_keep_their_blocks(spark):
    rows = [(k, "http://a.b/", f"<nav>n</nav><article><p>same</p><p>{k}</p></article>") for k in range(9)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"same\n\n{r['page_id']}" for r in got)


def test_templates_of_layouts(spark):
    """A hot host of several layouts: each block is on less than half of its pages."""
    notice, menu = "<div><div>Shop closed on Monday</div></div>", "<ul><li>Alpha<li>Beta</ul>"
    rows = []
    for k in range(90):
        top, end = (notice, menu) if k % 5 < 2 else ("<section>Archive</section>", "") if k % 5 == 2 else ("", "<table><tr><td>Old shop</table>")
        rows.append((k, "http://hot.example/", f"{top}<div><p>story {k}</p></div>{end}"))
    # The same text on many pages is no template, in an article or out of it.
    rows += [(100 + k, "http://hot.example/c", f"<div><div>copied</div></div><footer>{k}</footer>") for k in range(20)]
    rows += [(200 + k, "http://hot.example/a", f"<article><div><p>told twice</p></div><p>{k}</p></article>") for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (10_000, 0):
        by = {r["page_id"]: r["text"] for r in html.extract(pages, broadcast_rows=bound).collect()}
        assert all(by[k] == f"story {k}" for k in range(90))
        assert all(by[100 + k] == "copied" and by[200 + k] == f"told twice\n\n{k}" for k in range(20))


def test_repeated_rows_keep_their_text(spark):
    rows = [(k, "http://a.b/1", "<body><div><div>only text</div></div></body>") for k in range(6)]
    # The body of an article that six pages of a host share, and a block put into all articles of another.
    rows += [(10 + k, f"http://c.d/{k}", f"<article><div><div>body of it all</div></div><p>{k}</p></article>") for k in range(6)]
    rows += [(20 + k, f"http://e.f/{k}", f"<article><p>long story number {k}</p><div><div>Join us</div></div></article>") for k in range(6)]
    by = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[k] == "only text" and by[10 + k] == f"body of it all\n\n{k}" and by[20 + k] == f"long story number {k}" for k in range(6))


def test_hostile_pages_take_linear_time():
    n = 150_000
    for source in ("<div>" * n + "</x>" * n, "<a " * n, "<p><td>" + "<span>" * n + "<div></div>" * n, "<a " + "id=" * n + ">x", "<li><b>" * n, "<!" * n, "<a '" * n + ">", "&amp" * n, "<p>" * n):
        began = time.process_time()
        html.Page(source).text()
        assert time.process_time() - began < 20, source[:20]


def test_against_known_blocks():
    """Pages written from known blocks: their text is the blocks."""
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    for _ in range(200):
        blocks = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(rng.randint(0, 6))]
        body = ""
        for b in blocks:
            inside = "".join(f"<{t}>{w}</{t}>" if (t := rng.choice(["", "", "b", "a", "em"])) else w for w in re_split(b))
            body += rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<ul><li>{}</ul>", "<blockquote><p> {} </p></blockquote>", "<h2>{}</h2>\n"]).format(inside)
            body += rng.choice(["", "<script>var x = '<p>';</script>", "<!-- <p>no</p> -->", "<nav>menu</nav>", "<div class='ad'>buy</div>", "<form>mail</form>"])
        around = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", "<div><article>{}</article></div>"]).format(body)
        page = f"<html><head><title>t</title></head><body><header>site</header>{around}<footer>f</footer></body></html>"
        if blocks:
            assert html.Page(page).text() == "\n\n".join(blocks), page


def re_split(block):
    """Words and the blanks between them."""
    out = []
    for w in block.split(" "):
        out += [w, " "]
    return out[:-1]


def test_shared_headings_and_cells_stay(spark):
    """Text that many pages of a host share is no template by itself, whatever the pages are built of."""
    rows = []
    for k in range(100):
        shared = k % 10 < 3
        part = f"<h2>Introduction</h2><p>story {k}</p><table><tr><td>Price</td><td>{k}</td></tr></table><div><div>Colour</div><div>c{k}</div></div>" if shared else f"<p>story {k}</p>"
        rows += [(k, "http://main.example/", f"<main>{part}</main>"), (1000 + k, "http://plain.example/", f"<div>{part}</div><div>end {k}</div>"), (2000 + k, "http://all.example/", f"<div><h2>Introduction</h2><p>story {k}</p><div><div>Price</div><div>{k}</div></div></div><div>e{k}</div>")]
    rows += [(3000 + k, "http://wrapped.example/", f"<div id=page><div>Shop closed</div><div><p>story {k}</p></div></div>") for k in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (10_000, 0):
        by = {r["page_id"]: r["text"] for r in html.extract(pages, broadcast_rows=bound).collect()}
        for k in range(100):
            part = f"Introduction\n\nstory {k}\n\nPrice\n\n{k}\n\nColour\n\nc{k}" if k % 10 < 3 else f"story {k}"
            assert by[k] == part and by[1000 + k] == f"{part}\n\nend {k}" and by[2000 + k] == f"Introduction\n\nstory {k}\n\nPrice\n\n{k}\n\ne{k}"
        assert all(by[3000 + k] == f"story {k}" for k in range(10))


def test_ties_between_copies_in_main(spark):
    """Copies of one page are one page to the counts, in main too."""
    rows = [(k, f"http://m.n/{k}", "<main><div><div>told</div></div><p>twice</p></main>") for k in range(12)] + [(50, "http://m.n/x", "<main><p>other</p></main>")]
    by = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(by[k] == "told\n\ntwice" for k in range(12)) and by[50] == "other"
