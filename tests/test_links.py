import posixpath
import random
from urllib.parse import unquote, urljoin, urlsplit

from cairn.operators import links


def test_against_urljoin(spark):
    rng = random.Random(4)
    segments = ["a", "b", "..", ".", "%61", "c.html", "", "é", "x+y", "%E3%81%82"]
    pages = []
    for k in range(150):
        path = "/".join(rng.choices(["a", "b", "c.html", "d"], k=rng.randint(0, 3)))
        refs = {rng.choice(["", "/", "./"]) + "/".join(rng.choices(segments, k=rng.randint(1, 4))) + rng.choice(["", "?q=1", "#top"]) for _ in range(4)}
        pages.append((k, f"https://H{k % 3}.example/{path}{rng.choice(['', '?x', '#y'])}", "".join(f'<a href="{r}">' for r in refs) + "<a href='https://else/x'><img src=\"//other/y\"><a href='#z'><a href='mailto:x'><a href=''>"))
    pages += [(900, None, "<a href='x'>"), (901, "https://h0.example/p", None)]
    want = set()
    for k, url, html in pages:
        if not url or not html:
            continue
        base = urlsplit(url)
        for ref in {part.split('"')[0] for part in html.split('href="')[1:]}:
            path = urlsplit(ref).path if not ref.startswith("//") else ""
            if not path:
                continue
            raw = unquote(path if path.startswith("/") else base.path.rsplit("/", 1)[0] + "/" + path)
            depth, outside = 0, False
            for part in raw.split("/"):
                depth += 0 if part in ("", ".") else -1 if part == ".." else 1
                outside, depth = outside or depth < 0, max(depth, 0)
            clean = posixpath.normpath("/" + raw.lstrip("/")) if not outside else None
            if clean is not None and raw.rsplit("/", 1)[-1] in ("", ".", ".."):
                clean = clean.rstrip("/") + "/index.html"
            want.add((k, ref, clean, outside))
            if not outside and "%" not in ref and "//" not in ref and path.rsplit("/")[-1] not in ("", ".", ".."):
                assert urlsplit(urljoin(url, ref)).path == clean
    got = {(r["seq"], r["link"], None if r["outside"] else r["target"], r["outside"]) for r in links.link_graph(spark.createDataFrame(pages, "seq long, url string, html string")).collect() if r["seq"] < 900}
    assert got == want and len(want) > 300


def test_broken_links(spark):
    page = "<a href='two'><a href='/dir'><a href='/dir/'><a href='/dir/index.html'><a href='../../x'><a href='none#a'><img src='/i%20mg.png'><a href='%zz'>"
    pages = spark.createDataFrame([(1, "http://A.b/sub/one", page), (2, "http://a.b/sub/two?q", ""), (3, "http://a.b/dir/", None), (4, "http://c.d/none", "")], "seq long, url string, html string")
    there = spark.createDataFrame([("a.b", "/i mg.png")], "host string, path string")
    got = {(r["link"], r["problem"]) for r in links.broken_links(pages, there).collect()}
    assert got == {("../../x", "outside"), ("none#a", "missing"), ("%zz", "missing")}
    assert ("/i%20mg.png", "missing") in {(r["link"], r["problem"]) for r in links.broken_links(pages).collect()}
    assert links.broken_links(pages.limit(0)).count() == 0
