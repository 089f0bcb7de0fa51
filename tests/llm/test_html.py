import pytest
from pyspark.sql import functions as F

from lumenframe.llm import html_text

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two <b>bold</b>er<br>line<p>  </p>", "one\ntwo bolder line"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><article><h1>Head&nbsp;line</h1><p>Text <!-- x --> more</p></article><footer>f</footer></body></html>", "Head line\nText more"),
    ('<body><div class="sidebar">s</div><main><p>kept</p><form><input>q</form><div id="comments"><p>no</p></div></main></body>', "kept"),
    ('<article><script>var a = "</p>";</script><ul><li>a<li>b</ul><div class="ad">x</div><table><tr><td>1<td>2</table></article>', "a\nb\n1\n2"),
    ("<article><header><h1>T</h1></header><p>x<aside>y</aside>z</p></article>", "T\nx\nz"),
    ("<article><p>a <![if x]> b &copy; &#8364; &unknown;</p></article>", "a b © € &unknown;"),
    ('<article><p style="display: none">gone</p><p hidden>gone</p><blockquote>q</blockquote>tail', "q\ntail"),
    ("<p>" * 3000 + "deep" + "<div>" * 3000 + "er", "deep\ner"),
    ("<header>h</header><div>x</div><div class='cookie-notice'>c</div>", "x"),
    ("<article>teaser</article><main><p>body of the page</p></main>", "body of the page"),
    ('<div><p>main text</p><article class="comment-card">c</article></div>', "main text"),
    ('<article><p>t</p><table class="share-price-table"><tr><td>9</table><div id="related-work">r</div><div class="post-login-guide">g</div></article>', "t\n9\nr\ng"),
    ('<article><p>a <object>o</object> <math>m</math> b</p><div class="shareButtons">s</div><ul class="related-posts list-2"><li>r</ul></article>', "a o m b"),
    ("<main><p>a long text that is the page's own and no article</p><article>x</article></main>", "a long text that is the page's own and no article\nx"),
    ("<main><h1>Head</h1><article><p>the whole article</p></article></main>", "the whole article"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_text_of_a_page(html, text):
    assert html_text.text_of(html) == text


def page(host, n, body):
    return (n, f"https://{host}/p/{n}", f"<article><h1>Title {n}</h1>{body}<div>Follow us on all channels</div></article>", "extra", 1)


def test_site_templates_go_and_shared_articles_stay(spark):
    rows = [page("A.example", n, f"<p>own text {n}</p>") for n in range(12)]
    rows += [(100 + n, f"http://b.example/{n}", "<article><p>one article in many copies</p><p>end</p></article>", "extra", 1) for n in range(20)]
    rows += [(200, None, "<p>x</p>", "extra", 1), (None, "not a url", None, "extra", 1), (201, "http://a.example/z", "", "extra", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, templates int")
    found = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert len(found) == len(rows)
    assert all(found[n] == f"Title {n}\nown text {n}" for n in range(12))
    assert all(found[100 + n] == "one article in many copies\nend" for n in range(20))
    assert found[200] == "x" and found[None] == "" and found[201] == ""
    assert html_text.main_text(pages.limit(0)).count() == 0


def slow_main_text(rows, least=4, share=0.01, least_inside=8, share_inside=0.5):
    """Brute force: subtrees as strings, hosts as dictionaries."""
    from collections import defaultdict

    def trees(node, inside, out):
        parts, holds = [], node.tag in ("html", "body", "article", "main")
        for c in node.children:
            if isinstance(c, str):
                parts.append(" ".join(c.split()))
            else:
                shape, held = trees(c, inside or node.tag in ("article", "main"), out)
                parts.append("{" + shape + "}")
                holds = holds or held
        shape = node.tag + "|" + "|".join(p for p in parts if p)
        if node.children and node.tag in html_text.BLOCKS and not holds:
            out.append((node, shape, inside))
        return shape, holds

    seen, contents = defaultdict(set), defaultdict(set)
    for host, html in rows:
        root, out = html_text.parse(html), []
        trees(root, False, out)
        text = html_text.text_of(html)
        contents[host].add(text)
        for _, shape, inside in out:
            seen[host, shape, inside].add(text)
    done = []
    for host, html in rows:
        root, out, n = html_text.parse(html), [], len(contents[host])
        trees(root, False, out)
        gone = set()
        for node, shape, inside in out:
            many = len(seen[host, shape, inside])
            if many >= (least_inside if inside else least) and many >= n * (share_inside if inside else share):
                gone.add(id(node))
        stack = [root]
        while stack:
            node = stack.pop()
            node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]
            stack.extend(c for c in node.children if not isinstance(c, str))
        done.append("\n".join(html_text.blocks(html_text.cleaned(root))))
    return done


def test_whole_pages_match_brute_force(spark):
    """A host of sections without telling names: its menus, notices and section boxes go by counts alone."""
    import random

    rng = random.Random(4)
    menu = {s: f"<div class='x{s}'><ul>" + "".join(f"<li><a>{s} link {i}</a>" for i in range(4)) + "</ul></div>" for s in "abc"}
    rows = []
    for n in range(90):
        s = "abc"[n % 3]
        body = "".join(f"<p>{' '.join(rng.choice('one two three four five'.split()) for _ in range(9))} {n}</p>" for _ in range(3))
        if n % 9 == 0:
            body += "<p>a passage that several articles quote</p>"
        shell = "<article>{}</article>" if n % 2 else "<section>{}</section>"
        rows.append(("h.example" if n < 80 else "small.example", f"<body>{menu[s]}<div>We use small files to serve you</div>{shell.format(body)}<div>All rights kept {s}</div></body>"))
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", t) for i, (h, t) in enumerate(rows)], "page_id bigint, url string, html string")
    found = [r.text for r in html_text.main_text(pages).orderBy("page_id").collect()]
    assert found == slow_main_text(rows)
    assert not any("link" in t or "rights" in t or "files" in t for t in found[:80])
    assert any("link" in t for t in found[80:])  # too few pages to count: nothing names its menu
    assert sum("several articles quote" in t for t in found[:80:2]) == 0 and all("quote" in found[n] for n in range(9, 80, 18))


def test_hosts(spark):
    urls = ["HTTP://User@Host.org:80/a?b", "ftp://x", "nothing", None, "https://h?q"]
    found = [r.h for r in spark.createDataFrame([(u,) for u in urls], "url string").select(html_text.host_of(F.col("url")).alias("h")).collect()]
    assert found == ["host.org:80", "x", "", "", "h"]
