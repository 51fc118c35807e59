"""URL rules and templates, and main text of pages."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_extract, queries, url_filter
from quillspark.llm.common import table


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for what, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (what, h + p)
    return host, path, best


URLS = [
    (1, None), (2, "no scheme"), (3, "http://EXAMPLE.com/en/1"), (4, "https://www.example.com/en/2?x=/"), (5, "https://a.www.example.com/en/"), (6, "http://x.net/es/1"),
    (7, "http://net/fr/"), (8, "http://x.net?/es/"), (9, "http://x.org/fr/1#a"), (10, "http://notexample.com/en/1"), (11, "http://a.example.com"), (12, "://"), (13, "http://x.net/es"), (13, "http://x.net/es"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    labels = spark.createDataFrame([(3, 1), (9, None)], "doc_id long, quality int")
    got = url_filter.judge_urls(pages, labels).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, best = plain_rule(dict(URLS)[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert r.rule == (best[1] if best else None)
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.where("page_id < 0"), labels).count() == 0


def test_bad_template_is_rejected(spark):
    rows = [(i, f"https://h.org/{'junk' if i % 2 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(0, 400, 1) if i % 3], "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400))


def plain_tree(rows):
    """{(host, path): (template, bad share)} of rows (host, path, bad or None), by recursion over each host's paths."""
    import collections

    shapes = collections.defaultdict(lambda: [0, 0, 0])
    for host, path, bad in rows:
        c = shapes[host, path]
        c[0], c[1], c[2] = c[0] + 1, c[1] + (bad is not None), c[2] + (bad or 0)
    total = lambda cs: [sum(x) for x in zip(*cs, strict=True)]
    smooth = lambda k, n, up: (k + url_filter.PRIOR * up) / (n + url_filter.PRIOR)
    out = {}

    def split(path):
        s = path[1:].split("/")
        return (s if len(s) <= url_filter.DEPTH else [*s[: url_filter.DEPTH - 1], "/".join(s[url_filter.DEPTH - 1 :])]) + ["$"]

    def down(host, paths, d, name, share):
        level = collections.defaultdict(list)
        for p in paths:
            level[split(p)[d]].append(p)
        pages, n, k = total(shapes[host, p] for p in paths)
        branches = collections.defaultdict(list)
        for seg, own in level.items():
            a, b, c = total(shapes[host, p] for p in own)
            q = k / max(n, 1)
            error = (q * (1 - q) * (1 / max(b, 1) + 1 / max(n - b, 1))) ** 0.5
            apart = abs(c / max(b, 1) - (k - c) / max(n - b, 1))
            alone = a >= url_filter.FEW and a >= pages * url_filter.RARE and b > 0 and n - b > 0 and apart > url_filter.Z * error
            branches[seg if alone or len(level) == 1 or seg == "$" else "*"] += own
        for seg, own in branches.items():
            _, b, c = total(shapes[host, p] for p in own)
            at = smooth(c, b, share)
            if seg == "$":
                out.update({(host, p): (f"{name}/$", at) for p in own})
            else:
                down(host, own, d + 1, f"{name}/{seg}", at)

    _, n, k = total(shapes.values())
    for host in {h for h, _ in shapes}:
        own = [p for h, p in shapes if h == host]
        _, b, c = total(shapes[host, p] for p in own)
        down(host, own, 0, "", smooth(c, b, k / max(n, 1)))
    return out


def test_template_tree_against_recursion(spark):
    """The driver's pages, and invented ones with ids, bad branches, rare segments, deep paths and a hot host."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(1500):
        host = "hot.org" if i % 3 else f"h{i % 5}.org"
        section = rng.choice(["news", "junk", "shop", "a" * 300, f"rare{i}"])
        path = rng.choice([f"/{section}/{i}", f"/{section}/{i}/", f"/{section}/x/{i}.html", "/" + "/".join(f"d{j}" for j in range(rng.randint(1, 20))), "", "/"])
        bad = rng.choice([None, int(rng.random() < (0.95 if "junk" in path else 0.1))])
        rows.append((i, host, path, bad))
    pages = spark.createDataFrame([(i, f"https://{h}{p}") for i, h, p, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b) for i, _, _, b in rows if b is not None], "doc_id long, quality int")
    want = plain_tree([(h, p, b) for _, h, p, b in rows])
    got = url_filter.judge_urls(pages, labels, document=lambda p: F.col("id")).collect()
    assert len(got) == len(rows)
    for r in got:
        template, share = want[r.host, r.path]
        assert r.template == template and r.bad_share == pytest.approx(share) and r.verdict == ("block" if share >= url_filter.LIMIT else "allow")
    blocked = {r.page_id for r in got if r.verdict == "block"}
    assert blocked and all("/junk/" in p for i, _, p, _ in rows if i in blocked) and any("*" in r.template and "junk" in r.template for r in got)
    small = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, small, "labels").where("quality is not null").collect()}
    got = queries.op6_url_filter(spark, small).collect()
    number = lambda p: re.search(r"([0-9]+)[^0-9/]*/?$", p)
    mark = lambda p: (lambda m: None if m is None or int(m[1]) not in labels else int(labels[int(m[1])] == 0))(number(p))
    want = plain_tree([(r.host, r.path, mark(r.path)) for r in got])
    assert all((r.template, pytest.approx(r.bad_share)) == want[r.host, r.path] for r in got)


def test_url_query_rules_on_the_driver_tables(spark, small):
    urls = {r.page_id: r.url for r in table(spark, small, "pages").collect()}
    for r in queries.op6_url_filter(spark, small).collect():
        host, path, best = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best[1] if best else None)


PAGES = [
    ("<article><h1>T &amp; U</h1><p>a\n b<p>c <b>d<br>e</p></article><footer>f</footer>", "T & U\na b\nc d e"),
    ("<body><nav>n</nav><div class='ad'>x</div><p>one</p><div id=sidebar><p>s</p></div><form><p>q</p></form><p>two", "one\ntwo"),
    ("<main><p>m</p><section class='comments'><article class='comment'><p>c</p></article></section></main>", "m"),
    ("<article><p>a</p><aside>s</aside><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "a\nx\ny\n1\n2"),
    ("<script>var t='</p>';</script><style>p{}</style><p>k &lt;b&gt; &#233;</p><!-- <p>no</p> -->", "k <b> é"),
    ("<article><header><h1>H</h1><p>by me</p></header><p>x &nbsp;y</p></article>", "H\nx \xa0y"),
    ("<article><p>cut off <b>here</b> and <foo", "cut off here and"),
    ("<div class='cookie-notice'>c</div><header>h</header><p>p</p>", "p"),
    ("plain", "plain"),
    ("<article></article><p>out</p>", ""),
    ("", ""),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_templates_are_removed_per_host(spark):
    rows = [(i, f"https://a.org/{i}", f"<body><div>Read more on A</div><p>own text {i}</p><div><p>Call us</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"https://b.org/{i}", f"<body><div>Read more on A</div><p>b {i}</p></body>" if i == 0 else f"<p>b {i}</p>") for i in range(30)]
    rows += [(200 + i, "https://c.org/", "<article><p>same passage</p></article>") for i in range(30)] + [(300, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    assert got[3] == "own text 3" and got[100] == "Read more on A\nb 0" and got[203] == "same passage" and got[300] == ""
    assert html_extract.extract_main_text(df.where("page_id < 0")).count() == 0


def test_rotating_templates_small_hosts_and_copies(spark):
    """Eight notices rotate over a large host; a host has three pages; copies of one page aren't templates; extra columns clash."""
    notice = [f"Notice {k} of this site" for k in range(8)]
    rows = [(i, f"https://big.org/{i}", f"<div>{notice[i % 8]}</div><div><p>own {i}</p></div>") for i in range(400)]
    rows += [(1000 + i, f"https://small.org/{i}", f"<div>Follow us</div><p>small {i}</p>") for i in range(3)]
    rows += [(2000 + i, f"https://copy.org/{i}", "<div><p>the same page</p></div>") for i in range(40)] + [(2999, "https://copy.org/x", "<p>another</p>")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, templates string, host string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"own {i}" for i in range(400)) and all(got[1000 + i] == f"small {i}" for i in range(3))
    assert all(got[2000 + i] == "the same page" for i in range(40)) and got[2999] == "another"


def plain_templates(pages):
    """The templates of (host, html) pages, counted in loops."""
    import collections
    import math

    pages_of, seen = collections.defaultdict(set), collections.defaultdict(set)
    for host, html in pages:
        blocks, hashed, _ = html_extract.read_page(html)
        text = "\n".join(b[0] for b in blocks)
        if hashed:
            pages_of[host].add(text)
        for e in hashed:
            seen[host, e.digest].add(text)
    need = {h: max(3, min(len(p), math.ceil(2 * math.sqrt(len(p))))) for h, p in pages_of.items()}
    return {(h, d) for (h, d), texts in seen.items() if len(texts) >= need[h]}


def test_templates_against_loops(spark, small):
    rows = [(r.page_id, r.url, r.html) for r in table(spark, small, "pages").collect()]
    host = lambda url: re.match(r"[^/?#]*", url.split("://", 1)[1])[0].lower()
    plain = lambda h: re.sub(r"</?(nav|header|footer|aside|form|article|main)\b", lambda m: m[0].replace(m[1], "div"), h.replace('class="', 'data-k="'))
    for strip in (str, plain):
        # Once without the tags and classes that the structural rules know. Each host gets a closing line and one of three notices.
        rows = [(i, u, strip(h) + f"<div>All pages of {host(u)}</div><section><div>Notice {i % 3}</div></section>") for i, u, h in rows]
        want = plain_templates([(host(u), h) for _, u, h in rows])
        df = spark.createDataFrame([(i, host(u), h) for i, u, h in rows], "id long, host string, html string")
        found = html_extract.page_subtrees(df)
        assert {(r.host, r.subtree) for r in html_extract.templates_of(found).collect()} == want
        assert want
        text = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        for i, u, h in rows:
            assert text[i] == html_extract.main_text(h, frozenset(d for x, d in want if x == host(u)))


@pytest.mark.parametrize("html", ["<div>" * 20_000, "<div>x" * 20_000, "<div><li>" + "<span>" * 8000 + "<li></li>" * 5000, "<a '" * 20_000, "<!--" * 30_000, '<a "> " ' * 20_000])
def test_time_grows_with_length(html):
    import time

    began = time.perf_counter()
    html_extract.main_text(html)
    assert time.perf_counter() - began < 3


def test_articles_of_the_driver_tables(spark, small):
    html = {r.page_id: r.html for r in table(spark, small, "pages").collect()}
    rows = queries.op8_html_extraction(spark, small).collect()
    assert len(rows) == len(html)
    from html import unescape

    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", html[r.page_id], re.S)[1]
        parts = (re.sub(r"[ \t-\r]+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))).strip(" ") for p in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
