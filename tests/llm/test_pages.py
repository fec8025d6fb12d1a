"""Template removal: written cases, whole sites against a plain recount, odd markup, awkward tables."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import pages
from strandlake.llm.pages import Page

KIND = "page_id long, url string, html string"


def text(html, template=frozenset()):
    return Page(html).text(template)[0]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b<br>c</p><ul><li>d<li>e</ul>f", "a\n\nb c\n\nd\n\ne\n\nf"),
        ("<article><h1>A &amp; B &#8212; &eacute;&nbsp;x</h1><p><b>un<i>closed<p>next</article>", "A & B — é x\n\nunclosed\n\nnext"),
        ("<p>a < b &lt;i&gt; 3<4 &am", "a < b <i> 3<4 &am"),
        ("<title>no</title><script>if (a</p>b) '<p>no'</script><style>p{}</style><p>yes<!-- no <p>no --></p><noscript>no</noscript>", "yes"),
        ("<p>end<a href='x", "end"),
        ("<body><form action=x><article><p>kept</p><form>gone</form></article></form><form>gone</form>", "kept"),
        ("<article><header><h1>Head</h1><nav>menu</nav></header><p>x</p><footer>foot</footer><div class='share-buttons'>s</div><div id=comments><p>c</p></div></article>", "Head\n\nx"),
        ("<header>Site</header><main class='has-sidebar'><p>x</p><div class='ad-slot'>ad</div><div class='advice'>kept</div></main><aside>side</aside>", "x\n\nkept"),
        ("<article class=comment><p>reader</p></article><div><p>text</p></div>", "text"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
        ("<div hidden>no</div><div style='color:red; display: none'>no</div><span aria-hidden=true>no</span>yes", "yes"),
        ("<script>never ends <p>no", ""),
        ("</p></div><p>x</section>y", "xy"),
        ('<a title="a > b" href=\'c>d\'>x</a>', "x"),
        ('<a title="never closed>x', "x"),
    ],
)
def test_cases(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    assert text("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert text("<p>" + "word " * 200_000 + "</p><p>end") == ("word " * 200_000).strip() + "\n\nend"
    assert text("<a href=\"" * 50_000) == ""


def site(host, n, article=True):
    """Pages of one template: unnamed blocks that stay the same or change, around an article of one's own."""
    for i in range(n):
        body = f"<h1>Head {host} {i}</h1><p>Body {i} of {host}.</p><p>A passage that all pages share.</p>"
        body = f"<article>{body}</article>" if article else f"<div class=text><h2>Head {i} of {host}</h2><p>Body {i}.</p></div>"
        yield f"https://{host}/{i}", f"<html><head><title>t</title></head><body><div class=top><b>Welcome to {host}</b></div><div class=x9>Today: item {i * i} <a href=/{i}>more</a></div>{body}<div><p>All rights of {host}</p></div></body></html>"


def recounted(rows, share, least):
    """The same with plain sets: each host's subtrees on enough different pages."""
    found, seen = defaultdict(Counter), defaultdict(set)
    name = lambda url: m[1].lower() if (m := re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", url or "")) else None
    for _, url, html in rows:
        if (h := name(url)) and html not in seen[h]:
            seen[h].add(html)
            found[h].update(Page(html).candidates())
    many = {h: {k for k, n in c.items() if n >= max(least, math.ceil(share * len(seen[h])))} for h, c in found.items()}
    return sorted(((i, url, *(lambda x: (x[0], len(x[0]), x[1]))(Page(html).text(many.get(name(url), set())))) for i, url, html in rows), key=repr)


def awkward():
    made = [p for host, n, article in (("a.example", 12, True), ("b.example", 9, False), ("c.example", 2, True)) for p in site(host, n, article)]
    rows = [(i, *p) for i, p in enumerate(made)]
    rows += [(100, made[0][0], made[0][1])] * 3 + [(101, None, made[0][1]), (102, "no url", "<p>x"), (None, "HTTPS://u:p@A.example:80/q", made[3][1]), (103, "https://a.example/n", None), (104, "https://a.example/e", "")]
    rows += [(200 + i, f"https://d.example/{i}", "<body><div><p>Always the same.</p></div></body>" + " " * i) for i in range(5)]  # nothing but what recurs
    return rows


def test_sites(spark):
    rows = awkward()
    given = spark.createDataFrame(rows, KIND).withColumns({"host": F.lit("z"), "hashes": F.lit(1), "text": F.lit("t")}).repartition(5)
    got = sorted(map(tuple, pages.extract(spark, given).collect()), key=repr)
    assert got == recounted(rows, pages.SHARE, pages.PAGES)
    by = {r[0]: r[2] for r in got}
    assert by[3] == "Head a.example 3\n\nBody 3 of a.example.\n\nA passage that all pages share."  # the block that changes goes, too
    assert by[14].startswith("Today: item 4 more\n\nHead 2 of b.example") and "Welcome" not in by[14] and "rights" not in by[14]
    assert "Welcome to c.example" in by[21]  # two pages are no template
    assert by[200] == "Always the same."


def test_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(pages, "BROADCAST", -1)
    rows = awkward()
    assert sorted(map(tuple, pages.extract(spark, spark.createDataFrame(rows, KIND)).collect()), key=repr) == recounted(rows, pages.SHARE, pages.PAGES)


def test_empty(spark):
    assert pages.extract(spark, spark.createDataFrame([], KIND)).collect() == []


def test_given_pages(spark):
    """The given table against its articles, read by pattern."""
    path = "/root/testdata/sf0.01/pages.parquet"
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{path}'").fetchall()
    got = sorted(map(tuple, pages.extract(spark, spark.read.parquet(path)).collect()), key=repr)
    assert got == recounted(rows, pages.SHARE, pages.PAGES)
    from html import unescape

    plain = {}
    for i, _, html in rows:
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", html, re.S)[1].replace("<br>", " "))
        plain[i] = "\n\n".join(x for p in parts if (x := " ".join(unescape(re.sub("<[^>]*>", "", p)).split())))
    assert {r[0]: r[2] for r in got} == plain
    assert sum(r[4] > 0 for r in got) > 0.8 * sum(n >= 3 for n in Counter(re.search("//([^/]*)", r[1])[1] for r in rows).values())
