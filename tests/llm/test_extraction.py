"""Main text of pages whose article is known, the parser, and the matching of trees."""

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from phasebeat.llm.extraction import Tree, main_text, matched, merged, roles
from phasebeat.llm.markup import Page

SCHEMA = "page_id long, url string, html string"


def sentence(rng, n=12):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def semantic(rng, i):
    """A page that says what its parts are."""
    body = [sentence(rng) for _ in range(rng.randint(1, 6))]
    head = sentence(rng, 4)
    page = f"""<!DOCTYPE html><html><head><title>{head}</title><style>p{{}}</style><script>var t="</p><article>x";</script></head>
    <body><header><h2>Site</h2><p>Slogan {i}</p></header><nav><ul><li><a href="/a">Home</a><li>{sentence(rng, 1)}</ul></nav>
    <div class="cookie-notice">We use cookies {i}</div><main><article><header><h1>{head}</h1></header>
    {"".join(f"<p>{b}" for b in body)}<div class="share-buttons"><a>Share {i}</a></div><form><label>Mail {i}</label><button>Go</button></form>
    <section id="comments"><article><p>{sentence(rng)}</p></article></section></article></main>
    <aside><p>{sentence(rng)}</p></aside><div class="ad banner">{sentence(rng)}</div><footer>&copy; {i}</footer>"""
    return page, " ".join([head, *body])


def bare(rng, i):
    """A page of plain ``div`` elements, of which only the text that varies is the article."""
    body = [sentence(rng) for _ in range(rng.randint(1, 5))]
    page = f"""<html><body><div>Weekly news of the region</div><div><span>Contact</span> us</div><div>{"".join(f"<p>{b}</p>" for b in body)}</div>
    <div>All rights reserved</div></body></html>"""
    return page, " ".join(body)


def test_pages_of_two_hosts(spark):
    rng = random.Random(4)
    made = [(i, "https://a.example.com/x", *semantic(rng, i)) for i in range(25)]
    made += [(100 + i, "http://me@B.example.org:80/y", *bare(rng, i)) for i in range(25)]
    # A page alone on its host is judged by pages of the same path elsewhere.
    made.append((200, "http://c.example.org", *bare(rng, 0)))
    rows = [r[:3] for r in made] + [made[0][:3]] * 20 + [made[30][:3]] * 20
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    df = df.withColumns({c: F.lit("x") for c in ("host", "name", "tree", "text", "blocks", "keep", "n_chars", "node")})
    found = main_text(df)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert len(rows) == len(made) + 40
    expected = {r[0]: r[3] for r in made}
    for r in rows:
        assert r.text == expected[r.page_id], r.page_id
        assert r.n_chars == len(r.text)


def test_driver_pages(spark):
    """In the given pages the article element holds the text and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    expected = {}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub("<[^>]*>", "", re.sub("</?(?:h1|p|br)>", "\n", inner))
        expected[r.page_id] = (r.url, " ".join(html.unescape(plain).split()))
    assert {r.page_id: (r.url, r.text) for r in main_text(pages).collect()} == expected


def test_edges(spark, nothing):
    long = "<p>" + "word " * 300_000
    rows = [(1, None, None), (2, "http://h/", ""), (3, "no url", "just text"), (None, None, "<p>a</p><p>b"), (None, None, "<p>a</p><p>b")]
    rows += [(4, "http://h/", long), (5, "http://h/", "<div>" * 5000 + "deep"), (6, "http://h/", "<nav>only</nav>"), (7, "http://h/", "< 5 & <3 <")]
    rows += [(8, "http://h/", "<div>x</div>" * 5000), (9, "http://i/", "<p title='a>b\" c>d</p>e"), (10, "http://i/", "<!-- no end <p>x")]
    found = {}
    for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.page_id, []).append(r.text)
    assert found[1] == found[2] == found[6] == found[10] == [""]
    assert found[3] == ["just text"] and found[None] == ["a b", "a b"]
    assert found[4] == [" ".join(["word"] * 300_000)] and found[5] == ["deep"]
    assert found[7] == ["< 5 & <3 <"] and found[8] == [" ".join("x" * 5000)]
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "source, blocks",
    [
        ("<p>One<b>two</b> th&eacute;\n three<br>four<p>five", ["Onetwo thé three four", "five"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<p>a<div>b</div>c</p>d", ["a", "b", "c", "d"]),
        ("<SCRIPT>if (a<b) '</p>'</SCRIPT >x<!-- <p>no</p> -->y<![CDATA[z]]>", ["xy"]),
        ("&amp;lt; &nbsp; &#8364; &am &bogus;", ["&lt; € &am &bogus;"]),
        ('<a href="x>y">k</a></i></b><i>l', ["kl"]),
        ("<h1>a<h2>b</h2>c", ["a", "b", "c"]),
        ("a<hr>b<img src=x>c<wbr>d", ["a", "bcd"]),
    ],
)
def test_blocks(source, blocks):
    assert [t for _, t in Page(source).blocks] == blocks


def size(a, b, x=0, y=0):
    """The most nodes that match, by trying all choices of children."""
    if a.labels[x] != b.labels[y]:
        return 0
    left, right, best = a.children[x], b.children[y], 0
    for n in range(min(len(left), len(right)) + 1):
        for some in itertools.combinations(left, n):
            for other in itertools.combinations(right, n):
                best = max(best, sum(size(a, b, i, j) for i, j in zip(some, other)))
    return 1 + best


def tree(rng, n):
    return Tree([-1] + [rng.randrange(max(i - 3, 0), i) for i in range(1, n)], ["r"] + [rng.choice("xyz") for _ in range(n - 1)])


def test_matching_is_the_largest():
    rng = random.Random(2)
    for _ in range(150):
        a, b = tree(rng, rng.randint(1, 8)), tree(rng, rng.randint(1, 8))
        at = matched(a, b)
        assert len(at) == size(a, b)
        assert len(set(at.values())) == len(at)
        assert all(a.labels[x] == b.labels[y] and (y == 0 or at[b.parents[y]] == a.parents[x]) for y, x in at.items())


def test_a_merged_tree_holds_both():
    rng = random.Random(3)
    for _ in range(100):
        a, b = tree(rng, 8), tree(rng, 8)
        both = merged(Tree(a.parents, a.labels), b)
        assert len(matched(both, a)) == 8
        assert len(matched(both, b)) >= size(a, b)
        again = Tree.read(both.written())
        assert len(again.labels) <= 16


def test_roles():
    p = Page("<form id=all><div class=sidebar-left>a</div><h1>b</h1><div class='post has-sidebar'><article>c<footer>d</footer></article></div></form>")
    found = dict(zip(p.labels, zip(*roles(Tree(p.parents, p.labels)))))
    assert found["form.all"] == (False, False) and found["div.sidebar-left"] == (True, False)
    assert found["article."] == (False, True) and found["footer."] == (True, True)
