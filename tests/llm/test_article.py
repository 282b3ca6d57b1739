import html
import itertools
import random
import re

import pytest

from caseloom.llm import article
from caseloom.llm.layouts import made_pages

SCHEMA = "page_id long, url string, html string, text string, label int"
#: (page, main text): layouts that no training page is made after word by word.
PAGES = [
    (
        """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
        <div class="cookie-bar">We use cookies on this site. <button>OK</button></div>
        <header><a href="/">The Gazette</a></header>
        <nav class="menu"><ul><li><a href="/a">World</a></li><li><a href="/b">Business</a></li></ul></nav>
        <div class="article-content"><h1>Rivers &amp; lakes</h1>
        <p>The river rose   by two metres overnight, and the old
        bridge was closed to traffic until Friday morning.</p>
        <div class="advertisement">Buy our boots now!</div>
        <p>Officials said that 40 houses were emptied; nobody was hurt.<br>Rain is expected again.</p></div>
        <div id="comments"><h3>2 comments</h3><div class="comment"><p>I was there, and the water was higher than in 1998, I can tell you.</p></div>
        <div class="comment"><p>Thanks for the report.</p></div></div>
        <aside class="sidebar"><h4>Related stories</h4><ul><li><a href="/x">Snow in June</a></li></ul></aside>
        <footer>&copy; 2020 The Gazette. All rights reserved.</footer></body></html>""",
        "Rivers & lakes\nThe river rose by two metres overnight, and the old bridge was closed to traffic until Friday morning.\n"
        "Officials said that 40 houses were emptied; nobody was hurt. Rain is expected again.",
    ),
    (
        """<body><div id="header"><h2>Garden blog</h2><form action="/s"><input name=q><button>Search</button></form></div>
        <div id="navigation"><a href="/1">Start</a> | <a href="/2">Archive</a></div>
        <main><h1>Pruning roses</h1><p>Cut above a bud that points outwards, in March, when the frost is over.
        <p>Use sharp tools, and clean them after every plant.
        <ul><li>gloves that resist thorns</li><li>a saw for old wood</li></ul></main>
        <div class="newsletter-box">Subscribe to our newsletter!</div>
        <div class="footer">Imprint | Contact</div><script>var x = "<p>no</p>";</script></body>""",
        "Pruning roses\nCut above a bud that points outwards, in March, when the frost is over.\n"
        "Use sharp tools, and clean them after every plant.\ngloves that resist thorns\na saw for old wood",
    ),
]


@pytest.fixture(scope="module")
def field(spark):
    return article.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("page, text", PAGES)
def test_other_layouts(field, page, text):
    assert field.text(page) == text


def test_made_pages_held_out(field):
    held = [article.Page(page).blocks for page in made_pages(200, seed=77)]
    right = sum(label == block.label for blocks in held for label, block in zip(field.decode(blocks), blocks))
    assert right / sum(map(len, held)) > 0.98


def test_whole_table_like_a_pattern(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def plain(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner)]
        return "\n".join(filter(None, parts))

    found = article.extract(pages, article.train(pages)).collect()
    assert {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in found} == {
        (r["page_id"], r["url"], plain(r["html"]), len(plain(r["html"]))) for r in pages.collect()
    }


def test_odd_pages(spark, field):
    long = "<article>" + "".join(f"<p>Sentence number {i}, as good as the others.</p>" for i in range(20_000)) + "</article>"
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "<div><script>x</script><!-- a --></div>"), (4, "u", "</div></p></article>"),
        (None, "u", long), (7, "u", "<div>" * 5000 + "&nbsp; " + "</div>" * 5000), (8, "u", "<svg><title>no</title></svg><select><option>a<option>b</select>"),
    ]
    df = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)
    found = [tuple(row) for row in article.extract(df, field).collect()]
    assert len(found) == len(rows)
    of_long = [row for row in found if row[0] is None]
    assert of_long == [(None, "u", "\n".join(f"Sentence number {i}, as good as the others." for i in range(20_000)), of_long[0][3])]
    assert all(row[2] == "" and row[3] == 0 for row in found if row[0] is not None)
    assert article.extract(df.filter("false"), field).collect() == []
    # Without any page of the table, made pages teach.
    assert article.train(df.filter("false")).text(PAGES[0][0]).startswith("Rivers")


def test_blocks():
    page = article.Page("<p>a <b>b<br>c<p>d &lt;&amp;&#233;\u00a0 e</p>f<ul><li>g<li><a href=x>h</a> i</ul><table><tr><td>j<td>k</table>l")
    assert [block.text for block in page.blocks] == ["a b c", "d <&é e", "f", "g", "h i", "j", "k", "l"]
    assert [block.linked for block in page.blocks] == [0, 0, 0, 0, 1, 0, 0, 0]


def test_viterbi_like_all_labelings():
    dice = random.Random(1)
    for _ in range(50):
        scores = [dice.uniform(-2, 2) for _ in range(dice.randint(1, 7))]
        change = [[dice.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        field = article.Field({}, change)
        field.scores = lambda blocks: scores
        worth = lambda of: sum(s for s, label in zip(scores, of) if label) + sum(change[a][b] for a, b in zip(of, of[1:]))
        best = max(itertools.product((0, 1), repeat=len(scores)), key=worth)
        assert field.decode(scores) == list(best)
