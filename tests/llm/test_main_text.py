"""Main text: hand-written pages, and random trees against a plain scorer."""

import random
from xml.etree import ElementTree

import pytest

from corpuspack.llm import main_text as M

P1 = "First paragraph, with some, commas and a lot of text that goes on for long enough to count."
P2 = "Second paragraph, also long, with words, words and more words until it has points enough."

PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{x:1}}</style></head><body class="no-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<script>var t="</p>";if(a<b){{}}</script><!-- <p>hidden</p> -->
{{0}}
<form><p>{P1}</p><input><button>go</button></form><footer>&copy; all</footer></body></html>"""


@pytest.mark.parametrize("inside, text", [
    (f"<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article>", f"Title\n{P1}\n{P2}"),
    (f"<article><h1>Title</h1><p><b>{P1}<br><p>{P2}</article>", f"Title\n{P1}\n{P2}"),
    (f"<div id=content><h1>Title</h1><div class=entry><p>{P1}</p><p>{P2}</p></div></div><div class=box><p>We use it.</p></div>", f"Title\n{P1}\n{P2}"),
    (f"<main><section><h2>A</h2><p>{P1}</section><section><h2>B</h2><p>{P2}</section></main>", f"A\n{P1}\nB\n{P2}"),
    (f"<article><p>{P1}</p><div class='advert-box'>Buy, now</div><aside>{P2}</aside><p>{P2}</p></article><div class=sidebar><p>{P1}</p></div>", f"{P1}\n{P2}"),
    (f"<article><p>{P1}</p><section id=comments><p>{P2}</p></section><article><p>{P2}</p></article></article>", P1),
    (f"<article><p>{P1}</p><div role=alert>Notice</div><div hidden>x</div><div style='display: none'>y</div></article>", P1),
    (f"<article><p>{P1}</p><ul><li><a>more of one</a><li><a>more of two</a><li><a>and three</a></ul><ul><li>item</ul></article>", f"{P1}\nitem"),
    (f"<article><p>a &lt;b&gt; &amp;amp; &eacute;&#8212;&#x41; &nbsp;x  \n\t y</p><p>{P1}</p></article>", f"a <b> &amp; é—A x y\n{P1}"),
    (f"<article><p>{P1}</p><blockquote>Said.</blockquote><pre>a\n  b</pre><table><tr><td>c<td>d</table></article>", f"{P1}\nSaid.\na b\nc\nd"),
])
def test_pages(inside, text):
    assert M.main_text(PAGE.replace("{0}", inside)) == text


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a", "a"), ("<div class=ad>only an advert</div>", ""),
    ("<nav><a href=x>menu</a></nav>", ""), ("<div class=ad>an advert</div><form><input></form>", ""), ('<a href="x>y">q</a> z', "q z"), ("a < b and c > d", "a < b and c > d"),
    ("<p title=it's>one</p><p>it's</p>", "one\nit's"), ("<p>x<script>y", "x"), ("<p>cut off <b cla", "cut off"),
    ("<!-- never ends <p>x</p>", ""), ("<P CLASS=X>upper</P>", "upper"),
    (f"<div class='page sidebar-right'><div class=ad>Buy</div><article><p>{P1}</p><p class=ad>x</p></article></div>", P1),
    (f"<form id=page><p>{P1}</p></form>", P1), ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
])
def test_broken_and_bare(page, text):
    assert M.main_text(page) == text


def test_names_of_parts():
    assert M.says_other("div", " class='post comments'") and M.says_other("div", "id=site-footer")
    assert M.says_other("div", " class=adBanner") and M.says_other("p", " role=navigation")
    assert not M.says_other("div", " class='shadow heading content'") and not M.says_other("div", " class=with-sidebar")
    assert not M.says_other("body", " class=sidebar")


def test_table(spark):
    rows = [(1, "u", PAGE.replace("{0}", f"<article><p>{P1}</article>")), (None, None, None), (3, "v", ""), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, M.extract(pages.selectExpr("*", "1 as text", "2 as n_chars")).collect()), key=str)
    assert got == sorted([(1, "u", P1, len(P1)), (None, None, "", 0), (3, "v", "", 0), (3, "v", "", 0)], key=str)
    assert M.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("inside, text", [
    (f"<section id='discussion'><h2>Discussion</h2><p>{P2}</p></section>", f"Discussion\n{P2}"),
    (f"<section id=discussion><p>{P2}</p></section>", P2),
    ("<h2 id='related-work'>Related work</h2><h2 id=search-results>Results</h2>", "Related work\nResults"),
    ("<p class='form-text'>A form of text.</p><div class=copyright-law>Laws differ.</div>", "A form of text.\nLaws differ."),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p>", "So x=1 holds."),
    ("<header class='entry-header'><h1>Title</h1></header>", "Title"), ("<div class=entry-header><h1>Title</h1></div>", "Title"),
    # still left out: comments, linked boxes, notices, whatever stands in them
    (f"<section id=discussion><h2>Discussion</h2><div class=comment><p>{P2}</p></div></section>", ""),
    (f"<section class='related-reading'><h2>Related</h2><p><a>{P2}</a></p></section>", ""),
    ("<section class=related><h2>Related</h2><p><a>One page</a> <a>another page</a></p></section>", ""),
    (f"<div class=cookie-notice><h2>Cookies</h2><p>{P2}</p></div><p class=copyright>All rights reserved.</p>", ""),
    (f"<ol class=comment-list><li>{P2}</li></ol><div class='sidebar-left'>{P2}</div><div class=site-footer>x</div>", ""),
])
@pytest.mark.parametrize("around", ["article", "main"])
def test_names_within_an_article_are_evidence(inside, text, around):
    want = P1 + "\n" + text if text else P1
    assert M.main_text(PAGE.replace("{0}", f"<{around}><p>{P1}</p>{inside}</{around}>")) == want


def plain_text(source):
    """The container by points, with its siblings, on a tree of div, p and h2."""
    root = ElementTree.fromstring(source)
    up = {c: e for e in root.iter() for c in e}
    order = {e: i for i, e in enumerate(root.iter())}
    text = {e: " ".join("".join(e.itertext()).split()) for e in root.iter() if e.tag in ("p", "h2")}
    links = {e: sum(len("".join("".join(a.itertext()).split())) for a in e.iter("a")) for e in root.iter()}
    size = {e: sum(len(text[x]) for x in e.iter() if x in text) for e in root.iter()}
    points = dict.fromkeys(root.iter(), 0.0)
    for e, t in text.items():
        if t:
            at = up[e] if e.tag == "p" else e
            for part in (1, 2, 6, 9, 12):
                if at is None:
                    break
                points[at] += (min(1.0, len(t) / 25) + t.count(",") + min(len(t) / 100, 3.0)) / part
                at = up.get(at)
    score = {e: p * (1 - min(links[e], size[e]) / size[e]) if size[e] else 0 for e, p in points.items()}
    best = min(root.iter(), key=lambda e: (-score[e], order[e]))
    if best is root:
        kept = [root]
    else:
        kept, heads = [], []
        for e in up[best]:
            own, density = text.get(e, ""), links[e] / size[e] if size[e] else 1
            sentence = e.tag == "p" and ((size[e] > 80 and density < 0.25) or (density == 0 and own[-1:] in list(".!?")))
            if e is best or score[e] >= 0.2 * score[best] or sentence:
                kept += heads + [e]
                heads = []
            elif e.tag == "h2":
                heads.append(e)
            elif size[e]:
                heads = []

    def read(e):
        menu = e.tag in ("div", "p") and sum(bool(text[x]) for x in e.iter("p") if x.find("a") is not None) >= 3 and (
            links[e] >= 0.6 * size[e])
        own = [text[e]] if text.get(e) else []
        return own if e in text else [] if menu and e not in kept else [t for c in e for t in read(c)]

    return "\n".join(t for e in kept for t in read(e))


def test_random_trees_equal_a_plain_scorer():
    rng = random.Random(11)

    def words():
        return " ".join(rng.choice(["some", "words,", "here", "end."]) for _ in range(rng.choice([0, 2, 8, 30])))

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["<p>{}</p>", "<p>{} x</p>", "<h2>{} y</h2>", "<p><a>{}</a></p>"]).format(words())
        return "<div>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) + "</div>"

    for _ in range(2000):
        page = "<body>" + "".join(tree(3) for _ in range(3)) + "</body>"
        assert M.main_text(page) == plain_text(page), page


def test_long_page_and_ties():
    body = "".join(f"<p>{P1} {i}</p>" for i in range(20_000))
    assert M.main_text(f"<div>{body}</div>").count("\n") == 19_999
    # two boxes with the same points: the first is the container, the other scores as well as it
    assert M.main_text(f"<div><p>{P1}</p></div><div><p>{P1}</p></div>") == f"{P1}\n{P1}"
