import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import html_text as ht

PARA = "This paragraph is long enough to be taken for the main text of a page, surely."


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<p>hi", "hi"), ("plain", "plain"), ("<div>a < b &amp;&amp; c &lt; d</div>", "a < b && c < d"), ("<article><h1>T</h1><p>a&amp;amp;b</p></article><p>out", "T\na&amp;b"),
    (f"<nav>menu</nav><div><p>{PARA}</p><p>Short.</p></div><footer>f</footer>", f"{PARA}\nShort."), (f"<div><p>{PARA}</p></div><div class='comments'><p>{PARA}</p></div><div id=sidebar>{PARA}</div>", PARA),
    (f"<body><header><h1>Site</h1></header><main><p>{PARA}</p><form>{PARA}</form><div class=cookie-notice>{PARA}</div><div class='shadow leader'>ok</div></main>", f"{PARA}\nok"),
    ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside><footer>no</footer></article>", "T\nx"), ("<article><p>a<script>if (a < b) { '</p>' }</script>b<style>p{}</style><!-- no > -- --></p></article>", "a\nb"),
    ("<article><p>a<br>b\n  c&nbsp;d</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "a b c d\none\ntwo\nx\ny"), ("<article><a href='>'>link only</a></article>", "link only"), ("<article><p>cut off <b", "cut off"),
    ("<article><div role=navigation>no</div><div hidden>no</div><div style='display: none'>no</div><p>yes</p></article>", "yes"), ("<p>&copy &am &#233; &#x1F600;</p>", "© &am é 😀"), ("<SCRIPT>x</ScRiPt><ARTICLE>İx</ARTICLE>", "İx"),
    (f"<div>Site</div><hr><div class=head>x</div><div class=post><h1>T</h1><p>Short.</p><p>{PARA}</p><p>End.</p></div>", f"T\nShort.\n{PARA}\nEnd."), ("<article><div class='post-header'><h2>T</h2></div><p>x</p></article>", "T\nx"),
])
def test_pages(page, text):
    assert ht.extract(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<div><p>{PARA}</p><p>Second.</p></div><article><a href=x>Next story</a></article>", f"{PARA}\nSecond.\nNext story"),
    (f"<div>Site</div><article><p>Teaser.</p></article><div class=body><h1>T</h1><p>{PARA}</p></div><footer>f</footer>", f"Teaser.\nT\n{PARA}"),
    (f"<div>Site</div><article><p>{PARA}</p></article><div>Short line.</div>", PARA),
])
def test_text_beside_an_article(page, text):
    assert ht.extract(page) == text


AD = "<div class=advert><p>Buy.</p><p>Now.</p><p>Here.</p><p>Cheap.</p></div>"
LINKS = "<ul><li><a href=x>First link</a><li><a href=y>Second link</a><li><a href=z>Third link</a><li><a href=w>Fourth link</a></ul>"


@pytest.mark.parametrize("page, text", [
    (f"<div class=post><p>Dear reader,</p><p>{PARA}</p></div><footer>f</footer>", f"Dear reader,\n{PARA}"),
    (f"<nav>menu</nav><div><p>One.</p><p>Two.</p><p>Three.</p><p>{PARA}</p></div>", f"One.\nTwo.\nThree.\n{PARA}"),
    (f"<div><p>{PARA}</p>{AD}<p>A short paragraph closes the text.</p></div><footer>f</footer>", f"{PARA}\nA short paragraph closes the text."),
    (f"<div><p>{PARA}</p>{LINKS}<p>{PARA}</p></div>", f"{PARA}\nFirst link\nSecond link\nThird link\nFourth link\n{PARA}"),
    (f"<div><p>{PARA}</p><h2>References</h2>{LINKS}</div><footer>f</footer>", f"{PARA}\nReferences\nFirst link\nSecond link\nThird link\nFourth link"),
    ("<nav><p>a</nav><footer>b</footer>", ""),
])
def test_nothing_but_boilerplate_is_dropped(page, text):
    assert ht.extract(page) == text


@pytest.mark.parametrize("start", ["<body>", "<body class=x>", "<div>", "<p>", "", "</head><body>", "<a href=x></a>", "<br>", "<html><body>", "<head><basefont><body>"])
def test_head_without_end_tag(start):
    page = f"<html><head><meta charset=utf-8><title>No</title><style>p {{}}</style>\n<script>var no;</script><noscript>no</noscript>\n<link rel=x>{start}{PARA}<p>Short.</p></html>"
    assert ht.extract(page) == f"{PARA}\nShort."


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>/!-=\"' abp&;"), max_size=80))
def test_any_markup(page):
    out = ht.extract(page)
    assert out == "\n".join(x.strip() for x in out.split("\n"))


def test_weights_of_lines():
    lines, nodes = ht.lines_of(f"<div><a href=x>only a link</a></div><p>{PARA} <a>more</a></p><nav>x</nav>")
    assert [(x.text, w) for x, w in zip(lines, ht.weighed(lines, nodes), strict=True)] == [("only a link", 0), (f"{PARA} more", len(PARA) + 1), ("x", None)]


BODY = f"<h1>T</h1><p>{PARA}</p><p>Short.</p><p>{PARA}</p>"
TEXT = f"T\n{PARA}\nShort.\n{PARA}"


@pytest.mark.parametrize("page", [
    f'<div class="elementor-widget">{BODY}</div>', f'<div class="layout has-sidebar">{BODY}</div>', f'<div class="has-sidebar"><main>{BODY}</main></div>', f'<article><div class="entry share-ready">{BODY}</div></article>', f"<form id=aspnetForm>{BODY}</form>",
    f"<form id=aspnetForm><nav>menu</nav><div class=widget>{BODY}</div><div class=sidebar>{PARA}</div></form>", f"<div class=popup-ready><div class=newsletter-signup>{PARA}</div>{BODY}</div>", f"<div id=page class=comments-open>{BODY}<div id=comments><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p><p>{PARA}</p></div></div>",
    f"<div class=ad>{PARA}</div><article>{BODY}</article><div class=comment-list>{BODY * 9}</div>", f"<div>{BODY}<span hidden>no</span></div>", f"<div class=sidebar><div class=advert>{PARA}</div>{BODY * 0}</div><div>{BODY}</div>", f"<div class=widget-area><div class=widget>{BODY}</div></div>",
    f"<p>Some company with a tag line of more than sixty characters in all.</p><form id=f>{BODY}</form>".replace("<p>Some", "<footer><p>Some").replace("all.</p>", "all.</p></footer>"), f"<div class='post-header'></div>{BODY}<button>Buy</button>",
])
def test_classes_do_not_stand_in_for_the_text(page):
    assert ht.extract(page) == TEXT


@pytest.mark.parametrize("page, text", [
    (f"<div>{BODY}</div><p></p><article><p>Teaser.</p></article>", f"{TEXT}\nTeaser."), (f"<article>{BODY}<section class=related-work><h2>Related work</h2><p>{PARA}</p></section></article>", f"{TEXT}\nRelated work\n{PARA}"),
    (f"<div>{BODY}<p>Let <math><mi>x</mi></math> be.</p><svg><title>no</title><text>label</text></svg></div>", f"{TEXT}\nLet x be.\nlabel"), (f"<div>{BODY}<pre><span class=comment># note</span> x = 1</pre></div>", f"{TEXT}\n# note x = 1"),
    (f"<div>Site name</div><div>{BODY}</div><div>All rights reserved</div>", TEXT), (f"<div>{BODY}</div><div><h2>More</h2><a href=x>Story one</a></div>", TEXT), (f"<div class=post-header><h1>T</h1></div><div><p>{PARA}</p></div>", f"T\n{PARA}"),
    (f"<div class='ad-slot top'><p>{PARA}</p></div><div class=content><p>{PARA}</p><div class=cookieNotice>{PARA}</div><p>End.</p></div>", f"{PARA}\nEnd."),
])
def test_line_blocks(page, text):
    assert ht.extract(page) == text


@pytest.mark.parametrize("page, text", [
    *[(f"<article>{BODY}<div class={c}><p>{PARA}</p></div><p>End.</p></article>", f"{TEXT}\nEnd.") for c in ("promo-card", "google-ad", "adbox", "reader-comments", "cc-window", "newsletterBox", "socialbar")],
    (f"<article>{BODY}</article><ol class=commentlist><li>{PARA}</ol>", TEXT), (f"<article>{BODY}</article><section id=discussion><h2>Comments</h2><p>{PARA}</p></section>", TEXT), (f"<div>{BODY}</div><section><h3>12 Comments:</h3><p>{PARA}</p><p>{PARA}</p></section>", TEXT),
    (f"<div class=cc-window><p>{PARA}</p></div><article>{BODY}</article>", TEXT), (f"<div>{BODY}</div><p>© 2024 Some Company with a long name and a long list of rights that are all reserved.</p>", TEXT), (f"<article>{BODY}<p>© 2024 stays inside an article.</p></article>", f"{TEXT}\n© 2024 stays inside an article."),
    (f"<article>{BODY}<p>One <span class=ad>Buy now</span> two</p></article>", f"{TEXT}\nOne two"), (f"<article>{BODY}<aside class=pullquote><p>Quoted.</p></aside><aside>no</aside></article>", f"{TEXT}\nQuoted."), (f"<article>{BODY}<div><h4>Related posts</h4><a href=x>Story</a></div></article>", TEXT),
    (f"<article><h1>Discussion</h1><p>{PARA}</p></article>", f"Discussion\n{PARA}"), (f"<article><h1>T</h1><section><h2>Discussion</h2><p>{PARA}</p><p>{PARA}</p></section><p>Short.</p></article>", f"T\nDiscussion\n{PARA}\n{PARA}\nShort."), (f"<article>{BODY}<div class=adherence>{PARA}</div></article>", f"{TEXT}\n{PARA}"),
])
def test_adverts_comments_and_notices(page, text):
    assert ht.extract(page) == text


def by_hand(weights, tops, ends, headings):
    """The rule of windows, surge and dive, without sums kept."""
    heavy = [0 if w is None else w for w in weights]
    least = 60 if any(w >= 60 for w in heavy) else max(heavy, default=0)
    kept, first, last = set(), None, None
    for k in range(len(heavy)):
        window = heavy[k] + (heavy[k - 1] if k else 0) + (heavy[k + 1] if k + 1 < len(heavy) else 0)
        if heavy[k] > 0 and heavy[k] >= min(20, least) and window >= least:
            first, last = (k if first is None else first), k
    if first is None:
        return []
    kept.update(range(first, last + 1))
    if not headings[first]:
        kept.update(range(tops[first], first))
    kept.update(range(last, ends[last]))
    return sorted(k for k in kept if weights[k] is not None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "div", "h1", "li", "section", "nav", "article"]), st.integers(0, 90), st.sampled_from(["", " class=ad", " class=x-ad", " class=comments", " hidden"]), st.booleans()), max_size=12))
def test_windows_by_hand(blocks):
    page = "".join(f"<{n}{c}>{'w' * size}" + (f"</{n}>" if shut else "") for n, size, c, shut in blocks)
    lines, nodes = ht.lines_of(page)
    weights = ht.weighed(lines, nodes)
    assert all(0 <= x.top <= k < x.end <= len(lines) for k, x in enumerate(lines))
    assert ht.main_lines(lines, weights) == by_hand(weights, [x.top for x in lines], [x.end for x in lines], [x.heading for x in lines])


def test_without_names(spark):
    """Neither classes nor article: the windows alone find the long paragraphs, and leave menus out."""
    good = 0
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in pages:
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|[^\s>]+)", "", page).replace("<article>", "<div>").replace("</article>", "</div>")
        out = ht.extract(bare).split("\n")
        menu = [html.unescape(x) for x in re.findall(r"<li><a[^>]*>(.*?)</a>", page)]
        good += all(x in out for x in article(page).split("\n") if len(x) >= ht.SURGE) and not any(m in out for m in menu)
    assert good >= 0.95 * len(pages)


def article(page):
    """What the generated pages hold between their article tags."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf_dir, table):
    pages = {r.page_id: r.html for r in table("pages").collect()}
    rows = ht.op10(spark, sf_dir).collect()
    assert len(rows) == len(pages) and all(r.text == article(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", ""), (3, "u", f"<p>{PARA}" * 3000), (3, "u", f"<p>{PARA}" * 3000)], "page_id long, url string, html string")
    got = ht.extract_text(rows.selectExpr("*", "'mine' AS text", "7 AS n_chars")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0] + [3000 * (len(PARA) + 1) - 1] * 2 and all(r.n_chars == len(r.text) for r in got)
    assert ht.extract_text(rows.limit(0)).count() == 0
