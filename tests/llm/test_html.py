import html as H
import re
from collections import Counter

import numpy as np

from flowsieve.llm import html as E

FOLDER = "/root/testdata/sf0.01"


def plain(page):
    """The article element of the test pages, read by a pattern."""
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)
    if not body:
        return ""
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", body[1]))
    blocks = [" ".join(H.unescape(re.sub(r"</?b>|<[^>]*$", "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = E.op8_html_extraction(spark, FOLDER).collect()
    assert len(got) == len(pages)
    bad = [(r.page_id, r.text[-80:], plain(pages[r.page_id])[-80:]) for r in got if r.text != plain(pages[r.page_id])]
    assert not bad, (len(bad), bad[:3])
    assert all(r.n_chars == len(r.text) for r in got)


def test_page_without_marks():
    story = "".join(f"<p>Sentence number {k} is long enough to stand for the text of a story, with some words more.</p>" for k in range(4))
    page = f"<html><head><title>T</title></head><body><div class='top-menu'><a href=/>Home</a></div><ul><li><a>One</a><li><a>Two</a></ul><div><h1>Title</h1>{story}<p>End.</p></div><div id=comments><p>{'reader says so ' * 20}</p></div><div><p>x</div></body>"
    out = E.main_text(page).split("\n")
    assert out[0] == "Title" and out[5] == "End." and not any("reader" in x or x == "One" for x in out)


def test_parts_of_an_article():
    page = """<body><header>Site</header><article><header><h1>Title &amp; more</h1><p>by me</p></header><p>A<b>B</b> c<br>d &lt;x&gt; 1 < 2<aside>no</aside>
    <form>no<input></form><script>if (a<b) "</p>"</script><p title="a>b">last&nbsp; one<!-- no --><div class="ad">no</div></article><footer>no</footer>"""
    assert E.main_text(page) == "Title & more\nAB c d <x> 1 < 2\nlast one"


def test_awkward_pages(spark):
    assert [E.main_text(x) for x in (None, "", "just text", "<p", "<article><p>cut off &am", "<article>a<scr", "<" * 50_000)] == ["", "", "just text", "", "cut off &am", "a", "<" * 50_000]
    rows = [(1, None, None), (2, "u", "<p>x"), (2, "u", "<p>x")]
    out = E.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]


LONG = [f"Paragraph {k} of the story is long enough to surge by itself, with words and more words until it has a hundred characters." for k in range(3)]
SHORT = ["A short one.", "The end."]
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(5)) + "</ul>"


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_short_paragraphs_after_a_gap():
    links = [f"Link {k}" for k in range(5)]
    for before, after in (("<body>", ""), ("<body><ul><li><a>Home</a></ul><p>Welcome</p><ul><li><a>a<li><a>b<li><a>c</ul><div>", "</div><ul><li><a>Other</a></ul><div>Copyright</div>")):
        assert E.main_text(before + paragraphs(LONG) + LINKS + paragraphs(SHORT) + after).split("\n") == LONG + links + SHORT
        box = "<div class='share'><div>Share</div><div>Post</div><div>Send</div></div>"
        assert E.main_text(before + paragraphs(LONG) + box + paragraphs(SHORT) + after).split("\n") == LONG + SHORT
        assert E.main_text(before + paragraphs(LONG[:1]) + box + LINKS + f"<blockquote><p>{SHORT[0]}</p></blockquote>" + after).split("\n") == LONG[:1] + links + SHORT[:1]


def test_short_opening_inside_the_element():
    page = f"<body><ul><li><a>Home</a></ul><div>{paragraphs(SHORT * 3)}{LINKS}{paragraphs(LONG)}</div><ul><li><a>Other</a></ul>"
    assert E.main_text(page).split("\n") == SHORT * 3 + [f"Link {k}" for k in range(5)] + LONG


def test_open_elements_without_end_tags():
    for tags in (("dt", "dd"), ("li",), ("tr", "td", "th"), ("span class=x",), ("div",)):
        menu = "".join(f"<{t}>entry {k}" for k in range(100) for t in tags)
        assert E.main_text(f"<body><nav><dl><table>{menu}</nav><div>{paragraphs(LONG)}</div>") == "\n".join(LONG), tags
    assert E.main_text(f"<article><dl><dt class=ad>no<dd>yes</dl><table><tr><td class=ad>no<td>yes<tr class=menu><td>no<tr><td>yes<table><tr><td>in</table>out</table><ol><li class=ad><div>no<li>yes</ol>") == "yes\nyes\nyes\nin\nout\nyes"


def test_deep_pages_end():
    assert E.main_text("<div><li><ul>" * 30_000 + "x") == "x" and E.main_text("<div>" * 50_000 + "<li></li>" * 50_000 + "x") == "x"


def test_pages_without_their_marks(spark):
    rng, lost, added, all_blocks = np.random.default_rng(5), 0, 0, 0
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        page = r.html or ""
        if "<article>" not in page or "</article>" not in page:
            continue
        at = [m.end() for m in re.finditer("</p>", page) if page.index("<article>") < m.end() < page.index("</article>")]
        want = plain(page).split("\n")
        if not at or max(map(len, want)) < E.SURGE:
            continue
        cut = int(rng.choice(at))
        page = page[:cut] + LINKS + paragraphs(SHORT) + page[cut:]
        want = plain(page.replace(LINKS, "".join(f"<p>Link {k}</p>" for k in range(5)))).split("\n")
        got = E.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")).split("\n")
        all_blocks += len(want)
        lost += sum((Counter(want) - Counter(got)).values())
        added += sum((Counter(got) - Counter(want)).values())
    assert all_blocks > 500 and lost == 0 and added <= all_blocks // 500, (lost, added, all_blocks)
