"""Main text of whole pages."""

import html
import math
import re
import time

import pytest

from marginalia.llm import html as H
from tests.llm.fixtures import collected

BODY = "".join(f"<p>Sentence {k} of the article, with enough words in it to look like text, and <a href=x>a link</a>.</p>" for k in range(5))
TEXT = " ".join(f"Sentence {k} of the article, with enough words in it to look like text, and a link." for k in range(5))
MENU = "<ul>" + "".join(f"<li><a href=/{k}>Menu entry {k}</a>" for k in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav>{MENU}</nav><article><h1>Head</h1>{BODY}</article><footer>&copy; us</footer></body></html>",
        f"<html><body><header><h2>Site</h2>{MENU}</header><main><h1>Head</h1>{BODY}<aside>See also</aside></main><div class='cookie-notice'>We use cookies</div>",
        f"<body><div id=menu>{MENU}</div><div class=page><div class=content><h1>Head</h1>{BODY}</div><div class=sidebar><p>Side text about other things</div></div><div id=footer>foot</div>",
        f"<body><table><tr><td>{MENU}<td><h1>Head</h1>{BODY}</table>",
        f"<body><article><header><h1>Head</h1></header>{BODY}<form><input><button>Send</button></form><section class=comments><p>{'I like this very much. ' * 20}</p></section></article>",
        f"<body><script>var a = '<p>not text</p>';</script><style>p {{}}</style><div class='ad-banner'><p>Buy now</p></div><h1>Head</h1><div>{BODY}</div><!-- <p>no</p> --><noscript>no</noscript>",
        f"<BODY CLASS='has-sidebar'><DIV><H1>Head</H1>{BODY}</DIV><div style='display: none'>hidden words</div><ul class=comment-list><li>first comment<li>second comment</ul>",
        f"<body><div>{MENU}</div><div><h1>Head</h1>{BODY}</div><div>{MENU}</div>",
        f"<body><header><h1>Site</h1>{MENU}</header><article><h1>Head</h1>{BODY}</article><section id=comments><h2>Comments</h2>{'<p>I like this text very much, thank you for it.</p>' * 60}</section>",
        f"<body><div class='site-header'><h1>Site</h1></div><main><h1>Head</h1><article>{BODY}</article></main><div class=related><p>{'Another text to read now. ' * 9}</p></div>",
        f"<body><div class=post><div class=post-header><h1>Head</h1></div>{BODY}<div class=share>Share this</div></div><div class=comments><p>{'So good. ' * 400}</p></div>",
        f"<body><article><h1>Head</h1>{BODY}</article><div><h2>What readers say</h2>{'<p>A very long remark of some reader, who had much to say about all this.</p>' * 30}</div>",
        f"<body><div class=header><h1>Site</h1></div><article class='post no-sidebar'><div class=header><h1>Head</h1></div>{BODY}<div class=notice>Accept our terms</div></article>",
    ],
)
def test_article_alone(page):
    assert H.main_text(page) == "Head " + TEXT


def test_link_lists_of_an_article_stay():
    assert H.main_text(f"<article><p>Read on:</p>{MENU}</article>") == "Read on: " + " ".join(f"Menu entry {k}" for k in range(8))


def test_text_is_joined_as_it_is_read():
    page = "<article><h1>A&amp;B</h1><p>one\n  two<b>bold</b><br>three&nbsp;four &lt;tag&gt; &#x41;&am &amp</p>tail<div>in<span>line</span></div><li>x<li>y</article>"
    assert H.main_text(page) == "A&B one twobold three four <tag> A&am & tail inline x y"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<!-- never ends <p>b", "a"), ("<div", ""), ("<p>x</p></div></b>", "x"), ("<script>only</script>", ""), ("<p>a < b and c</p>", "a < b and c"), ("<a href='x>y'>t</a>", "t"), ("<title>T</title>", "")])
def test_awkward_pages(page, text):
    assert H.main_text(page) == text


def test_long_and_deep_pages():
    assert H.main_text("<article><p>" + "word " * 200_000 + "</article>") == ("word " * 200_000).strip()
    assert H.main_text("<div>" * 30_000 + "deep text" + "</div>" * 10) == "deep text"
    assert H.main_text("<article class=header>" * 9_000 + "deep text") == "deep text"
    assert H.main_text("<div class=menu>" * 9_000 + "x" + "</div>" * 9_000 + "<p>text</p>") == "text"


@pytest.mark.parametrize("part,end", [("<div>", "</x>"), ("<div>", "<td>"), ("<b>", "<p></p>"), ("<span>", "<div>x"), ("<ul><li>x", "</b>"), ('<a "', "<p>"), ("<p><b>x", "</i>")])
def test_stray_tags_take_linear_time(part, end):
    began = time.process_time()
    H.main_text(part * 100_000 + end * 100_000)
    assert time.process_time() - began < 20  # a walk to the root for each tag would take many minutes


def plain_density(node, share):
    """The density of one node from scratch, by walking its whole subtree."""
    chars = tags = link_chars = link_tags = 0
    todo = [(node, False)]
    while todo:
        n, in_link = todo.pop()
        for k in n.kids:
            if isinstance(k, str):
                n_chars = len(re.sub(r"[ \n\t\r]", "", k))
                chars += n_chars
                link_chars += n_chars * in_link
            else:
                tags += k.tag == "a" or k.tag not in H.INLINE
                link_tags += k.tag == "a"
                todo.append((k, in_link or k.tag == "a"))
    if not chars:
        return 0.0, 0, 0
    inner = chars / max(1, chars - link_chars) * link_chars + share * chars + math.e
    d = chars / max(1, tags) * math.log(1 + chars * max(1, tags) / max(1, link_chars) / max(1, link_tags)) / max(1, math.log(math.log(inner)))
    return d, chars, link_chars


def test_densities_equal_a_plain_version_and_choose_the_node(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        root = H.parse(r["html"])
        H.prune(root)
        body = next(n for n in H.walk(root) if n.tag == "body")
        _, chars, linked = plain_density(body, 0)
        inside = H.weigh(body, names=False)
        H.densities(inside, body)
        blocks = [n for n in inside if n.tag not in H.INLINE]
        want = {id(n): plain_density(n, linked / chars)[0] for n in inside}
        sums = {id(n): sum(want[id(k)] for k in n.kids if not isinstance(k, str) and k.tag not in H.INLINE) or want[id(n)] for n in blocks}
        for n in blocks:
            assert n.density == pytest.approx(want[id(n)]) and n.total == pytest.approx(sums[id(n)])
        best = max(blocks, key=lambda n: sums[id(n)])
        text = H.text_of(best)
        assert text and text in H.main_text(r["html"], names=False)


def want_of(page):
    part = re.search(r"<article>(.*)</article>", page, re.S)[1]
    part = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", part))
    return re.sub(r"\s+", " ", html.unescape(part)).strip()


def test_density_decides_without_names(spark, sf_dir, monkeypatch):
    """Tags, classes and ids tell nothing here; all but a few pages of very short text give the same result."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").collect()]
    bare = [re.sub(r"(</?)(?:article|nav|footer)", r"\1div", re.sub(' class="ad"', "", p)) for p in pages]
    assert sum(H.main_text(b) == want_of(p) for b, p in zip(bare, pages)) >= 0.92 * len(pages)
    true = H.density
    monkeypatch.setattr(H, "density", lambda *a: -true(*a))
    assert not any(H.main_text(p) == want_of(p) for p in pages)
    monkeypatch.setattr(H, "density", lambda *a: 1 / true(*a) if a[0] else 0.0)
    assert sum(H.main_text(b) == want_of(p) for b, p in zip(bare, pages)) < 0.5 * len(pages)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div>{MENU}</div><div><h2>Head</h2>{BODY}</div><div>All rights are ours.</div>",
        f"<body><div><div>{MENU}</div><div><div><h2>Head</h2>{BODY}</div></div></div><div><p>Buy now</p></div>",
        f"<body><section>{MENU}</section><h2>Head</h2><section>{BODY}</section><section>{MENU}<p>us</p></section>",
    ],
)
def test_pages_without_telling_names(page):
    assert H.main_text(page) == H.main_text(page, names=False) == "Head " + TEXT


def test_equals_the_article_on_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = collected(H.extract(pages))
    assert len(got) == len(raw)
    for r in got:
        want = want_of(raw[r["page_id"]])
        assert r["text"] == want and r["n_chars"] == len(want)


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in collected(H.extract(df))) == [("1", "", 0), ("1", "", 0), ("2", "", 0), ("None", "a", 1)]
    assert H.extract(df.limit(0)).count() == 0
