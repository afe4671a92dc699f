"""The extractor on layouts and names that its training pages do not make."""

from collections import Counter

import pytest

from quillgraph.llm import html_extract as H


@pytest.fixture(scope="module")
def model():
    return H.fit()


PARAGRAPHS = """The council met on Tuesday to discuss the new bridge, which has been planned for years.
Residents, many of whom had travelled far, filled the hall; some stood outside in the rain.
“We need it”, said one of them. The mayor agreed, but asked for patience.
Short line.
A second hearing is set for March 3, and the engineers will present their figures then, with costs of about 4.5 million.
Others doubt it. They point to the old ferry, to the school, and to the empty shops along the quay.
In the end the vote was put off until the summer.""".split("\n")
HEAD = '<header class="masthead"><div class="logo">The Daily Example</div><nav class="main-nav"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav></header>'
FOOT = '<footer class="site-footer"><p>© 2021 Example Media. All rights reserved.</p><ul><li><a href="/p">Privacy</a></li><li><a href="/t">Terms</a></li></ul></footer>'
SIDE = '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One story about a cat</a></li><li><a href="/2">Another about dogs</a></li><li><a href="/3">Third</a></li></ul></aside>'
AD = '<div class="advertisement"><p>Buy now and save ten percent.</p></div>'
COOKIE = '<div class="cookie-consent"><p>We use cookies to improve your experience.</p><button>Accept</button></div>'
COMMENTS = '<section class="comments"><h3>Comments</h3><div class="comment"><p>First! Great read, thank you so much for it.</p></div><div class="comment"><p>I do not agree with this at all, and the writer should know better.</p></div></section>'
NAMES = (
    "post-body entry-body story-body content-body mw-body body article-body post-content article__body banner-story main-nav-page td-post-content l-article prose rich-text ArticleBody_root__x2 field-item zn-body caas-body "
    "StoryBodyCompanionColumn column-primary node__content c-entry-content available-content markup main-column page-body hero-story text-block xyz sidebar-layout-main header-article ad-free-content widget-text-content "
    "share-story top-story-body article-main blog-main site-main single-post-main news-main"
).split()


def page(k, name):
    """A page of the k-th layout, and its blocks."""
    want = [f"Title {k} of the story", *(f"{PARAGRAPHS[(i * 3 + k) % 7]} ({k}.{i})" for i in range((5, 3, 8, 12)[k % 4]))]
    inner = f"<h1>{want[0]}</h1>" + "".join(f"<p>{p}</p>" for p in want[1:])
    if k % 5 == 1:
        inner = inner.replace("</p>", "</p>" + AD, 1)
    if k % 5 == 2:
        want += ["First point of three.", "Second point, a bit longer than that."]
        inner += f"<ul><li>{want[-2]}</li><li>{want[-1]}</li></ul>"
    if k % 5 == 3:
        want += ["What comes next", "Nobody knows, but the plans are open to all at the town hall."]
        inner += f"<h2>{want[-2]}</h2><p>{want[-1]}</p>"
    tag = ("div", "section", "div", "article", "div", "main")[k % 6]
    own = f'<{tag} class="{name}">{inner}</{tag}>'
    own = (own, f'<div class="container"><div class="row">{own}{SIDE}</div></div>', f'<div id="content-wrapper">{own}{COMMENTS}</div>')[k % 3]
    return f"<html><head><title>x</title></head><body>{COOKIE if k % 2 else ''}{HEAD}{own}{AD if k % 4 == 0 else ''}{FOOT}</body></html>", want


def test_blocks_of_outside_layouts_come_back(model):
    found = kept = right = 0
    for k, name in enumerate(NAMES):
        html, want = page(k, name)
        got = Counter(b for b in H.main_text(html, model).split("\n\n") if b)
        right += sum((got & Counter(want)).values())
        found, kept = found + len(want), kept + sum(got.values())
    assert len(NAMES) > 40
    assert right / found >= 0.98 and right / kept >= 0.98


@pytest.mark.parametrize("name", ["post-body", "entry-body", "story-body", "content-body", "mw-body", "body", "article-body", "post-content", "article__body", "banner-story", "main-nav-page"])
def test_no_word_of_a_name_loses_an_article(model, name):
    paragraphs = "".join(f"<p>Paragraph number {i} says something of interest, at some length, about the matter. It goes on for a second sentence.</p>" for i in range(5))
    html = f"<html><body><header><h1>Site</h1></header><div class={name}><h1>T</h1>{paragraphs}</div><footer><p>Copyright somebody.</p></footer></body></html>"
    text = H.main_text(html, model)
    assert text.count("Paragraph number") == 5
    assert "Copyright" not in text


def test_given_pages_are_the_text_below_their_article(spark, model):
    def below(node, inside, out):
        inside = inside or node.tag == "article"
        if node.parts and inside:
            out.append(node.parts[0])
        for child in node.children:
            below(child, inside, out)
        return out

    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert H.main_texts(pages, model) == ["\n\n".join(below(H.parse(p), False, [])) for p in pages]
