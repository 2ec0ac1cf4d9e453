"""Operator 2 on small pages."""

import numpy as np
import pytest

from tidewright.llm.dom import parse
from tidewright.llm.wrappers import Reference, extract, host_column, main_text, skeleton

ROBE = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no</article>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/">Menu</a></ul></nav>{}<footer>&copy; foot</footer></body></html>'


def test_article_without_its_surroundings():
    page = ROBE.format(
        '<header>Site</header><div class="ad">buy</div><!-- c --><article><header><h1>Head &amp; tail</h1><span>by A</span></header><p><b>One\n two<br><p>Three&nbsp;four</p><div class="share-box">share</div>'
        "<form><p>mail</p></form><ul><li>x<li>y</ul><aside>side</aside><div style='display: none'>gone</div></article><section id=comments><p>First!</p></section><div class='cookie-notice'>ok?</div>"
    )
    assert main_text(page) == "Head & tail\nOne two\nThree four\nx\ny"


def test_pages_without_an_article():
    assert main_text("<div class=menu><a href=1>a</a></div><div><p>Long text of the page.</p><p>More of it.</p></div><div class=footer>f</div>") == "Long text of the page.\nMore of it."
    assert main_text("plain &lt;text&gt;") == "plain <text>"
    assert main_text("") == main_text(None) == ""


def test_broken_markup_ends():
    for page in ("<p", "<p>a<", "<a href='x>y</a><p>z", "<!-- open", "<script>x", "</p></div>a", "<td>a<td>b", "<article>" * 50 + "deep", '<p class="a>b"c>d</p>'):
        assert isinstance(main_text(page), str)
    assert main_text("<article>" * 50 + "deep") == "deep"


def template_of(pages):
    """All pages of a host aligned with the one given first, in plain Python."""
    reference = Reference(pages[0])
    return reference, np.all([reference.agreed(p) for p in pages], axis=0)


def test_template_is_what_all_pages_share():
    pages = [f"<div class=top>Welcome to the site</div><div class=body><p>Story {i} {'word ' * i}</p></div><div class=end>Impressum</div>" for i in range(1, 6)]
    reference, mask = template_of(pages)
    tree = skeleton(parse(pages[2]))
    constant = reference.constant(tree, mask)
    assert {node.attribute("class")["class"] for node in tree.nodes[0].children() if id(node) in constant} == {"top", "end"}
    assert main_text(pages[2], reference, mask) == "Story 3 word word word"


def test_template_within_a_marked_article():
    page = "<article><h1>Title {0}</h1><p>Share this with friends</p><p>Text {0} of it</p><p>Text {0} more</p><blockquote>Support us</blockquote></article>"
    pages = [page.format(i) for i in range(5)]
    assert main_text(pages[1]) == "Title 1\nShare this with friends\nText 1 of it\nText 1 more\nSupport us"
    assert main_text(pages[1], *template_of(pages)) == "Title 1\nText 1 of it\nText 1 more"
    # pages that repeat one article keep it
    same = [f"<p>{i}</p><article><h1>Same</h1><p>text</p></article>" for i in range(5)]
    assert main_text(same[1], *template_of(same)) == "Same\ntext"


@pytest.mark.parametrize("wide", [2, 128])  # 2: children are aligned by labels alone
def test_tables_against_plain_alignment(spark, monkeypatch, wide):
    from tidewright.llm import wrappers

    def page(host, i):
        extra = "".join(f"<h3>Kicker</h3><p>part {i} {k}</p>" for k in range(i % 4))
        return f"<div class=top>House {host}</div><div class=list><p>fixed</p><p>new {i}</p><p>always</p></div><section><h2>Story {i}</h2>{extra}</section><div class=end>Imprint</div>"

    rows = [(100 * host + i, f"http://h{host}.example/{i}", page(host, i)) for host in range(3) for i in range(7)]
    monkeypatch.setattr(wrappers, "WIDE", wide)
    found = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    if wide == 128:  # workers have the module's own value
        for host in range(3):
            own = [page(host, i) for i in range(7)]
            for i, one in enumerate(own):
                assert found[100 * host + i] == main_text(one, *template_of(own[::-1]))
                assert "Imprint" not in found[100 * host + i] and "always" not in found[100 * host + i]
    own = [page(0, i) for i in range(7)]
    assert "House" not in main_text(own[3], *template_of(own)) and "Story 3\n" in main_text(own[3], *template_of(own))


def test_deep_and_wide_pages_end():
    deep = "<div>" * 100_000 + "<p>deep</p><p>er</p>" + "</div>" * 100_000 + "<p>after</p>"
    assert main_text(deep) == "deep\ner\nafter"
    wide = ["<main>" + "".join(f"<h2>t{i}</h2><p>x{k} {i}</p>" for i in range(25_000)) + "</main>" for k in range(3)]
    text = main_text(wide[1], *template_of(wide))
    assert text.count("\n") == 24_999 and text.startswith("x1 0\nx1 1")
    assert main_text(deep, *template_of([deep, wide[0], deep])) == "deep\ner\nafter"


def test_table(spark):
    shared = "<div class=top>Welcome to the site</div><div class=box><p>{}</p></div><div class=end>Impressum of the house</div>"
    rows = [(i, f"http://a.example/{i}", shared.format(f"Story {i}"), "extra") for i in range(6)]
    # copies on a host of their own are no template; a null url, a null page, a repeated row
    rows += [(10 + i, "http://b.example/x", ROBE.format("<article><h1>Same</h1><p>text</p></article>"), "extra") for i in range(4)]
    rows += [(20, None, "<p>alone</p>", None), (21, "http://a.example/n", None, None), (22, "", "", None), (22, "", "", None), (None, "http://c.example", "<p>no id</p>", "x")]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.text) for r in found.collect()), key=str)
    expect = [(i, f"Story {i}") for i in range(6)] + [(10 + i, "Same\ntext") for i in range(4)] + [(20, "alone"), (21, ""), (22, ""), (22, ""), (None, "no id")]
    assert got == sorted(expect, key=str)
    assert all(r.n_chars == len(r.text) for r in found.collect())
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hosts(spark):
    urls = [("https://user@WWW.Example.org:80/a?b#c", "www.example.org"), (None, ""), ("odd", "odd")]
    assert [r.h for r in spark.createDataFrame(urls, "url string, host string").select(host_column("url").alias("h")).collect()] == [h for _, h in urls]


def test_wrappers_named_after_a_part_are_kept():
    article = "<article class='post comments-open'><div class='post-header'><h1>Title</h1></div><p>The text of the article.</p></article>"
    rest = "<div class=sidebar><p>side</p></div><div id=comments><p>First!</p></div>"
    for wrap in ("<div class='layout has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<div id=page class='has-header'>{}</div>", "<form action=/><input type=hidden>{}</form>", "<div class=sidebar>{}</div>"):
        assert main_text(f"<body>{wrap.format(article)}{rest}</body>") == "Title\nThe text of the article.", wrap
        assert main_text(f"<body>{wrap.format('<div><p>A page that marks no article.</p></div>')}{rest}</body>") == "A page that marks no article.", wrap
    # the head of an article, the one article beside more text than it has, comments longer than the text, teasers beside the text
    assert main_text("<article><div class=header><h1>Title</h1><span>by A</span></div><p>A text of some length.</p></article>") == "Title\nA text of some length."
    assert main_text(f"<div class=header>{article}</div><div class=sidebar><p>{'side ' * 99}</p></div>") == "Title\nThe text of the article."
    assert main_text(f"<main><p>Short</p><div id=comments><p>{'long ' * 99}</p></div></main>") == "Short"
    assert main_text("<div><p>A text of some length.</p></div><div class=related><article>One</article><article>Two</article></div>") == "A text of some length."


def test_every_varying_slot_of_pages_without_an_article():
    def page(i):
        return f"<div>Welcome to the site</div><div><h1>Title {i}</h1><div class=lead>Lead {i}</div><div class=body><div><p>{f'Story {i} ' * 40}</p></div><div>End {i}</div></div></div><div>Impressum</div>"

    def expect(i):
        return "\n".join([f"Title {i}", f"Lead {i}", f"Story {i} " * 39 + f"Story {i}", f"End {i}"])

    assert main_text("<div><h1>T</h1><div class=lead>L</div><div class=body><p>" + "b " * 99 + "</p></div></div>").startswith("T\nL\nb b")
    found = template_of([page(i) for i in range(6)])
    for i in range(6):
        assert main_text(page(i), *found) == expect(i)
