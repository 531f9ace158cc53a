"""Main text of hosts whose articles have parts, and of hosts where most pages are copies."""

import pytest

from loftline.llm import pages


def texts(spark, htmls):
    rows = [(i, f"http://host.org/{i}", h) for i, h in enumerate(htmls)]
    return {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def words(i, n, mark="w"):
    return " ".join(f"{mark}{i}x{k}" for k in range(n))


@pytest.mark.parametrize("outer", ["article", "div class='wrap'"])
def test_parts_beside_the_largest_container_stay(spark, outer):
    """A short lead, and a list on one page only, beside nearly all the text."""
    want, htmls = {}, []
    for i in range(12):
        lead, body, item = words(i, 4, "lead"), words(i, 80), words(i, 3, "item")
        more = f"<ul class='points'><li>{item}</ul>" if i == 5 else ""
        htmls.append(f"<body><nav>menu</nav><{outer}><section class='lead'><p>{lead}</p></section><section class='body'><p>{body}</p></section>{more}</{outer.split()[0]}>")
        want[i] = "\n".join([lead, body] + [item] * (i == 5))
    assert texts(spark, htmls) == want


def test_copies_of_a_page_are_no_template(spark):
    """Most pages of a host are one page; the others share its frame."""
    frame = "<body><div class='top'>Follow our channel</div><div class='c'><p>{}</p><p>{}</p></div><div class='end'>All rights kept</div>"
    bodies = [(words(0, 40), words(100, 40))] * 20 + [(words(i, 40), words(100 + i, 40)) for i in range(1, 13)]
    assert texts(spark, [frame.format(a, b) for a, b in bodies]) == {i: f"{a}\n{b}" for i, (a, b) in enumerate(bodies)}


def test_pages_of_template_runs_alone_keep_them(spark):
    """Pages of equal text and different html: nothing would be left without the template's runs."""
    got = texts(spark, [f"<body><!-- {i} --><div class='c'><p>One notice for all</p></div>" for i in range(12)])
    assert set(got.values()) == {"One notice for all"}
