"""Constant texts among more equal siblings than a skeleton has slots for."""

import random

import pytest

from imgaudit.llm import html_extract

RNG = random.Random(31)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(3, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def texts(spark, pages):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.page_texts(df.repartition(3)).collect()}


def test_forty_equal_lines_leave_the_varying_one(spark):
    lines = [f"Line {k} {prose(4)}" for k in range(40)]
    own = [prose(60) for _ in range(12)]
    for at in (0, 20, 40):  # before, among and after the lines
        pages = []
        for t in own:
            some = [f"<p>{x}</p>" for x in lines]
            some.insert(at, f"<p>{t}</p>")
            pages.append(f"<html><body><div>{''.join(some)}</div></body></html>")
        assert texts(spark, pages) == dict(enumerate(own)), at


def test_long_articles_keep_all_paragraphs(spark):
    """Paragraphs of which every page has its own stay, however many; a nested block that all pages have goes."""
    own = [[prose(12) for _ in range(50 + k)] for k in range(8)]
    pages = []
    for paragraphs in own:
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        pages.append(f"<html><body><div class='x'>{body}<p>All rights belong to their owners.</p></div></body></html>")
    assert texts(spark, pages) == {k: " ".join(p) for k, p in enumerate(own)}


def test_a_text_of_few_pages_is_no_template(spark):
    """A line that half of a host's pages share is content of these."""
    pages, want = [], {}
    for k in range(10):
        paragraphs = [prose(10) for _ in range(40)] + (["Shared by some of the pages here"] if k % 2 else [])
        pages.append("<html><body><div>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</div></body></html>")
        want[k] = " ".join(paragraphs)
    assert texts(spark, pages) == want


@pytest.mark.parametrize("n", [1, 4])
def test_few_pages_have_no_loose_template(spark, n):
    pages = ["<html><body><div>" + "".join(f"<p>same {k}</p>" for k in range(50)) + f"<p>{prose(20)}</p></div></body></html>" for _ in range(n)]
    assert all(t.startswith("same 0 same 1") for t in texts(spark, pages).values())
