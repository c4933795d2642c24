"""Main text against a plain reading of every page of the table, and what ratios, thresholds and broken markup do."""

from __future__ import annotations

import html as entities
import re
import time

import pyarrow.parquet as pq
import pytest

queries = pytest.importorskip("sparkloom.llm.queries")
from sparkloom.llm import main_text as module  # noqa: E402
from sparkloom.llm.main_text import ended, main_text  # noqa: E402

from .test_against_brute_force import SF_DIR  # noqa: E402


def pages():
    return pq.read_table(f"{SF_DIR}/pages.parquet").to_pylist()


def plain(html):
    """These pages have one article, with headings, paragraphs, lists and line breaks, and notes in it that are no text."""
    inner = re.search(r"<article[^>]*>(.*)</article>", html, re.DOTALL)[1]
    inner = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav|header|footer)\b.*?</\1>", "", inner, flags=re.DOTALL)
    inner = re.sub(r"<br\s*/?>", " ", inner)
    parts = re.split(r"</?(?:p|h\d|ul|ol|li|div|blockquote|section|table|tr|td|pre)\b[^>]*>", inner)
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_whole_table(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op6_main_text(spark, SF_DIR).collect()}
    assert got == {p["page_id"]: (p["url"], plain(p["html"]), len(plain(p["html"]))) for p in pages()}


def test_ratios_decide(monkeypatch):
    before = [main_text(p["html"]) for p in pages()]
    monkeypatch.setattr(module, "smoothed", lambda values: [0.0] * len(values))
    assert all(main_text(p["html"]) != b for p, b in zip(pages(), before, strict=True))


def test_markup_that_never_ends_is_no_text():
    page = "<p>real text here</p>"
    for rest in ("<!-- never closed <p>hidden</p>", "<p class=\"x", "<a href=", "<!doctype", "<?php echo", "</p", "<script>var a = '<p>x</p>'", "<![CDATA[ x"):
        assert main_text(page + rest) == "real text here"
    assert main_text(page + "<!--> <p>more text</p>") == "real text here\n\nmore text"
    assert main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert ended("<script><!-- x </script><p>a</p>") == "<script><!-- x </script><p>a</p>"


@pytest.mark.parametrize("part", ["<!--", "<a ", "<!", "<?", "</", "&", "<", "<![CDATA[", "<p class=\"", "<!-- x <p>hidden</p>", "<p>text <b>of</b> some words</p>", "<div><nav>a</nav>b"])
def test_time_in_proportion_to_the_page(part):
    page = "<p>real text here</p>" + part * (1_000_000 // len(part))
    began = time.perf_counter()
    main_text(page)
    one = time.perf_counter() - began
    began = time.perf_counter()
    main_text(page[: len(page) // 4])
    assert one < 8 * (time.perf_counter() - began) + 2
