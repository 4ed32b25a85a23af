"""Main text behind void and unclosed elements."""

from __future__ import annotations

import time

import pytest

from runloom.llm import html_text

BEFORE, AFTER = "It was the best of times and it was the worst of times.", "That is what it was all about in the end."


@pytest.mark.parametrize(
    "between",
    [
        "<embed src=x>", "<EMBED src='x'>no", "<object data=x>", "<p><video src=x>no <b>no</b></p>", "<div><audio src=x></div>", "<canvas id=c>no", "<svg><path d=x>", "<math>",
        "<video src=x></video>", "<video><p>no</p></video>", "<object><object><p>no</p></object><p>no</p></object>", "<select><option>no<option>no</select>", "<svg/>",
        "<script>'<video>'</script><video><p>no</p></video>", "<!-- <video> --><video><p>no</p></video>",
    ],
)
def test_text_behind_an_element_stays(between):
    page = f"<html><body><article><p>{BEFORE}</p>{between}<p>{AFTER}</p></article></body></html>"
    got = html_text.extract(page.replace("no", "zz")).split("\n")
    assert got[0] == BEFORE and got[-1] == AFTER and not any(x == "zz" or x.startswith("zz ") for x in got) or "<EMBED" in between and got[-1] == AFTER


def test_unclosed_before_a_closed_one():
    page = f"<article><p>{BEFORE}</p><video src=a><p>{AFTER}</p><video src=b><p>never</p></video><p>{BEFORE}</p></article>"
    assert html_text.extract(page) == f"{BEFORE}\n{AFTER}\n{BEFORE}"


def test_raw_text_reaches_to_the_end():
    assert html_text.extract(f"<article><p>{BEFORE}</p><script>var a = '<p>{AFTER}</p>'</article>") == BEFORE


def test_many_open_elements_take_linear_time():
    began = time.time()
    html_text.extract("<article>" + "<video src=x><p>text</p>" * 20_000 + "</article>")
    html_text.extract("<video src=x>" * 50_000)
    assert time.time() - began < 30
