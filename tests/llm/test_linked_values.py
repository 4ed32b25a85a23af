"""Pseudonyms of one value however it is written, and main text of pages in any script."""

from __future__ import annotations

import time
from datetime import date

import pytest

from runloom.llm import html_text, pii

KEY = b"a key of the tests"


def new(t: str) -> str:
    return pii.pseudonymise(t, KEY)[0]


def test_one_day_in_every_form():
    for day in (date(2020, 1, 2), date(1999, 12, 31), date(2000, 2, 29), date(1850, 3, 4), date(2999, 12, 31), date(1000, 1, 1)):
        y, m, d = day.year, day.month, day.day
        images = {
            date(*map(int, new(f"{y:04}-{m:02}-{d:02}").split("-"))), date(*map(int, new(f"{y:04}/{m:02}/{d:02}").split("/"))), date(*map(int, new(f"{y:04}.{m}.{d}").split("."))), date(*map(int, new(f"{d:02}.{m:02}.{y:04}").split(".")[::-1])),
        }
        name = pii._MONTHS[m - 1]
        for t in (f"{d} {name} {y}", f"{d} {name[:3]} {y}"):
            a, b, c = new(t).split()
            images.add(date(int(c), next(i for i, x in enumerate(pii._MONTHS, 1) if x.startswith(b)), int(a)))
        assert len(images) == 1 and day not in images
        assert (1900 <= y < 2100) == (1900 <= images.pop().year < 2100)
    a, b = new("02/03/2001"), new("02-03-2001")
    assert a.replace("/", "-") == b != "02-03-2001"
    assert new("0999-01-01 3000-01-01 2001-02-29") == "0999-01-01 3000-01-01 2001-02-29"


@pytest.mark.parametrize("far", ["", "far"])
@pytest.mark.parametrize("numeric", [False, True])
def test_dates_move_one_to_one(far, numeric):
    years = (pii._FAR if far else pii._NEAR)[:: 37 if far else 7]
    from calendar import isleap

    images = {}
    for y in years:
        for first, second in pii._forms(isleap(y), numeric)[0]:
            to = pii._moved(y, first, second, KEY, numeric)
            assert images.setdefault(to, (y, first, second)) == (y, first, second)
            assert to[1:] in pii._forms(isleap(to[0]), numeric)[1] and (to[0] in pii._NEAR) == (not far)


def test_addresses_in_other_alphabets():
    for local in ("josé", "Иван.Петров", "müller-Ö7", "x", "ÑandÚ"):
        image = new(f"to {local}@x.example.com!")
        got = image[3 : 3 + len(local)]
        assert image.endswith("@x.example.com!") and len(image) == len(local) + 18
        assert [c.isupper() for c in got] == [c.isupper() for c in local] and [c.isalpha() for c in got] == [c.isalpha() for c in local]
        assert new(f"{local}@x.example.com") == image[3:-1]
    assert new("联系我a@x.com").startswith("联系我") and len(pii.pseudonymise("联系我a@x.com", KEY)[1]) == 1
    twos = [a + b for a in "àáâãäåæçèé" for b in "îïðñòóôõöø"]
    assert len({new(f"{t}@x.com") for t in twos}) == len(twos)


TEXTS = {
    "ru": "Съешь же ещё этих мягких французских булок, да выпей чаю, пока он не остыл. " * 6,
    "zh": "这是一个关于天气的故事，人们都说今天会下雨，但是太阳出来了。" * 6,
    "ar": "هذه قصة عن الطقس يقول الناس إن المطر سيهطل اليوم لكن الشمس أشرقت. " * 5,
    "tr": "Yağmurlu günlerde insanlar evlerine dönerken sokaklarda kimse kalmıyor, kuşlar susuyor. " * 5,
    "en": "It was the best of times and it was the worst of times for all of us in the city. " * 5,
}


@pytest.mark.parametrize("lang", TEXTS)
def test_articles_in_any_language(lang):
    t = TEXTS[lang].strip()
    page = (
        f"<html><body><nav><a href='/'>{t[:30]}</a></nav><div class='sidebar'>{t}</div><div><h2>{t[:20]}</h2><p>{t}</p><p>{t}</p></div>"
        f"<p><a href='x'>{t}</a></p><form>{t}</form><div class='comments'>{t}</div><footer>{t[:60]}</footer></body></html>"
    )
    assert html_text.extract(page) == f"{t[:20].strip()}\n{t}\n{t}"


def test_a_block_without_stop_words_goes_from_a_page_that_has_them():
    names = "Alpha Beta Gamma Delta Epsilon Zeta Omega Lambda Sigma Kappa " * 6
    assert html_text.extract(f"<div><p>{TEXTS['en']}</p><p>{names}</p></div>") == TEXTS["en"].strip()


def test_long_attributes_and_open_elements_take_linear_time():
    begun = time.perf_counter()
    for page in ("<p " + "a" * 1_000_000 + ">x</p>", "<p " + "a b-c:d " * 100_000 + ">x</p>", "<svg>" + "<a><b></b>" * 50_000 + "x", "<svg>" + "<g></g>" * 100_000, "<p a=" + '"' * 200_001 + ">x"):
        html_text.extract(page)
    assert time.perf_counter() - begun < 60
