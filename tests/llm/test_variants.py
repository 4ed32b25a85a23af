"""Spelling variants against a comparison of all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from runloom.llm import variants


def plain_words(docs):
    found = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            found[r[: h % len(r)] + r[h % len(r) + 1 :] if h % 97 == 0 else r] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(found):
    near = {w: [v for v in found if one_edit(w, v)] for w in found}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-found[v], v), default=None)
        form[w] = best if best is not None and found[best] >= 2 * found[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), found[w], len(near[w]), found[form[w]] if form[w] else 0) for w in found)


def got_groups(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def some_words(rng, many, letters="abcdeé", low=5, high=8):
    out = {}
    while len(out) < many:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
        for v in (w, w[:2] + rng.choice(letters) + w[3:], w[:1] + rng.choice(letters) + w[1:], "".join(rng.sample(w, len(w)))):
            if low <= len(v):
                out[v] = rng.choice([3, 4, 6, 7, 12, 13, 24, 50, 100])
    return out


def docs_frame(spark, rows):
    """Rows with columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "w", k, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, word string, n long, len long, id string")


def test_words_of_whole_texts(spark):
    rng = random.Random(2)
    pool = ["Straße", "ÜBERALL", "überall", "größer", "naïve", "x×y÷z", "abcde", "ABCDE", "…dots…", "日本tokyo語", "Łódź", "pre-fix", "don't", "a" * 300]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(120)] + [(None, "nobody nobody nobody"), (500, None), (501, ""), (502, "123 ... "), (503, "lengthy " * 40_000), (503, "lengthy " * 3)]
    got = {r.word: r.n for r in variants.words(docs_frame(spark, docs)).collect()}
    assert got == plain_words(docs) and "lengthy" in got and any("Ü" in w for w in got)


@pytest.mark.parametrize("cell, looked_up", [(variants.CELL, variants.LOOKED_UP), (40, 50), (7, 9)])
def test_groups_against_all_pairs(spark, cell, looked_up):
    found = some_words(random.Random(3), 500)
    got = variants.group(spark.createDataFrame(list(found.items()), "word string, n long"), cell, looked_up)
    assert got_groups(got) == plain_groups(found)


def test_anagrams_of_one_set_of_letters_and_long_words(spark):
    rng = random.Random(4)
    found = {"".join(rng.sample("aabbccdd", 8)): rng.choice([3, 9]) for _ in range(150)}
    found |= {"z" * k: 3 + k for k in (200, 201, 202, 70_000, 70_001)} | {"z" * 100 + "y" + "z" * 100: 900}
    got = variants.group(spark.createDataFrame(list(found.items()), "word string, n long"), 10, 10)
    assert got_groups(got) == plain_groups(found)


def test_ties_chains_repeats_and_nothing(spark):
    found = {"chainaaaa": 3, "chainbaaa": 6, "chainbbaa": 12, "chainbbba": 24, "chainbbbb": 48, "tiesx": 5, "tiesa": 10, "tiesb": 10, "lonely": 4}
    rows = [*found.items(), (None, 7)]
    rows = [r for r in rows if r[0] != "tiesx"] + [("tiesx", 2), ("tiesx", 3)]
    got = got_groups(variants.group(spark.createDataFrame(rows, "word string, n long")))
    assert got == plain_groups(found)
    by = {r[0]: r for r in got}
    assert by["chainaaaa"][2] == "chainbbbb" and by["tiesx"][1] == "tiesa" and by["lonely"] == ("lonely", "", "lonely", 4, 0, 0)
    assert variants.group(variants.words(docs_frame(spark, []))).count() == 0


def test_boxes_reach_every_word_one_edit_away():
    rng = random.Random(6)
    ws = list(some_words(rng, 2000, "abcdefgàé"))
    for n in (5, 6, 7):
        data = [w for w in ws if len(w) == n]
        points = variants.letters(data, n)
        x = variants.counts(points)
        tree = variants.Tree(x, 3)
        assert sorted(np.concatenate([r for r in tree.rows if r is not None]).tolist()) == list(range(len(data)))
        for back in (0, 1):
            looked = [w for w in ws if len(w) == n - back]
            if not looked:
                continue
            q = variants.letters(looked, n - back)
            pairs = {(looked[i], data[j]) for a, b in variants.near_pairs(tree, x, points, variants.counts(q), q) for i, j in zip(a, b)}
            assert pairs == {(a, b) for a in looked for b in data if one_edit(a, b)}
