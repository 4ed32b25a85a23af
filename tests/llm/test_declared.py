"""Declared languages of pages, wherever the html element begins."""

from __future__ import annotations

from runloom.llm import langid


def test_declared_language_behind_long_beginnings(spark):
    long = "x" * 10_000
    pages = {
        1: (f"<!-- {long} --><html lang=de>", "de"),
        2: (" " * 10_000 + "<HTML class=a LANG='fr-CA'>", "fr"),
        3: (f'<!-- <html lang="en"> {long} --><html lang="es"><p>', "es"),
        4: ("<!--[if IE]><html lang=en><![endif]--><!--[if !IE]><!--><html lang=it><!--<![endif]-->", "it"),
        5: ("<!--x-->" * 20_000 + "<html lang=nl>", "nl"),
        6: ("<html><p>&lt;html lang=en></p><iframe srcdoc=''><html lang=en>", ""),
        7: (f"<!-- {long} <html lang=en>", ""),
        8: ("<!--><html lang=pt>", "pt"),
        9: ("<html lang=en>", "en"),
        10: ("", ""),
        11: ("<!-- " * 50_000 + "<html lang=en>", ""),
    }
    frame = spark.createDataFrame([(k, h) for k, (h, _) in pages.items()], "page_id int, html string")
    declared = langid.page_columns("html")[0]
    assert dict(frame.select("page_id", declared).collect()) == {k: x for k, (_, x) in pages.items()}
