"""Spelling variants: words one edit apart, by range searches in k-d trees over letter counts.

One edit changes few letter counts: a replaced letter takes one from a count and adds one to another, an inserted
letter adds one. Two words that are one edit apart are thus at an L1 distance of at most two, and a search needs to
visit only the boxes of a tree that a word reaches by one step down and one step up. Every pair of equal lengths,
and of a length with the next, is one search; what the boxes leave is verified letter by letter.

Words are dealt by an upper tree, fitted on a bounded sample and applied to all of them: a word lies in one
cell and is looked up in every cell that its steps reach. Cells are counted, and large ones are cut into tiles
of bounded size, so a length, a cell or a set of anagrams of any size is spread over tasks. A tile tells
for each word how many near ones it holds and which is the best, never the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed, hashed_sample

#: Words have at least so many code points and occurrences; one deleted letter in so many runs.
LEAST_LENGTH, LEAST_COUNT, DELETE_EVERY = 5, 3, 97
#: Words of a tile that are searched, words that are looked up in them, words of a leaf, and letters of either side of a tile.
CELL, LOOKED_UP, LEAF, TILE_LETTERS = 32768, 65536, 16, 1 << 22
#: Words that the upper trees are fitted on at most, and about how many of them per cell.
SAMPLE, PER_CELL = 1 << 18, 48
#: Words that are looked up at a time, and letters that are compared at a time.
CHUNK, LETTERS = 512, 1 << 24

#: Words that a task counts before it passes them on.
HELD = 1 << 18

_SPAN = re.compile(rb"[a-z\x80-\xff]+")
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # UTF-8 of a-z and U+00C0-U+00FF
#: Letters after lower-casing, by code point: a-z and 0xC0-0xFF.
_PLACE = np.full(256, -1, np.int64)
_PLACE[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = np.arange(26 + 64)
PLACES = 26 + 64


def runs(text: str) -> list[bytes]:
    """Runs of letters, lower-cased in A-Z, in UTF-8."""
    out = []
    for span in _SPAN.findall(text.encode().lower()):  # bytes are lower-cased in A-Z alone
        if span.isascii():
            out.append(span)
        else:
            out += _RUN.findall(span)
    return out


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """``word, n``: the words of whole texts that occur at least ``least_count`` times, with their number.

    Runs of A-Z, a-z and U+00C0-U+00FF are lower-cased in A-Z. With h the CRC-32 of ``<id>:<run>``, a run loses
    the letter at ``h % length`` where ``delete_every`` divides h. A null text has no runs, a null id stands as an
    empty one. Tasks sum up what they read, up to ``HELD`` words at a time, before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = runs(text)
                h = np.fromiter(map(zlib.crc32, found, repeat(zlib.crc32(f"{'' if name is None else name}:".encode()))), np.int64, len(found))
                for i in np.flatnonzero(h % delete_every == 0).tolist():
                    w = found[i].decode()
                    at = int(h[i]) % len(w)
                    found[i] = (w[:at] + w[at + 1 :]).encode()
                held.update(found)
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").where(F.length("word") >= least_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# trees


def letters(rows: list[str], width: int) -> np.ndarray:
    """Code points of words, one row each, padded with zeros to ``width``."""
    flat = np.zeros((len(rows), width), np.uint8)
    for i, w in enumerate(rows):
        b = w.encode("latin-1")
        flat[i, : len(b)] = np.frombuffer(b, np.uint8)
    return flat


def counts(points: np.ndarray) -> np.ndarray:
    """How often each letter stands in each word."""
    out = np.zeros((len(points), PLACES), np.int16 if points.shape[1] < 1 << 15 else np.int32)
    place = _PLACE[points]
    row = np.broadcast_to(np.arange(len(points))[:, None], place.shape)
    known = place >= 0
    np.add.at(out, (row[known], place[known]), 1)
    return out


def parities(x: np.ndarray) -> np.ndarray:
    """One bit per letter, set if its count is odd. Every step up or down of another letter changes one bit."""
    bits = np.packbits(np.pad(x & 1, ((0, 0), (0, 128 - PLACES))).astype(np.uint8), axis=1)
    return bits.view(np.uint64)


class Tree:
    """A k-d tree: inner nodes with a letter and a cut (left: counts up to it), leaves with rows of the words it was built on."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.letter, self.cut, self.left, self.right, self.rows = [], [], [], [], []
        self.leaves = 0
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.letter)
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            letter, cut = self._split(x[rows]) if len(rows) > leaf else (-1, 0)
            for column, value in ((self.letter, letter), (self.cut, cut), (self.left, -1), (self.right, -1), (self.rows, rows)):
                column.append(value)
            if letter < 0:
                self.left[node] = self.leaves  # a leaf's number
                self.leaves += 1
                continue
            low = x[rows, letter] <= cut
            todo += [(rows[~low], node, 1), (rows[low], node, 0)]
            self.rows[node] = None
        self.letter, self.cut, self.left, self.right = (np.array(c, np.int64) for c in (self.letter, self.cut, self.left, self.right))

    @staticmethod
    def _split(x: np.ndarray) -> tuple[int, int]:
        """The letter and count that halve the words best; (-1, 0) if all are anagrams."""
        best, found = 0, (-1, 0)
        low, high = x.min(0), x.max(0)
        for step in range(4):  # beyond the fourth count of a letter its middle is tried
            cut = low + step
            smaller = (x <= cut).sum(0)
            smaller = np.where(cut < high, np.minimum(smaller, len(x) - smaller), 0)
            i = int(np.argmax(smaller))
            if smaller[i] > best:
                best, found = int(smaller[i]), (i, int(cut[i]))
        i = int(np.argmax(high - low))
        if high[i] - low[i] > 4:
            middle = int(np.median(x[:, i]))
            middle = middle if middle < high[i] else middle - 1
            n = int((x[:, i] <= middle).sum())
            if min(n, len(x) - n) > best:
                found = (i, middle)
        return found

    def search(self, q: np.ndarray, down: int, up: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, node of a leaf) for all leaves whose boxes a word reaches by at most ``down`` steps down and ``up`` up (0 or 1).

        A step down of one letter serves all cuts of that letter, and a letter that goes up doesn't go down.
        """
        word, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        fell = np.full(len(q), -1 if down else -2)  # the letter that went down; -2: none may
        rose = np.full(len(q), -1 if up else -2)
        out_word, out_node = [], []
        while len(word):
            letter = self.letter[node]
            leaf = letter < 0
            out_word.append(word[leaf])
            out_node.append(node[leaf])
            word, node, fell, rose, letter = (c[~leaf] for c in (word, node, fell, rose, letter))
            have, cut = q[word, letter], self.cut[node]
            is_low = have <= cut
            falls = (have - cut == 1) & ((fell == -1) | (fell == letter)) & (rose != letter)
            rises = (cut + 1 - have == 1) & ((rose == -1) | (rose == letter)) & (fell != letter)
            to_left, to_right = is_low | falls, ~is_low | rises
            word, node, fell, rose = (
                np.concatenate(c)
                for c in (
                    (word[to_left], word[to_right]),
                    (self.left[node][to_left], self.right[node][to_right]),
                    (np.where(is_low, fell, letter)[to_left], fell[to_right]),
                    (rose[to_left], np.where(is_low, letter, rose)[to_right]),
                )
            )
        return np.concatenate(out_word or [word]), np.concatenate(out_node or [node])


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in one place."""
    return (a != b).sum(1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a row of ``b``, one longer, is the row of ``a`` with one letter inserted."""
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


def near_pairs(tree: Tree, x: np.ndarray, points: np.ndarray, q: np.ndarray, q_points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(looked-up word, word of the tree) of pairs one edit apart, in blocks. Looked-up words are as long as the tree's or one shorter."""
    longer = points.shape[1] - q_points.shape[1]
    starts = np.cumsum([0, *(0 if r is None else len(r) for r in tree.rows)])
    flat = np.concatenate([np.zeros(0, np.int64), *(r for r in tree.rows if r is not None)])
    sizes = np.diff(starts)
    odd, q_odd, apart = parities(x), parities(q), 2 - longer
    odd, q_odd, more_odd, more_q_odd = odd[:, 0].copy(), q_odd[:, 0].copy(), odd[:, 1].copy(), q_odd[:, 1].copy()
    block = max(1, LETTERS // points.shape[1])
    for at in range(0, len(q), CHUNK):
        word, node = tree.search(q[at : at + CHUNK], 1 - longer, 1)
        many = sizes[node]
        here = np.repeat(word + at, many)
        there = flat[np.arange(len(here)) + np.repeat(starts[node] - np.cumsum(many) + many, many)]
        close = np.bitwise_count(odd[there] ^ q_odd[here]) <= apart  # more odd letters than steps: too far
        here, there = here[close], there[close]
        close = np.bitwise_count(odd[there] ^ q_odd[here]) + np.bitwise_count(more_odd[there] ^ more_q_odd[here]) == apart
        here, there = here[close], there[close]
        for low in range(0, len(here), block):
            i, j = here[low : low + block], there[low : low + block]
            close = np.abs(x[j] - q[i]).sum(1) == apart
            i, j = i[close], j[close]
            ok = one_inserted(q_points[i], points[j]) if longer else one_replaced(q_points[i], points[j])
            yield i[ok], j[ok]


def _best(of: np.ndarray, near: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of near ones, the one of largest n and then smallest rank) per word of ``of``."""
    order = np.lexsort((rank[near], -n[near], of))
    word, first, many = np.unique(of[order], return_index=True, return_counts=True)
    return word, many, near[order][first]


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """``word, n_near, best, best_n`` for the words of one tile: sums over what stands in it alone."""
    side = pdf["side"].to_numpy()
    data = pdf[side == 0]
    out = []
    if len(data):
        length = len(data["word"].iloc[0])
        w, n = data["word"].to_numpy(object), data["n"].to_numpy()
        points = letters(w, length)
        x = counts(points)
        tree = Tree(x, LEAF)
        for back in (0, 1):
            looked = pdf[(side == 1) & (pdf["len"].to_numpy() == length - back)]
            if not len(looked):
                continue
            qw, qn = looked["word"].to_numpy(object), looked["n"].to_numpy()
            q_points = letters(qw, length - back)
            found = list(near_pairs(tree, x, points, counts(q_points), q_points))
            here, there = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            rank = lambda ws: np.argsort(np.argsort(ws))  # noqa: E731  code points in order
            word, many, best = _best(here, there, n, rank(w))
            out.append(pd.DataFrame({"word": qw[word], "n_near": many, "best": w[best], "best_n": n[best]}))
            if back:  # words of one length look each other up; of two, the shorter the longer
                word, many, best = _best(there, here, qn, rank(qw))
                out.append(pd.DataFrame({"word": w[word], "n_near": many, "best": qw[best], "best_n": qn[best]}))
    return pd.concat(out) if out else pd.DataFrame({"word": [], "n_near": [], "best": [], "best_n": []})


# dealing


def _room(rows: int, length: str) -> Column:
    """How many words of a length a tile takes: ``rows``, or fewer of great length."""
    return F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(TILE_LETTERS) / F.col(length)))).cast("int")


def upper_trees(vocabulary: DataFrame, cell: int = CELL) -> dict[int, Tree]:
    """A tree per length of more words than a tile takes, fitted on a sample of at most about ``SAMPLE`` words in all."""
    crowded = {r.len: (r.many, r.room) for r in vocabulary.groupBy("len").agg(F.count("*").alias("many")).withColumn("room", _room(cell, "len")).where("many > room").collect()}
    if not crowded:
        return {}
    rows = vocabulary.where(F.col("len").isin(list(crowded)))
    total, cells = sum(many for many, _ in crowded.values()), sum(-(-many // room) for many, room in crowded.values())
    sample: dict[int, list[str]] = {}
    for r in hashed_sample(rows, ["word"], min(SAMPLE, cells * PER_CELL), total).select("len", "word").collect():
        sample.setdefault(r.len, []).append(r.word)
    return {n: Tree(counts(letters(ws, n)), max(1, len(ws) * crowded[n][1] // crowded[n][0])) for n, ws in sample.items()}


def _deal(trees: dict[int, Tree]):
    """Every word once as data (side 0) in its cell, and looked up (side 1) in the cells of its length and of the next that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                lens, ws = b.column(0).to_numpy(), b.column(1).to_pylist()
                for n in np.unique(lens).tolist():
                    own = np.flatnonzero(lens == n)
                    x = counts(letters([ws[i] for i in own], n)) if trees.keys() & {n, n + 1} else None
                    parts = []
                    for side, into, down, up in ((0, n, 0, 0), (1, n, 1, 1), (1, n + 1, 0, 1)):
                        t = trees.get(into)
                        word, node = t.search(x, down, up) if t else (np.arange(len(own)), None)
                        parts.append((own[word], t.left[node] if t else np.zeros(len(word), np.int64), np.full(len(word), into), np.full(len(word), side)))
                    row, cells, into, side = (np.concatenate(c) for c in zip(*parts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(into, pa.int32()), pa.array(cells, pa.int32()), pa.array(side, pa.int8()), *b.take(pa.array(row)).columns], names=["into", "cell", "side", "len", "word", "n"]
                    )

    return run


def near_words(vocabulary: DataFrame, cell: int = CELL, looked_up: int = LOOKED_UP) -> DataFrame:
    """``word, n_near, best, best_n`` for every word of ``vocabulary`` (distinct ``word``, ``n``) that has a near one."""
    rows = vocabulary.select(F.length("word").alias("len"), "word", "n")
    dealt = rows.mapInArrow(_deal(upper_trees(rows, cell)), "into int, cell int, side byte, len int, word string, n long")
    dealt = checkpointed(dealt)
    size = dealt.groupBy("into", "cell").agg(F.count_if(F.col("side") == 0).alias("have"), F.count_if(F.col("side") == 1).alias("seek")).where("have > 0 AND seek > 0")
    tiles = size.select("into", "cell", F.ceil(F.col("have") / _room(cell, "into")).cast("int").alias("a_tiles"), F.ceil(F.col("seek") / _room(looked_up, "into")).cast("int").alias("b_tiles"))
    tiles = tiles.repartition("into", "cell", "a_tiles")  # so that the join can split a crowded cell
    at = lambda many: F.pmod(F.xxhash64("word"), F.col(many)).cast("int")
    every = lambda many: F.sequence(F.lit(0), F.col(many) - 1)
    own = F.col("side") == 0
    dealt = dealt.join(tiles, ["into", "cell"])
    dealt = dealt.withColumn("a", F.explode(F.when(own, F.array(at("a_tiles"))).otherwise(every("a_tiles"))))
    dealt = dealt.withColumn("b", F.explode(F.when(own, every("b_tiles")).otherwise(F.array(at("b_tiles")))))
    found = dealt.select("into", "cell", "a", "b", "side", "len", "word", "n").groupBy("into", "cell", "a", "b").applyInPandas(_tile, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("rank"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.rank")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: each step doubles how far a word has followed; n doubles with every form, so few are needed."""
    up = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = checkpointed(up.select("word", "root").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            return up.select("word", "root")


def group(vocabulary: DataFrame, cell: int = CELL, looked_up: int = LOOKED_UP) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``vocabulary`` (``word``, ``n``).

    Words are near if one inserted, deleted or replaced code point makes one the other. ``form`` is the near word of
    largest n (ties: the first in code-point order) if that is at least twice the word's own, else null, ``root``
    the last that is reached from form to form, the word itself if it has no form. Words are of the letters that
    :func:`words` gives; null ones are left out, repeated ones count as one with the sum of their n.
    """
    rows = checkpointed(vocabulary.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    near = rows.join(near_words(rows, cell, looked_up), "word", "left")
    has = F.col("best_n") >= 2 * F.col("n")
    near = checkpointed(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    roots = _roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
