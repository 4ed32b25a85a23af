"""Corpus language model: an Elias-Fano n-gram trie of three orders, sharded by predicted word.

The model is an interpolated trigram with a Dirichlet prior at each order:

    P1(w)       = (c(w) + 1) / (N + V + 1)
    P2(w | v)   = (c(v w) + MU[0] * P1(w)) / (c(v) + MU[0])
    P3(w | u v) = (c(u v w) + MU[1] * P2(w | v)) / (c(u v) + MU[1])

It sums to one over the V known words and one unknown word. The counts of all n-grams that end in w belong to
the shard of w, and the contexts' counts at one token are those of the n-grams that end at the token before;
so one shuffle brings every different trigram of a chunk of texts to the shard of its last word, each shard
looks up the counts of its three orders, and a second shuffle brings them back to the chunk, where the
probabilities are formed. No vocabulary, count table or trie is ever held by the driver or copied to every
executor.

A shard's trie has three levels. Level 1 lists the shard's words; level 2 the words seen before each, level 3
those seen before each such pair, both made monotone by the rank of their parent and Elias-Fano coded. The
pointers from a level to its children are monotone and coded likewise. A node carries its joint probability
c / N as a 16-bit quantised logarithm. Levels lie in memory-mapped files and are never decoded: a query reads
the two pointers of its context and searches the successor between them in the encoded bits.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed

#: Prior weights of the unigram in the bigram, and of that in the trigram.
MU = (100.0, 10.0)
#: Tokens that a task holds at a time, and that a shard gets on average at most. A piece that travels from one
#: chunk to one shard has CHUNK_TOKENS * SHARD_TOKENS / corpus tokens: raise both where executors have memory.
CHUNK_TOKENS, SHARD_TOKENS = 2_000_000, 2_000_000
#: Queries that are looked up at a time.
BLOCK = 1 << 18
#: Words can't hold white space, so these can't be words.
END, BEGIN = b"\n", b"\t"
#: Steps of a quantised logarithm in a decade; a code is 0 where nothing was seen, else 1 for a count of one.
STEPS = 4096


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return (text or b"").lower().split()


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
#: Place of the k-th bit that is 0 (and 1) in a byte, from the left.
_PLACE = [np.array([[*np.flatnonzero([(b >> (7 - i) & 1) == bit for i in range(8)]), *[8] * 8][:8] for b in range(256)]) for bit in (0, 1)]


class EliasFano:
    """A monotone sequence below ``2**63``: low bits packed, high bits in unary, read in place."""

    def __init__(self, values: np.ndarray) -> None:
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        low, packed = values & np.uint64((1 << self.low_bits) - 1), []
        for at in range(0, self.n, 1 << 16):  # a multiple of eight values fills whole bytes
            bits = np.unpackbits(low[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - self.low_bits :]
            packed.append(np.packbits(bits))
        self.low = np.concatenate([*packed, np.zeros(9, np.uint8)])
        ones = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        self.highest = int(ones[-1]) - self.n + 1 if self.n else -1
        unary = np.zeros((int(ones[-1]) // 64 + 1) * 64 if self.n else 64, dtype=np.uint8)
        unary[ones] = 1
        self.high = np.packbits(unary)
        self.before = np.concatenate([[0], np.cumsum(_ONES[self.high].reshape(-1, 8).sum(axis=1))])[:-1]  # ones before each 64 bits

    def mapped(self, path: Path) -> EliasFano:
        """The same sequence with its parts memory-mapped from files."""
        for name in ("low", "high", "before"):
            part = getattr(self, name)
            part.tofile(f := path.with_suffix(f".{name}"))
            setattr(self, name, np.memmap(f, part.dtype, "r"))
        return self

    def _select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """Place of the k-th ``bit``, from 0, in the high part."""
        before = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        block = np.searchsorted(before, k, side="right") - 1
        left = k - before[block]
        word = self.high[block[:, None] * 8 + np.arange(8)]
        ones = _ONES[word]
        till = np.cumsum(ones if bit else 8 - ones, axis=1)
        byte = (till <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left = left - np.where(byte > 0, till[rows, np.maximum(byte, 1) - 1], 0)
        return block * 64 + byte * 8 + _PLACE[bit][word[rows, byte], left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        shift = (at & 7).astype(np.uint64)
        part = self.low[(at >> 3)[:, None] + np.arange(9)]
        head = np.ascontiguousarray(part[:, :8]).view(">u8").ravel().astype(np.uint64)
        return ((head << shift) | (part[:, 8].astype(np.uint64) >> (np.uint64(8) - shift))) >> np.uint64(64 - self.low_bits)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        return ((self._select(1, i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each ``x`` among the values from ``start`` to before ``end``, -1 where it isn't there."""
        out = np.full(len(x), -1, np.int64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        open_ = np.flatnonzero((high <= self.highest) & (start < end))
        if not len(open_):
            return out
        high = high[open_]
        lo = np.where(high > 0, self._select(0, np.maximum(high, 1) - 1) - high + 1, 0)  # values with a smaller high part
        hi = np.full(len(high), self.n)
        inner = high < self.highest
        hi[inner] = self._select(0, high[inner]) - high[inner]
        lo, hi = np.maximum(lo, start[open_]), np.minimum(hi, end[open_])
        want = x[open_] & np.uint64((1 << self.low_bits) - 1)
        top = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < top)
        there = there[self._low(lo[there]) == want[there]]
        out[open_[there]] = lo[there]
        return out


def _code(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.rint(np.log10(np.maximum(counts, 1)) * STEPS), 0).astype("<u2")


_VALUE = np.concatenate([[0.0], 10 ** (np.arange(65535) / STEPS)])


class Trie:
    """Levels 2 and 3 of one shard, over words named by their rank.

    ``pairs`` are the sorted distinct ``rank << 32 | word before`` with their counts; ``triples`` the sorted
    distinct ``place of the pair << 32 | word before that`` with theirs.
    """

    def __init__(self, folder: str, n_words: int, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray) -> None:
        at = Path(folder)
        self.pointers, self.levels, self.codes = [], [], []
        for k, (parents, keys, counts) in enumerate(((n_words, pairs, pair_counts), (len(pairs), triples, triple_counts))):
            children = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=parents)
            self.pointers.append(EliasFano(np.concatenate([[0], np.cumsum(children)])).mapped(at / f"pointers{k}"))
            self.levels.append(EliasFano(keys).mapped(at / f"level{k}"))
            codes = np.append(_code(counts), 0).astype("<u2")  # the last is what is not there
            codes.tofile(f := at / f"codes{k}")
            self.codes.append(np.memmap(f, "<u2", "r"))

    def child(self, k: int, parent: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Places in a level of the children of ``parent`` (-1: none) by the word before; -1 where there is none."""
        out = np.full(len(parent), -1, np.int64)
        for at in range(0, len(parent), BLOCK):
            own = np.flatnonzero(parent[at : at + BLOCK] >= 0) + at
            named, back = np.unique(parent[own], return_inverse=True)
            start, end = (self.pointers[k].get(named + d).astype(np.int64)[back] for d in (0, 1)) if len(own) else (own, own)
            out[own] = self.levels[k].find(parent[own].astype(np.uint64) << np.uint64(32) | before[own].astype(np.uint64), start, end)
        return out


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays, byte by byte of their values (the high ones of small numbers are all alike), compressed."""
    body, head = b"", []
    for name, a in arrays.items():
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
        raw = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
        head.append(f"{name},{a.dtype.str},{len(raw)}")
        body += raw
    return ";".join(head).encode() + b"\n" + body


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    head, _, body = bytes(blob).partition(b"\n")
    out, at = {}, 0
    for part in head.decode().split(";"):
        name, kind, size = part.split(",")
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[at : at + int(size)]), np.uint8).reshape(np.dtype(kind).itemsize, -1)
        out[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += int(size)
    return out


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def ids(self, text: bytes | None) -> np.ndarray:
        w = words(text)
        w.append(END)
        return np.fromiter(map(self.__getitem__, w), dtype=np.int64, count=len(w))


def _hashes(vocabulary: _Vocabulary) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))


def _spread(h: np.ndarray, turn: int = 29) -> np.ndarray:
    return (h ^ (h >> np.uint64(turn))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task, as hashes, with their counts."""
    vocabulary, ids, size = _Vocabulary(), [], 0

    def flush() -> pa.RecordBatch:
        n = np.bincount(np.concatenate(ids), minlength=len(vocabulary))
        return pa.RecordBatch.from_arrays([pa.array(_hashes(vocabulary).view(np.int64)), pa.array(n)], names=["h", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            ids.append(vocabulary.ids(text))
            size += len(ids[-1])
            if size >= 2 * CHUNK_TOKENS:
                yield flush()
                vocabulary, ids, size = _Vocabulary(), [], 0
    if size:
        yield flush()


def _count_pairs(hot: np.ndarray):
    """Pairs of a task whose words are both among ``hot``."""
    begin = np.array([xxhash.xxh64_intdigest(BEGIN)], np.uint64)
    hot = np.sort(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for b in batches:
            vocabulary, rows = _Vocabulary(), []
            for text in b.column(0).to_pylist():
                rows.append(vocabulary.ids(text))
            h = np.concatenate([_hashes(vocabulary), begin])
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            place = np.where(hot[at] == h, at, -1)
            tok = np.concatenate([np.concatenate([[len(h) - 1], r]) for r in rows]) if rows else np.zeros(0, np.int64)
            v, w = place[tok[:-1]], place[tok[1:]]
            ok = (v >= 0) & (w >= 0) & (tok[1:] != len(h) - 1)
            keys, n = np.unique(v[ok] * len(hot) + w[ok], return_counts=True)
            for k, c in zip(keys.tolist(), n.tolist()):
                sums[k] = sums.get(k, 0) + c
        keys = np.array(list(sums), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hot[keys // len(hot)].view(np.int64)), pa.array(hot[keys % len(hot)].view(np.int64)), pa.array(np.array(list(sums.values()), np.int64))], names=["v", "w", "n"])

    return run


def statistics(docs: DataFrame, shards: int) -> tuple[int, int, int, int, dict[int, int], dict[tuple[int, int], int]]:
    """(N, V, texts, shards, counts of the words, and of the pairs, that hold more than a shard's share).

    ``docs`` has texts ``t``. Of either there can be no more than shards, which bounds what reaches the driver;
    both words of such a pair are such words.
    """
    counted = checkpointed(docs.select("t").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(shards, -(-total // SHARD_TOKENS))
    hot = {r.h % (1 << 64): r.n for r in counted.where(F.col("n") * shards > total).collect()}
    end = xxhash.xxh64_intdigest(END)
    n_docs = counted.where(F.col("h") == end - (end >> 63 << 64)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = [*hot, *([xxhash.xxh64_intdigest(BEGIN)] if n_docs * shards > total else [])]
    pairs = {}
    if often:
        both = docs.select("t").mapInArrow(_count_pairs(np.array(often, np.uint64)), "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))
        pairs = {(r.v % (1 << 64), r.w % (1 << 64)): r.n for r in both.where(F.col("n") * shards > total).collect()}
    return total, distinct, n_docs, shards, hot, pairs


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes mixed anew, so that the same word counts differently in another place."""
    x = (h ^ (h >> np.uint64(bits))) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)
    return x ^ (x >> np.uint64(29))


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids, the most frequent first, and the place of each id among them."""
    named, back, n = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(order), "<u4")
    place[order] = np.arange(len(order))
    return named[order], place[back]


def _scatter(shards: int, hot: dict[int, int], hot_pairs: dict[tuple[int, int], int]):
    """Different trigrams of a task's chunks by shard of the last word, and one row that describes each chunk."""
    heavy = np.array(sorted(hot), dtype=np.uint64)
    mixed = lambda v, w: _spread(v) ^ w
    heavy_pairs = np.sort(np.array([mixed(*np.array([[v], [w]], np.uint64))[0] for v, w in hot_pairs], dtype=np.uint64))
    begin = np.uint64(xxhash.xxh64_intdigest(BEGIN))

    def flush(chunk: int, vocabulary: _Vocabulary, docs: list) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(ids) for _, _, ids in docs])
        tok = np.concatenate([ids for _, _, ids in docs])
        learn = np.repeat(np.array([t for _, t, _ in docs]), sizes)
        h = np.append(_hashes(vocabulary), begin)
        first = np.cumsum(sizes) - sizes
        before, before2 = np.empty_like(tok), np.empty_like(tok)
        before[1:] = tok[:-1]
        before[first] = len(h) - 1
        before2[1:] = before[:-1]
        before2[first] = len(h) - 1
        _, at, of = np.unique(h[tok] ^ _turned(h, 21)[before] ^ _turned(h, 42)[before2], return_index=True, return_inverse=True)
        times = np.bincount(of, weights=learn).astype(np.int64)
        same = at[of]
        again = np.flatnonzero(same != np.arange(len(tok)))
        at = np.flatnonzero(same == np.arange(len(tok)))
        times = times[of[at]]
        w, v, u = h[tok[at]], h[before[at]], h[before2[at]]
        shard = w % np.uint64(shards)
        if len(heavy):
            is_hot = np.isin(w, heavy)
            shard[is_hot] = (w[is_hot] ^ _spread(v[is_hot])) % np.uint64(shards)
        if len(heavy_pairs):
            is_hot = np.isin(mixed(v, w), heavy_pairs)
            shard[is_hot] = (w[is_hot] ^ _spread(v[is_hot]) ^ _spread(u[is_hot], 31)) % np.uint64(shards)
        shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)
        order = np.argsort(shard, kind="stable")  # within a shard by place
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[s] : cuts[s + 1]]
            place = at[mine]
            named, w_at = _ranked(tok[place])
            contexts, back = _ranked(np.concatenate([before[place], before2[place]]))
            v_at, u_at = back.reshape(2, -1)
            yield row(s, chunk, 0, _pack(h=h[named], c=(h[contexts] >> np.uint64(32)).astype("<u4"), w=w_at, v=v_at, u=u_at, n=times[mine].astype("<u4"), place=np.diff(place, prepend=0).astype("<u4")))
        about = _pack(
            id=np.array([i or 0 for i, _, _ in docs], dtype="<i8"), null=np.array([i is None for i, _, _ in docs], dtype=np.uint8),
            train=np.array([t for _, t, _ in docs], dtype=np.uint8), size=sizes.astype("<i8"), again=np.diff(again, prepend=0).astype("<u4"), same=same[again].astype("<u4"),
        )
        yield row(int(_spread(np.array([chunk], np.uint64))[0]) % shards, chunk, 1, about)

    def row(shard: int, chunk: int, kind: int, body: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([body], pa.binary())], names=["shard", "chunk", "kind", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        vocabulary, docs, size = _Vocabulary(), [], 0
        for b in batches:
            for i, t, text in zip(*(c.to_pylist() for c in b.columns)):
                docs.append((i, bool(t), vocabulary.ids(text)))
                size += len(docs[-1][2])
                if size >= CHUNK_TOKENS:
                    yield from flush(chunk, vocabulary, docs)
                    chunk += 1
                    vocabulary, docs, size = _Vocabulary(), [], 0
        if docs:
            yield from flush(chunk, vocabulary, docs)

    return run


def _score(hot: dict[int, int], hot_pairs: dict[tuple[int, int], int]):
    """One shard: build its trie from the training counts, and look up every trigram that came."""
    wide = np.uint64(32)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        about = pdf[pdf["kind"] == 1][["chunk", "kind", "payload"]]
        rows = pdf[pdf["kind"] == 0]
        if rows.empty:
            return about
        parts = [_unpack(p) for p in rows["payload"]]
        vocabulary = np.unique(np.concatenate([p["h"] for p in parts]))
        word = np.concatenate([np.searchsorted(vocabulary, p["h"])[p["w"]] for p in parts])
        v, u = (np.concatenate([p["c"][p[x]] for p in parts]).astype(np.uint64) for x in "vu")
        n = np.concatenate([p["n"] for p in parts]).astype(np.int64)
        counts = np.bincount(word, weights=n, minlength=len(vocabulary)).astype(np.int64)
        for h, c in hot.items():
            i = np.searchsorted(vocabulary, np.uint64(h))
            if i < len(vocabulary) and vocabulary[i] == h:
                counts[i] = c
        places = [p["place"] for p in parts]
        del parts
        asked, back = np.unique(word.astype(np.uint64) << wide | v, return_inverse=True)
        del v
        pair_counts = np.bincount(back, weights=n, minlength=len(asked)).astype(np.int64)
        for (a, b), c in hot_pairs.items():
            i = np.searchsorted(vocabulary, np.uint64(b))
            if i < len(vocabulary) and vocabulary[i] == b:
                key = np.uint64(int(i) << 32 | a >> 32)
                at = np.searchsorted(asked, key)
                if at < len(asked) and asked[at] == key:
                    pair_counts[at] = c
        seen, learn = pair_counts > 0, n > 0
        triple = (np.cumsum(seen) - 1)[back[learn]].astype(np.uint64) << wide | u[learn]
        triples, of = np.unique(triple, return_inverse=True)
        triple_counts = np.bincount(of, weights=n[learn], minlength=len(triples))
        with tempfile.TemporaryDirectory() as folder:  # this task's own index, read by no other
            trie = Trie(folder, len(vocabulary), asked[seen], pair_counts[seen], triples, triple_counts)
            del pair_counts, triple, triples, triple_counts, of, seen, learn, n
            found = trie.child(0, (asked >> wide).astype(np.int64), asked & np.uint64(0xFFFFFFFF))[back]
            two = np.array(trie.codes[0][found])
            three = np.array(trie.codes[1][trie.child(1, found, u)])
            del trie, found, back, asked, u
        out, start = [], 0
        for place in places:
            mine = slice(start, start := start + len(place))
            named, back = _ranked(word[mine])
            out.append(_pack(one=counts[named], at=back, two=two[mine], three=three[mine], place=place))
        return pd.concat([about, pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "kind": 0, "payload": out})])

    return run


def _gather(total: int, distinct: int, train_docs: int, mu: tuple[float, float]):
    """One chunk: probabilities of its tokens from the counts that came back, summed up by text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        about = _unpack(pdf[pdf["kind"] == 1]["payload"].iloc[0])
        sizes = about["size"]
        one, two, three = (np.zeros(int(sizes.sum()), kind) for kind in (np.int64, np.uint16, np.uint16))
        for payload in pdf[pdf["kind"] == 0]["payload"]:
            x = _unpack(payload)
            place = np.cumsum(x["place"], dtype=np.int64)
            one[place], two[place], three[place] = x["one"][x["at"]], x["two"], x["three"]
        again = np.cumsum(about["again"], dtype=np.int64)
        for a in (one, two, three):
            a[again] = a[about["same"]]
        first = np.cumsum(sizes) - sizes
        pair = _VALUE[two]
        context, context2 = np.roll(one, 1).astype(np.float64), np.roll(pair, 1)
        context[first] = context2[first] = train_docs
        p = (one + 1) / (total + distinct + 1)
        base = np.log10(p)
        p = (pair + mu[0] * p) / (context + mu[0])
        p = (_VALUE[three] + mu[1] * p) / (context2 + mu[1])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
        ids = pd.Series(about["id"]).astype("Int64").mask(about["null"].astype(bool))
        return pd.DataFrame({"id": ids, "held_out": about["train"] == 0, "n_tokens": sizes, "n_known": add(one > 0).astype(np.int64), "base_score": add(base), "score": add(np.log10(p))})

    return run


def score(docs: DataFrame, train: str = "crc32(cast(cast(id as string) as binary)) % 7 <> 2", id_col: str = "doc_id", text_col: str = "text", mu: tuple[float, float] = MU) -> DataFrame:
    """Per row of ``docs``: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` is the condition, on ``id`` and ``t``, for rows to learn from; rows for which it isn't
    true, among them rows without an id, are held out. A null text is empty: its one token is the end.
    Repeated rows count, and are scored, as often as they occur. Where nothing is learned every word is
    unknown and both scores are those of the uniform prior. An empty table gives an empty result.

    A trigram travels once from each chunk however often it occurs there, with its training count. Words
    whose count is above a shard's share are dealt by the word before them as well, and pairs above it by the
    word before those; the counts of both, at most one per shard, go to all shards. A shard has about
    ``SHARD_TOKENS`` occurrences, so the number of shards follows the corpus. Words before are compared by
    32-bit hashes among the children of one node only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    rows = rows.select("id", F.coalesce(F.expr(train), F.lit(False)).alias("train"), "t")
    total, distinct, train_docs, shards, hot, hot_pairs = statistics(rows.where("train"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = rows.mapInArrow(_scatter(shards, hot, hot_pairs), "shard long, chunk long, kind int, payload binary")
    back = sent.groupBy("shard").applyInPandas(_score(hot, hot_pairs), "chunk long, kind int, payload binary")
    out = back.groupBy("chunk").applyInPandas(_gather(total, distinct, train_docs, mu), "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
