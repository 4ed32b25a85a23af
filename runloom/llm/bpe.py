"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Within one pre-token the next merge is always the leftmost pair of the lowest rank. Every merge rank
has a bucket of linked-list positions; a three-level bitmap over the ranks tells which buckets have
entries, and find-first-set in each level leads to the lowest one in constant time. Entries whose pair
has changed since they were queued are skipped when they surface. A pre-token of n bytes so takes
O(n log n), however long it is; many short ones share one buffer and one queue.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import releasing

#: Distinct pre-tokens whose ids a worker remembers; beyond it starts over. Only speed depends on it.
CACHE_ENTRIES = 60_000
#: Text that is split into pre-tokens at a time.
GROUP_BYTES = 1 << 20


class RankQueue:
    """Buckets of positions by merge rank, with a three-level bitmap of those that have entries."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low: dict[int, int] = {}  # 64 ranks a word
        self.mid: dict[int, int] = {}  # 64 words of the level below a word
        self.top = 0  # a bit for each word of the middle level

    def put(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def put_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Each position into the bucket of its rank; negative ranks have none."""
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        if len(order):
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            at = [0, *cuts.tolist(), len(ranks)]
            for x, y, rank in zip(at, at[1:], ranks[at[:-1]].tolist()):
                self.put(rank, positions[x:y])

    def take(self) -> tuple[int, np.ndarray]:
        """The lowest rank that has entries, and its bucket, which goes. Only if ``top`` isn't 0."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        bit = word & -word
        self.low[a] = word ^ bit
        if word == bit:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        rank = a << 6 | bit.bit_length() - 1
        bucket = self.buckets.pop(rank)
        positions = np.sort(bucket[0] if len(bucket) == 1 else np.concatenate(bucket))
        return rank, positions[np.concatenate([[True], positions[1:] != positions[:-1]])]


class Pairs:
    """The rank that two neighbouring tokens merge to: that of their joined bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        made = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(made), dtype=np.int64)
        self.ranks = np.array([made[k] for k in self.keys.tolist()], dtype=np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), -1, dtype=np.int64)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def merge(pieces: list[bytes], byte_ids: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Token ids of each pre-token, as little-endian unsigned 32-bit integers.

    The pre-tokens lie end to end in one buffer and share one queue; no pair crosses from one into the
    next, so they don't affect each other and a bucket can be merged at once: of overlapping pairs
    ("aaa") every second one, from the left. Should that make a pair of the current rank or a lower one,
    which would come before the rest of the bucket, it is undone, and only the leftmost position of each
    pre-token is merged before the queue is asked again.
    """
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    n = int(sizes.sum())
    owner = np.repeat(np.arange(len(pieces)), sizes)
    tok = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]  # of the part that starts here
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)  # starts of the next and the last part
    edge = np.cumsum(sizes)
    nxt[edge - 1] = -1
    prv[np.concatenate([[0], edge[:-1]])] = -1
    wait = np.full(n, -1, dtype=np.int64)  # rank of the pair that starts here; -1: none, -2: merged away
    at = np.flatnonzero(nxt >= 0)
    wait[at] = pairs(tok[at], tok[at + 1])
    queue = RankQueue()
    queue.put_all(wait, np.arange(n))
    while queue.top:
        rank, p = queue.take()
        p = p[wait[p] == rank]  # the rest is stale
        if not len(p):
            continue
        j = nxt[p]
        touch = np.concatenate([[False], p[1:] == j[:-1]])
        if touch.any():
            nth = np.arange(len(p))
            p = p[(nth - np.maximum.accumulate(np.where(touch, 0, nth))) % 2 == 0]
        rest = None
        while True:
            j = nxt[p]
            k, was, old = nxt[j], tok[p], wait[j]
            has = k >= 0
            ph, kh = p[has], k[has]
            after = tok[kh]
            tok[p], nxt[p], wait[j] = rank, k, -2
            prv[kh] = ph
            h = prv[p]
            led = h >= 0
            hl = h[led]
            right = tok[kh]
            at = np.concatenate([ph, hl])
            new = pairs(np.concatenate([np.full(len(ph), rank), tok[hl]]), np.concatenate([right, np.full(len(hl), rank)]))
            if rest is not None:
                break
            early = after[after != right]  # what followed was merged as well, after its turn
            if not ((new >= 0) & (new <= rank)).any() and (not len(early) or not ((x := pairs(np.full(len(early), rank), early)) >= 0).any() or (x[x >= 0] > rank).all()):
                break
            first = np.unique(owner[p], return_index=True)[1]
            if len(first) == len(p):
                break
            tok[p], nxt[p], wait[j] = was, j, old
            prv[kh] = j[has]
            rest = np.delete(p, first)
            p = p[first]
        wait[p] = -1
        wait[at] = new
        queue.put_all(new, at)
        if rest is not None:
            queue.put(rank, rest)
    live = wait != -2
    ids = tok[live].astype("<u4").tobytes()
    cuts = [0, *(4 * np.cumsum(np.bincount(owner[live], minlength=len(pieces)))).tolist()]
    return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


#: Letters, numbers and white space up to U+00FF, as insides of character classes.
LATIN = {"L": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "N": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "s": "\t-\r \u0085\u00a0"}


def latin(pattern: str) -> str:
    """``pattern`` with its Unicode classes cut to Latin-1, for the standard library's engine."""

    def put(m: re.Match) -> str:
        body = LATIN[m["p"] or "s"]
        inside = pattern.rfind("[", 0, m.start()) > pattern.rfind("]", 0, m.start())
        return body if inside else f"[^{body}]" if m[0] == r"\S" else f"[{body}]"

    return re.sub(r"\\p\{(?P<p>[LN])\}|\\s|\\S", put, pattern)


class Tokenizer:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pairs = Pairs(self.ranks)
        self._split = regex.compile(pattern).findall
        self._split_latin = re.compile(latin(pattern)).findall
        self.cache: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Pre-tokens; the same by either pattern, the one for Latin-1 takes half the time."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._split(text)
        return self._split_latin(text)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        same: dict[str, str] = {}  # equal pre-tokens are one object, so a group holds references
        held = []
        for text in texts:
            pieces = self.split(text or "")
            held.append(list(map(same.setdefault, pieces, pieces)))
        return self._encode(held, same)

    def _encode(self, held: list[list[str]], different: dict[str, str]) -> list[bytes]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        cache = self.cache
        new = [p for p in different if p not in cache]
        whole = [p.encode() for p in new]
        known = [self.ranks.get(p) for p in whole]
        rest = iter(merge([p for p, r in zip(whole, known) if r is None], self.byte_ids, self.pairs))
        for p, r in zip(new, known):
            cache[p] = next(rest) if r is None else r.to_bytes(4, "little")
        out = [b"".join(map(cache.__getitem__, pieces)) for pieces in held]
        for p in new:
            if len(p) > 256:
                del cache[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        if not ids:
            return b""
        which = np.frombuffer(ids, dtype="<u4")
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


_loaded: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, read once in each worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer(path, pattern)
    return _loaded[path, pattern]


def _groups(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ``GROUP_BYTES`` of text; a longer text is a slice of its own."""
    sizes = np.array([x or 0 for x in pc.binary_length(batch.column(1)).to_pylist()], dtype=np.int64)
    of = np.cumsum(sizes) // GROUP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """Per row of ``docs``: ``id, n_tokens, ids binary, decoded binary, ids_sha256, decoded_sha256``.

    The vocabulary file is opened by each worker at ``path``, a folder of the Python installation. Null
    counts as the empty text, which has no tokens. Rows keep no order and no state, so repeated rows
    give repeated results; other columns are not read. ``with_ids=False`` and ``with_decoded=False``
    leave those bytes null and keep their digests. A task holds the pre-tokens of ``GROUP_BYTES`` of
    text, or of one text, at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path, pattern)
        for b in (g for batch in batches for g in _groups(batch)):
            n, decoded, a, d = [], [], [], []
            ids = t.encode_all(b.column(1).to_pylist())
            for got in ids:
                back = t.decode(got)
                n.append(len(got) // 4)
                a.append(hashlib.sha256(got).hexdigest())
                d.append(hashlib.sha256(back).hexdigest())
                decoded.append(back if with_decoded else None)
            kept = ids if with_ids else [None] * len(ids)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(decoded, pa.binary()), pa.array(a), pa.array(d)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(releasing(run), f"id {kind}, n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string")
