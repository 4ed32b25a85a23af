"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps each word of a text to a symbol: insult, threat, target, negation, verb of saying, other; marks
are symbols too. Small transducers read the symbols in lockstep, each seeing what those before it have marked:

    target, negation, saying, quotation    mark words that a symbol behind them reaches in the sentence
    hostile    holds an insult or threat until its clause is decided, and marks it aimed, piled, denied or bare
    discourse  marks a bare insult that follows another hostile clause within WITHIN sentences

Their composition is one transducer whose states are tuples of theirs; its transitions are computed as they are
first needed and then looked up, one for each word. It emits the matched clauses:

    insult_target   a hostile word within reach of "you", "they", ...
    threat_target   a threatening verb aimed at someone
    piled           two hostile words in one clause
    sustained       a hostile word on its own after another hostile clause
    negated         any of them under a negation ("not", "nicht", ...)
    reported        any of them inside quotation marks or after a verb of saying

An isolated hostile word matches nothing and weighs nothing. The weights of the patterns, and which words are
hostile beyond the built-in ones, are learned from labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import checkpointed, hashed_sample

#: Built-in entries of the transducers (English, German, French, Spanish).
INSULT = "idiot idiots moron morons stupid trash worthless pathetic loser losers scum clown clowns disgusting imbecile dumb filth vermin dumm idioten abschaum stupide nul ordure estúpido basura".split()
THREAT = "kill hurt destroy beat burn shoot stab hang töten umbringen tuer frapper matar golpear".split()
TARGET = "you your yours they them their he she him her these those du dich dein ihr sie tu vous ton votre tú usted ustedes".split()
NEGATION = "not never no isn aren wasn don doesn didn cannot nicht kein keine nie pas jamais aucun nunca ningún".split()
REPORTING = "said says called calls wrote writes claimed quoted sagte nannte schrieb dit disait appelé dijo llamó escribió".split()

#: Labelled training rows, about, that hostile words are learned from, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
#: Names of the matched patterns, in the order in which their counts are kept.
PATTERNS = ("insult_target", "threat_target", "piled", "sustained", "negated", "reported")
#: Words that a negation reaches (a verb of saying twice as many), words that a target may be away, and sentences
#: after a hostile clause in which another hostile word continues it.
REACH, NEAR, WITHIN = 4, 3, 30
#: Counts of a pattern in one text are told apart up to this many (log-spaced beyond).
LEVELS = (0, 1, 2, 4, 8)
#: A word becomes hostile if it is in this many toxic rows and its odds are this many times those of others.
MIN_ROWS, MIN_ODDS = 8, 12.0

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]|[\"“”«»„]")
_QUOTES, _STOPS = frozenset("\"“”«»„"), frozenset(".!?;:")
_SYMBOL = {w: s for s, ws in (("T", THREAT), ("Y", TARGET), ("N", NEGATION), ("R", REPORTING), ("I", INSULT)) for w in ws}


def symbols(hostile: set[str]) -> dict[str, str]:
    """Symbol of each word that the lexicon knows; learned words act as insults."""
    return {w: "I" for w in hostile if w not in _SYMBOL} | _SYMBOL


#: Symbols of words; the others are S (end of a sentence), P (end of a line) and Q (quotation mark).
_WORDS = "ITYNRO"


def reaching(trigger: str, reach: int, mark: str):
    """Transducer that marks up to ``reach`` words after ``trigger`` in its sentence. State: words left."""

    def step(left: int, symbol: str, marks: frozenset) -> tuple[int, frozenset]:
        if symbol not in _WORDS:
            return (left if symbol == "Q" else 0), marks
        now = marks | {mark} if left else marks
        return (reach if symbol == trigger else max(0, left - 1)), now

    return 0, step


def quotation():
    """Transducer that marks words between quotation marks of one line as reported. State: whether one is open."""

    def step(open_: bool, symbol: str, marks: frozenset) -> tuple[bool, frozenset]:
        if symbol in "QP":
            return symbol == "Q" and not open_, marks
        return open_, marks | {"under saying"} if open_ else marks

    return False, step


def hostile_clause():
    """Transducer that decides hostile words. State: the one that waits (symbol, words left, what denies it)."""

    def settled(held: tuple | None) -> set:
        return set() if held is None else {held[2]} if held[2] else {"bare"} if held[0] == "I" else set()

    def step(held: tuple | None, symbol: str, marks: frozenset) -> tuple[tuple | None, frozenset]:
        if symbol == "Q":
            return held, marks
        if symbol in "SP":
            return None, marks | settled(held)
        if symbol in "IT":
            denied = "negated" if "under negation" in marks else "reported" if "under saying" in marks else ""
            piled = held is not None and not held[2] and not denied
            out = {"piled"} if piled else settled(held)
            if "aimed" in marks:
                return None, marks | out | {denied or ("insult_target" if symbol == "I" else "threat_target")}
            return (symbol, NEAR, denied), marks | out
        if held is None:
            return None, marks
        if symbol == "Y":
            return None, marks | {held[2] or ("insult_target" if held[0] == "I" else "threat_target")}
        if held[1] == 1:
            return None, marks | settled(held)
        return (held[0], held[1] - 1, held[2]), marks

    return None, step


def discourse():
    """Transducer that marks bare insults after a hostile clause. State: sentences that are left of its reach."""

    def step(left: int, symbol: str, marks: frozenset) -> tuple[int, frozenset]:
        out = marks | {"sustained"} if "bare" in marks and left else marks
        if marks & {"bare", "insult_target", "threat_target", "piled"}:
            left = WITHIN
        return (max(0, left - 1) if symbol in "SP" else left), out

    return 0, step


class Composed:
    """The composition of transducers: a table of (state, symbol) to (state, patterns), filled as it is needed."""

    def __init__(self, *parts) -> None:
        self.steps = [step for _, step in parts]
        self.states: dict[tuple, int] = {}
        self.names: list[tuple] = []
        self.table: list[dict[str, tuple[int, tuple[int, ...]]]] = []
        self.start = self._number(tuple(start for start, _ in parts))

    def _number(self, state: tuple) -> int:
        if state not in self.states:
            self.states[state] = len(self.names)
            self.names.append(state)
            self.table.append({})
        return self.states[state]

    def move(self, at: int, symbol: str) -> tuple[int, tuple[int, ...]]:
        found = self.table[at].get(symbol)
        if found is None:
            marks: frozenset = frozenset()
            state = []
            for own, step in zip(self.names[at], self.steps):
                own, marks = step(own, symbol, marks)
                state.append(own)
            found = self.table[at][symbol] = (self._number(tuple(state)), tuple(k for k, p in enumerate(PATTERNS) if p in marks))
        return found

    def run(self, symbols: list[str]) -> np.ndarray:
        out = np.zeros(len(PATTERNS), dtype=np.int64)
        at, table = self.start, self.table
        for s in symbols:
            found = table[at].get(s) or self.move(at, s)
            at = found[0]
            for k in found[1]:
                out[k] += 1
        return out


GRAMMAR = Composed(reaching("Y", NEAR, "aimed"), reaching("N", REACH, "under negation"), reaching("R", 2 * REACH, "under saying"), quotation(), hostile_clause(), discourse())


def clauses(text: str, known: dict[str, str]) -> np.ndarray:
    """Counts of the patterns in ``text``; its end is the end of a sentence."""
    tokens = _TOKEN.findall(text.lower())
    found = list(map(known.get, tokens))
    if "I" not in found and "T" not in found:
        return np.zeros(len(PATTERNS), dtype=np.int64)
    return GRAMMAR.run([s or ("Q" if t in _QUOTES else "P" if t == "\n" else "S" if t in _STOPS else "O") for s, t in zip(found, tokens)] + ["P"])


def level(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, side="right") - 1


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that hold each word, by label, summed over a task."""
    rows: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        values = np.array(list(rows.values()), dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(values[:, 0]), pa.array(values[:, 1])], names=["word", "clean", "toxic"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w in set(re.findall(r"[^\W\d_]{3,30}", text.lower())):
                rows.setdefault(w, [0, 0])[toxic] += 1
        if len(rows) > 500_000:
            yield flush()
            rows.clear()
    if rows:
        yield flush()


def _counts(known: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [clauses(text or "", known).tolist() for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array(got, pa.list_(pa.int64()))], names=[b.schema.names[0], *b.schema.names[2:], "counts"])

    return run


def hostile_words(labelled: DataFrame) -> set[str]:
    """Words with far higher odds in toxic rows of ``labelled`` (``t``, ``toxic``).

    Counts are summed in the tasks and by word; only words above ``MIN_ROWS`` and ``MIN_ODDS`` reach the
    driver.
    """
    totals = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return set()
    words = labelled.where("t IS NOT NULL").select("t", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_words, "word string, clean long, toxic long")
    words = words.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = (F.col("toxic") / totals[1]) / ((F.col("clean") + 0.5) / totals[0])
    return {r.word for r in words.where((F.col("toxic") >= MIN_ROWS) & (odds >= MIN_ODDS)).collect()}


def fit(cells: list[tuple[list[int], int, int]], rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias first) of a logistic model over pattern levels, from counts of each distinct cell."""
    x = np.array([[1.0, *c] for c, _, _ in cells])
    n, k = np.array([a + b for _, a, b in cells], dtype=float), np.array([b for _, _, b in cells], dtype=float)
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (k - n * p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


#: Weights where no label can be learned from: bias, then one per pattern level.
PRIOR = np.array([-3.0, 2.5, 3.0, 2.5, 2.0, 0.3, 0.3])


def score(docs: DataFrame, labels: DataFrame | None = None, train: str = "crc32(cast(cast(id as string) as binary)) % 5 <> 0", id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Per row of ``docs``: ``id, held_out, counts, score, predicted``.

    ``counts`` are the matched patterns (see ``PATTERNS``). Rows for which ``train`` isn't true, among
    them rows without an id, are held out: their labels are never read. Labels are joined by id; labels
    that are null or neither 0 nor 1 are left out, of repeated labels for one id the largest counts.
    Null and empty texts match nothing and get the score of a text without matches. Without both labels
    in the training rows the weights are ``PRIOR``. Hostile words come from a bounded sample of labelled
    rows, whose ids and labels are broadcast; pattern weights from all of them, as counts of each
    distinct cell of pattern levels, at most ``5 ** 6``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("held_out", ~F.coalesce(F.expr(train), F.lit(False)))
    known, weights = symbols(set()), PRIOR
    if labels is not None:
        marks = labels.select(F.col(label_id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
        marks = marks.where(f"toxic IN (0, 1) AND ({train})").groupBy("id").agg(F.max("toxic").alias("toxic"))
        marks = checkpointed(marks)
        sample = hashed_sample(marks, ["id"], SAMPLE_ROWS)
        known = symbols(hostile_words(rows.where("NOT held_out").join(F.broadcast(sample), "id").select("t", "toxic")))
    out = checkpointed(rows.select("id", "t", "held_out").mapInArrow(_counts(known), "id long, held_out boolean, counts array<long>"))
    if labels is not None:
        levels = [F.expr(" + ".join(f"int(counts[{i}] >= {n})" for n in LEVELS[1:])).alias(p) for i, p in enumerate(PATTERNS)]
        cells = out.where("NOT held_out").join(marks, "id").select(*levels, "toxic").groupBy(*PATTERNS)
        cells = cells.agg(F.count_if(F.col("toxic") == 0).alias("a"), F.count_if(F.col("toxic") == 1).alias("b")).collect()
        found = [([r[p] for p in PATTERNS], r.a, r.b) for r in cells]
        if sum(a for _, a, _ in found) and sum(b for _, _, b in found):
            weights = fit(sorted(found))
    logit = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        logit = logit + float(w) * F.expr(" + ".join(f"int(counts[{i}] >= {n})" for n in LEVELS[1:]))
    p = 1 / (1 + F.exp(-logit))
    return out.select("id", "held_out", "counts", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))
