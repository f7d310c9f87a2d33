r"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is read word by word (quotation marks are words too). Each word has a
set of classes, and five transducers read the classes and write marks:

* insult: a word that begins with a learned stem (one Aho-Corasick automaton
  finds the stems) is marked;
* threat: a harm word up to three words after an intent word is marked;
* negation: marks the three words after a negating word;
* reported speech: marks what follows a verb of saying or a quotation mark;
* target: marks the whole clause if it has a second-person word.

They are composed to one automaton, whose states are the reachable tuples of
their states, so a clause takes one step for each word. A clause without insult
or threat scores nothing, whatever words it has. Stems have learned weights (log
odds of toxic against clean texts), and so have threats and the marks: a
logistic regression over the labelled rows' sums of marked weights, whose ridge
pulls to the weights in ``PRIOR`` where the rows don't tell.

Learning reads about ``max_rows`` labelled rows at most, those whose id's hash is
in the share that gives so many, so the sample is the same however the rows are
dealt; scoring reads all rows and whole texts, and uses the text alone. A stem
must stand in ``least_docs`` unlike texts: texts with the same rarest word hash
count once, so a fragment of one text and its copies teaches nothing.

Null and empty texts have no clause and get the offset's score, under 0.5.
Without labels of both kinds nothing is learned and every score is 0. Rows with
null labels or ids teach nothing; an id labelled twice is toxic if one label is.
Each row gives one row, an empty table none. Very long texts and clauses take
linear time. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

# The small closed classes of words of the grammar, in four languages.
TARGETS = frozenset("you your youre yourself u du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú ti usted vosotros vos".split())
NEGATIONS = frozenset("not no never isn't aren't don't nor nicht kein keine nie ne pas jamais non nunca jamás tampoco".split())
REPORTS = frozenset("said says say wrote writes claimed called reported quoted sagte sagt schrieb nannte behauptete dit écrit affirme appelé dijo dice escribió llamó".split())
INTENTS = frozenset("will shall gonna must should werde wirst soll vais vas va doit voy vas debe".split())
HARMS = frozenset("kill hurt destroy beat punch stab shoot die töten schlagen verletzen sterben tuer frapper mourir matar golpear morir".split())
QUOTES = "\"“”„«»"

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
TOKEN = re.compile(rf"{WORD.pattern}|[{QUOTES}]")
CLAUSE_END = re.compile(r"[.!?;:\n]")
REACH = 3

# Classes of a word, as bits.
INSULT, HARM, INTENT, NEGATION, REPORT, TARGET = (1 << k for k in range(6))
CLASSES = 1 << 6
# Marks that the transducers write, as bits.
IS_INSULT, IS_THREAT, NEGATED, REPORTED, TARGETED = (1 << k for k in range(5))
_LEXICON: dict[str, int] = {q: REPORT for q in QUOTES}
for _bit, _words in ((HARM, HARMS), (INTENT, INTENTS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS)):
    for _word in _words:
        _LEXICON[_word] = _LEXICON.get(_word, 0) | _bit


@dataclass(frozen=True)
class Transducer:
    """``step`` gives the next state and the marks of a word with these classes; ``final`` the marks of the whole clause."""

    step: Callable[[int, int], tuple[int, int]]
    final: Callable[[int], int] = lambda state: 0


def _after(opens: int, on: int, mark: int) -> Transducer:
    """Marks words of classes ``on`` (0: all) that stand up to ``REACH`` words after one of ``opens``."""

    def step(state: int, classes: int) -> tuple[int, int]:
        marks = mark if state and (not on or classes & on) else 0
        return (REACH if classes & opens else max(state - 1, 0)), marks

    return Transducer(step)


TRANSDUCERS = {
    "insult": Transducer(lambda state, classes: (0, IS_INSULT if classes & INSULT else 0)),
    "threat": _after(INTENT, HARM, IS_THREAT),
    "negation": _after(NEGATION, 0, NEGATED),
    "reported": Transducer(lambda state, classes: (int(bool(state or classes & REPORT)), REPORTED if state else 0)),
    "target": Transducer(lambda state, classes: (int(bool(state or classes & TARGET)), 0), lambda state: TARGETED if state else 0),
}


@dataclass(frozen=True)
class Automaton:
    """A composition: ``next`` and ``marks`` by state * CLASSES + classes, ``final`` by state; 0 is the start."""

    next: list[int]
    marks: list[int]
    final: list[int]


def compose(machines: list[Transducer]) -> Automaton:
    """One automaton over the reachable tuples of states; its marks are all marks together."""
    numbers: dict[tuple[int, ...], int] = {(0,) * len(machines): 0}
    out = Automaton([], [], [])
    for states in iter(_growing(numbers)):
        out.final.append(0)
        for machine, state in zip(machines, states, strict=True):
            out.final[-1] |= machine.final(state)
        for classes in range(CLASSES):
            steps = [machine.step(state, classes) for machine, state in zip(machines, states, strict=True)]
            to = tuple(x for x, _ in steps)
            out.next.append(numbers.setdefault(to, len(numbers)))
            out.marks.append(0)
            for _, marks in steps:
                out.marks[-1] |= marks
    return out


def _growing(numbers: dict) -> Iterator:
    """The keys of a dictionary that gets further keys meanwhile."""
    at = 0
    while at < len(numbers):
        yield list(numbers)[at]
        at += 1


#: Weights of a text's sums, as if learned from earlier rows: all insults, then what is added for those negated, reported and in a clause with a target; threats, and those negated and reported.
PRIOR = (0.3, -0.15, -0.15, 0.08, 1.2, -0.6, -0.6)
SUMS = ((IS_INSULT, 0), (IS_INSULT, NEGATED), (IS_INSULT, REPORTED), (IS_INSULT, TARGETED), (IS_THREAT, 0), (IS_THREAT, NEGATED), (IS_THREAT, REPORTED))


@dataclass(frozen=True)
class Grammar:
    """Learned weights: by stem, the offset, and by sum; ``parts`` names the transducers in use."""

    stems: dict[str, float]
    offset: float
    weights: tuple[float, ...] = PRIOR
    parts: tuple[str, ...] = field(default=tuple(TRANSDUCERS))


class Scanner:
    """A grammar compiled for scoring."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.automaton = compose([TRANSDUCERS[x] for x in grammar.parts])
        self.machine = ahocorasick.Automaton()
        for stem, weight in grammar.stems.items():
            self.machine.add_word(stem, (len(stem), weight))
        for word in HARMS:
            if word not in grammar.stems:
                self.machine.add_word(word, (len(word), 0.0))
        self.machine.make_automaton()

    def clauses(self, text: str | None) -> list[list[tuple[float, int]]]:
        """For each clause that an insult or threat matches: weight and marks of its marked words."""
        if not text:
            return []
        low = text.lower()
        found: dict[int, float] = {}
        for end, (size, weight) in self.machine.iter(low):
            start = end - size + 1
            if start == 0 or not low[start - 1].isalpha():
                found[start] = max(weight, found.get(start, 0.0))
        if not found:
            return []
        ends = [m.start() for m in CLAUSE_END.finditer(low)]
        out, last = [], -1
        for start in sorted(found):
            if start >= last:
                k = bisect_left(ends, start)
                last = ends[k] if k < len(ends) else len(low)
                words = self._clause(low, ends[k - 1] + 1 if k else 0, last, found)
                if words:
                    out.append(words)
        return out

    def _clause(self, low: str, begin: int, end: int, found: dict[int, float]) -> list[tuple[float, int]]:
        a, state, out = self.automaton, 0, []
        for m in TOKEN.finditer(low, begin, end):
            weight = found.get(m.start(), 0.0)
            at = state * CLASSES + (_LEXICON.get(m.group(), 0) | (INSULT if weight > 0 else 0))
            marks, state = a.marks[at], a.next[at]
            if marks & (IS_INSULT | IS_THREAT):
                out.append((weight, marks))
        return [(weight, marks | a.final[state]) for weight, marks in out]

    def sums(self, text: str | None) -> tuple[float, ...]:
        """Of a text, for each of ``SUMS``: the weights of insults, or the number of threats, that have the marks."""
        out = [0.0] * len(SUMS)
        for clause in self.clauses(text):
            for weight, marks in clause:
                for k, (kind, more) in enumerate(SUMS):
                    if marks & kind and marks & more == more:
                        out[k] += weight if kind == IS_INSULT else 1.0
        return tuple(out)

    def score(self, text: str | None) -> float:
        total = self.grammar.offset + _capped(self.sums(text)) @ np.array(self.grammar.weights)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -50.0, 50.0))))


def _capped(sums: tuple[float, ...] | np.ndarray, most: float = 12.0) -> np.ndarray:
    """Sums of long texts scaled down to ``most``, their shares as they are."""
    x = np.asarray(sums, dtype=np.float64)
    whole = x[..., :1] + x[..., 4:5]
    return x * np.minimum(1.0, most / np.maximum(whole, most))


def stems_of(text: str | None, least: int, most: int) -> set[str]:
    """The words of a text of ``least`` letters or more, lower-cased, and their beginnings of ``least`` to ``most`` letters."""
    words = {w for w in WORD.findall((text or "").lower()) if len(w) >= least}
    return words | {w[:k] for w in words for k in range(least, min(most, len(w)) + 1)}


def likeness(text: str | None) -> int:
    """A number that texts share if they are alike: the smallest hash of their words."""
    return min((zlib.crc32(w.encode()) for w in set(WORD.findall((text or "").lower()))), default=0)


def choose_stems(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, least_odds: float) -> dict[str, float]:
    """Stems whose log odds surely reach ``least_odds``; shorter ones first, longer ones only where they tell more."""
    def odds(toxic: int, clean: int) -> tuple[float, float]:
        """The log odds, and a lower bound of them that chance reaches in one of twenty rare stems."""
        value = math.log((toxic + 0.5) / (n_toxic + 1.0)) - math.log((clean + 0.5) / (n_clean + 1.0))
        return value, value - 1.64 * math.sqrt(1.0 / (toxic + 0.5) + 1.0 / (clean + 0.5))

    chosen: dict[str, float] = {}
    for stem in sorted(counts, key=lambda s: (len(s), s)):
        weight, low = odds(*counts[stem])
        inside = max((chosen[stem[:k]] for k in range(1, len(stem)) if stem[:k] in chosen), default=None)
        if low >= least_odds and (inside is None or weight > inside + 1.0):
            chosen[stem] = weight
    return chosen


def learn_grammar(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, stem_letters: tuple[int, int] = (4, 7), least_docs: int = 3, least_odds: float = 1.0) -> Grammar:
    """Weights from the labelled rows; ``labels`` has the id and a 0/1 label."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("toxic"))
    share = min(1.0, max_rows / max(known.count(), 1))
    sample = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 31)) < int(share * (1 << 31)))
    source = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
    rows = cut(source.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("text", "toxic"))  # about max_rows ids
    if rows.select("toxic").distinct().count() < 2:
        return Grammar({}, -50.0)

    def stems(only: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: set[tuple[str, int]] = set()
                for text in batch.column("text"):
                    own, like = stems_of(text.as_py(), *stem_letters), likeness(text.as_py())
                    # The empty stem counts the texts themselves.
                    seen.update((x, like) for x in (own if only is None else own & only) | {""})
                    if len(seen) > 200_000:
                        yield rows_of(seen)
                        seen.clear()
                yield rows_of(seen)

        def rows_of(seen: set[tuple[str, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"stem": pa.array([x for x, _ in seen], pa.string()), "like": pa.array([n for _, n in seen], pa.int64())})

        return run

    def totals(df: DataFrame, only: frozenset[str] | None) -> DataFrame:
        """Stems by the number of unlike texts they stand in."""
        return df.select("text").mapInArrow(stems(only), "stem string, like long").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("c"))

    # Both lists are bounded with the sample.
    toxic = {r["stem"]: r["c"] for r in totals(rows.where("toxic = 1"), None).where((F.col("c") >= least_docs) | (F.col("stem") == "")).collect()}
    clean = {r["stem"]: r["c"] for r in totals(rows.where("toxic = 0"), frozenset(toxic)).collect()}
    chosen = choose_stems({s: (n, clean.get(s, 0)) for s, n in toxic.items() if s}, toxic[""], clean[""], least_odds)
    first = Grammar(chosen, 0.0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(first)
        for batch in batches:
            found = [scanner.sums(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").cast(pa.int64()), "sums": pa.array(found, pa.list_(pa.float64()))})

    # Seven numbers of about max_rows texts, equal ones once.
    points = rows.mapInArrow(sums, "toxic long, sums array<double>").groupBy("toxic", "sums").agg(F.count(F.lit(1)).alias("c")).orderBy("toxic", "sums").collect()
    offset, weights = fit_logistic(np.array([r["sums"] for r in points]), np.array([r["toxic"] for r in points], dtype=float), np.array([r["c"] for r in points], dtype=float))
    return Grammar(chosen, offset, weights)


def fit_logistic(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> tuple[float, tuple[float, ...]]:
    """Offset and weights of a logistic regression over rows that occur ``c`` times, by Newton's steps; the ridge pulls the weights to ``PRIOR``."""
    design = np.column_stack([np.ones(len(x)), _capped(x)])
    prior = np.array([-2.0, *PRIOR])
    strength = np.diag([0.01, *[ridge] * len(PRIOR)])
    beta = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (c * (p - y)) + strength @ (beta - prior)
        step = np.linalg.solve((design * (c * p * (1 - p))[:, None]).T @ design + strength, slope)
        beta = beta - np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-9:
            break
    return float(min(beta[0], -0.5)), tuple(float(b) for b in beta[1:])


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, ``keep``'s columns, ``score`` (0 to 1) and ``predicted`` (0 or 1)."""
    keep = keep or {}
    source = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in keep.items()], F.col(text_col).cast("string").alias("text"))
    kept = [f for f in source.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(grammar)
        for batch in batches:
            scores = [scanner.score(x.as_py()) for x in batch.column("text")]
            out = {f.name: batch.column(f.name) for f in kept}
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in scores], pa.int32())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(run, f"{schema}, score double, predicted int")
