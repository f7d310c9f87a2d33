"""Quality rules as a short-circuit cascade.

Every rule reads features of a text and says whether it rejects it. On a small
sample the cascade measures what each rule costs and how many texts it rejects,
and then runs the rules by rejection per cost, each over the texts that the
rules before it left. The order changes only the time: a text is kept exactly
if no rule rejects it.

Null and empty texts have no words, so the word-count rule rejects them. Each
input row gives one output row, repeated rows too; a null id stays null; an empty
table gives none. Rules of equal worth run in the order they are given. Other
columns, whatever their names, are not looked at. Memory follows one group of
texts (two megabytes, or one longer text).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import SPACES, group_words, pair_hashes, text_groups, word_hashes

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(SYMBOLS.encode())
_UPPER = _table(bytes(range(0x41, 0x5B)))
_LETTER = _table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_BANG = _table(b"!")


class TextGroup:
    """Features of some texts; each is computed once, when a rule first asks."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self._repeats: dict[int, int] = {}
        self._lines: dict[int, tuple[int, int]] = {}

    @cached_property
    def _words(self):
        return group_words(self.raw)

    @cached_property
    def _bytes(self) -> bytes:
        return self._words[0].tobytes()

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        offsets = np.minimum(self._words[1], len(flags))
        return total[offsets[1:]] - total[offsets[:-1]]

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[4])

    @cached_property
    def word_chars(self) -> np.ndarray:
        data = self._words[0]
        return self._per_text(~SPACES[data] & ((data & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL[self._words[0]])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._per_text(_UPPER[self._words[0]])

    @cached_property
    def n_letters(self) -> np.ndarray:
        data = self._words[0]
        return self._per_text(_LETTER[data] & ((data & 0xC0) != 0x80))

    @cached_property
    def n_bangs(self) -> np.ndarray:
        return self._per_text(_BANG[self._words[0]])

    @cached_property
    def _triples(self) -> np.ndarray:
        h = word_hashes(*self._words[0:1], *self._words[2:4])
        return pair_hashes(pair_hashes(h[:-2], h[1:-1]), h[2:]) if len(h) > 2 else h[:0]

    def _confirmed(self, base: int, at: np.ndarray) -> np.ndarray:
        """Those of the windows ``at`` whose three words really stand there twice or more."""
        raw, (starts, ends) = self._bytes, self._words[2:4]
        windows = [tuple(raw[starts[k] : ends[k]] for k in range(base + x, base + x + 3)) for x in at.tolist()]
        seen = Counter(windows)
        return at[[seen[w] > 1 for w in windows]]

    def repeat_words(self, i: int) -> int:
        """Words in three-word windows that text ``i`` holds twice or more."""
        if i not in self._repeats:
            first = self._words[4]
            windows = self._triples[first[i] : max(first[i], first[i + 1] - 2)]
            kinds = np.sort(windows)
            twice = kinds[1:][kinds[1:] == kinds[:-1]]
            found = 0
            if len(twice):
                at = self._confirmed(int(first[i]), np.flatnonzero(np.isin(windows, twice)))
                covered = np.zeros(len(windows) + 2, dtype=bool)
                for k in range(3):
                    covered[at + k] = True
                found = int(covered.sum())
            self._repeats[i] = found
        return self._repeats[i]

    def lines(self, i: int) -> tuple[int, int]:
        """Lines of text ``i`` that have a word, and those equal to an earlier one."""
        if i not in self._lines:
            own = [x for x in self.raw[i].split(b"\n") if x.strip()]
            self._lines[i] = len(own), len(own) - len(set(own))
        return self._lines[i]


@dataclass(frozen=True)
class Rule:
    """``rejects(group, texts)`` gives a truth value for each index in ``texts``."""

    name: str
    rejects: Callable[[TextGroup, np.ndarray], np.ndarray]


def default_rules(min_words: int = 50, max_repeat: float = 0.5, max_symbols: float = 0.25, max_upper: float = 0.6, max_bangs: float = 0.3, max_dup_lines: float = 0.5, word_length: tuple[float, float] = (2.0, 25.0)) -> list[Rule]:
    """The production rules; shares are of words, letters or lines as named."""
    return [
        Rule("word_count", lambda g, t: g.n_words[t] < min_words),
        Rule("repeated_windows", lambda g, t: np.array([g.repeat_words(i) > max_repeat * g.n_words[i] for i in t], dtype=bool)),
        Rule("symbols", lambda g, t: g.n_symbols[t] > max_symbols * g.n_words[t]),
        Rule("capitals", lambda g, t: g.n_upper[t] > max_upper * np.maximum(g.n_letters[t], 1)),
        Rule("exclamations", lambda g, t: g.n_bangs[t] > max_bangs * g.n_words[t]),
        Rule("duplicate_lines", lambda g, t: np.array([n > 3 and d > max_dup_lines * n for n, d in map(g.lines, t)], dtype=bool)),
        Rule("word_length", lambda g, t: (g.word_chars[t] < word_length[0] * g.n_words[t]) | (g.word_chars[t] > word_length[1] * g.n_words[t])),
    ]


def run_cascade(group: TextGroup, rules: list[Rule]) -> np.ndarray:
    """Index of the rejecting rule for each text, -1 where none rejects."""
    verdict = np.full(len(group.raw), -1, dtype=np.int64)
    alive = np.arange(len(group.raw))
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        gone = rule.rejects(group, alive)
        verdict[alive[gone]] = k
        alive = alive[~gone]
    return verdict


def order_rules(texts: list[str | None], rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per second on a sample: at each step the best one over the texts that those before it leave. As given without a sample."""
    groups = list(text_groups(texts))
    if not groups:
        return list(rules)
    words = [TextGroup(raw)._words for raw in groups]  # cutting words is every rule's cost, and none's
    alive = [np.arange(len(raw)) for raw in groups]
    left, out = list(rules), []

    def tried(rule: Rule) -> tuple[float, list[np.ndarray]]:
        fresh = [TextGroup(raw) for raw in groups]
        for group, own in zip(fresh, words, strict=True):
            group.__dict__["_words"] = own
        began = time.perf_counter()
        gone = [rule.rejects(group, own) for group, own in zip(fresh, alive, strict=True)]
        return (sum(int(g.sum()) for g in gone) + 0.5) / max(time.perf_counter() - began, 1e-9), gone

    while left:
        results = [tried(rule) for rule in left]
        best = max(range(len(left)), key=lambda k: results[k][0])
        alive = [own[~gone] for own, gone in zip(alive, results[best][1], strict=True)]
        out.append(left.pop(best))
    return out


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 200, sample_bytes: int = 1 << 16, digest: bool = False) -> DataFrame:
    """One row per document: id, ``rejected_by`` (null if kept) and ``kept``.

    ``digest`` adds the base counts, which are then computed for every row.
    ``sample_rows`` of ``sample_bytes`` each at most bound the sample that orders
    the rules; it decides nothing else. Of several rules that reject a text,
    ``rejected_by`` names the first in that order, which follows measured times
    and may differ between runs; ``kept`` can't.
    """
    rules = default_rules() if rules is None else rules
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sampled = source.where((F.pmod(F.xxhash64("text"), F.lit(16)) == 0) & (F.octet_length("text") <= sample_bytes)).select("text").limit(sample_rows).collect()
    ordered = order_rules([r[0] for r in sampled], rules)
    id_type = source.schema["doc_id"].dataType.simpleString()
    base = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " if digest else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raw in text_groups(x.as_py() for x in batch.column("text")):
                group = TextGroup(raw)
                verdict = run_cascade(group, ordered)
                out = {"doc_id": batch.column("doc_id").slice(at, len(raw))}
                at += len(raw)
                if digest:
                    n = range(len(raw))
                    out |= {"n_words": group.n_words, "word_chars": group.word_chars, "n_symbols": group.n_symbols}
                    out |= {"n_dup_lines": [group.lines(i)[1] for i in n], "n_repeat_words": [group.repeat_words(i) for i in n]}
                    out = {k: v if k == "doc_id" else pa.array(v, pa.int64()) for k, v in out.items()}
                out["rejected_by"] = pa.array([None if v < 0 else ordered[v].name for v in verdict], pa.string())
                out["kept"] = pa.array(verdict < 0)
                yield pa.RecordBatch.from_pydict(out)

    return source.mapInArrow(run, f"doc_id {id_type}, {base}rejected_by string, kept boolean")
