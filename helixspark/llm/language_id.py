"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of its own, drawn from its code
point. A three-letter window is bound as the product of its letters' vectors,
permuted (rotated) by place; a text is the bundle (sum) of its windows, a
language the bundle of the texts labelled with it. A text gets the language
whose prototype has the largest cosine.

The prototypes are integer sums over all learning rows, so they do not depend
on how the rows are dealt to tasks, and they take one vector per language
whatever the corpus size. Text, not lang or id, decides a prediction.

Null texts, and texts without a letter, give ``und`` with score 0. With no
learning rows every text gives ``und``; an empty table gives no rows. Rows with
a null label teach nothing. Each row gives one row, repeated rows and null ids
too; equal cosines go to the first language by name. Very long texts are read
whole; other columns, whatever their names, are not looked at. Memory follows
one group of texts, and one vector for each letter and language that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Symbols: 0 is a gap, 1-26 the letters a-z, and 27 more than its code point every other letter.
BASIC = 27
_SHIFT = 21
_PART = 4096
#: Language sums that a task holds before it passes them on.
HELD_LABELS = 2000

_CACHE: dict = {}


def symbols_of(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point."""
    if "letters" not in _CACHE:
        _CACHE["letters"] = np.fromiter((chr(x).isalpha() for x in range(1 << 16)), dtype=bool, count=1 << 16)
    high = points >= 1 << 16
    letter = _CACHE["letters"][np.where(high, 0, points)]
    if high.any():
        letter[high] = [chr(x).isalpha() for x in points[high].tolist()]
    s = np.where(letter, points.astype(np.int64) + BASIC, 0)
    basic = (points >= 0x61) & (points < 0x7B)
    s[basic] = points[basic].astype(np.int64) - 0x60
    return s


def letter_vectors(symbols: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The vector of each symbol (int8)."""
    held = _CACHE.setdefault(("letters", dim, seed), {})
    kinds, at = np.unique(symbols, return_inverse=True)
    for s in kinds.tolist():
        if s not in held:
            held[s] = np.random.default_rng([seed, s]).integers(0, 2, dim, dtype=np.int8) * 2 - 1
    return np.stack([held[s] for s in kinds.tolist()])[at]


def _bound(windows: np.ndarray, dim: int, seed: int) -> np.ndarray:
    parts = [windows >> (2 * _SHIFT), windows >> _SHIFT & ((1 << _SHIFT) - 1), windows & ((1 << _SHIFT) - 1)]
    one, two, three = (letter_vectors(x, dim, seed) for x in parts)
    return np.roll(one, 2, axis=1) * np.roll(two, 1, axis=1) * three


def window_vectors(windows: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The bound vector of each window; those of a-z come from a table."""
    if ("windows", dim, seed) not in _CACHE:
        letters = letter_vectors(np.arange(BASIC), dim, seed)
        pairs = (np.roll(letters, 2, axis=1)[:, None, :] * np.roll(letters, 1, axis=1)[None, :, :]).reshape(-1, dim)
        _CACHE["windows", dim, seed] = (pairs[:, None, :] * letters[None, :, :]).reshape(BASIC**3, dim)
    parts = [windows >> (2 * _SHIFT), windows >> _SHIFT & ((1 << _SHIFT) - 1), windows & ((1 << _SHIFT) - 1)]
    basic = (parts[0] < BASIC) & (parts[1] < BASIC) & (parts[2] < BASIC)
    out = _CACHE["windows", dim, seed][np.where(basic, (parts[0] * BASIC + parts[1]) * BASIC + parts[2], 0)]
    if not basic.all():
        out[~basic] = _bound(windows[~basic], dim, seed)
    return out


def text_windows(text: str | None) -> np.ndarray | None:
    """Windows of a text, gaps run together; None if it has no letter."""
    if not text:
        return None
    s = symbols_of(np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    if not s.any():
        return None
    s = np.concatenate(([0], s, [0]))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    return s[:-2] << (2 * _SHIFT) | s[1:-1] << _SHIFT | s[2:]


def bundle(windows: np.ndarray, dim: int, seed: int, kind: type = np.float32) -> np.ndarray:
    """The sum of the windows' vectors; exact in float64, and in float32 below 16 million windows."""
    kinds, counts = np.unique(windows, return_counts=True)
    out = np.zeros(dim, dtype=kind)
    for at in range(0, len(kinds), _PART):
        out += counts[at : at + _PART].astype(kind) @ window_vectors(kinds[at : at + _PART], dim, seed).astype(kind)
    return out


@dataclass(frozen=True)
class Prototypes:
    languages: tuple[str, ...]
    vectors: np.ndarray  # unit length, one row per language
    dim: int
    seed: int


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = 1024, seed: int = 11) -> Prototypes:
    """Prototypes of every label of ``docs``; the driver gets one vector per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def add() -> None:
            for key, parts in waiting.items():
                sums[key] = sums.get(key, 0) + bundle(np.concatenate(parts), dim, seed, np.float64)
            waiting.clear()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([x.astype(np.int64).tolist() for x in sums.values()], pa.list_(pa.int64()))})
            sums.clear()
            return rows

        size = 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                windows = text_windows(text.as_py())
                if windows is not None:
                    waiting.setdefault(lang.as_py(), []).append(windows)
                    size += len(windows)
                if size > 1 << 21 or len(sums) + len(waiting) > HELD_LABELS:
                    add()
                    size = 0
                    if len(sums) > HELD_LABELS:
                        yield out()
        add()
        yield out()

    known = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = known.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("k", "x"))
    rows = parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("lang").collect()
    vectors = np.array([[p["x"] for p in r["v"]] for r in rows], dtype=np.float64).reshape(len(rows), dim)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Prototypes(tuple(r["lang"] for r in rows), (vectors / np.maximum(norms, 1e-12)).astype(np.float32), dim, seed)


def predict_text(text: str | None, model: Prototypes) -> tuple[str, float]:
    windows = text_windows(text)
    if windows is None or not model.languages:
        return UNDETERMINED, 0.0
    own = bundle(windows, model.dim, model.seed)
    cosines = model.vectors @ own / max(float(np.linalg.norm(own)), 1e-12)
    best = int(np.argmax(cosines))
    return model.languages[best], float(min(max(cosines[best], 0.0), 1.0))


def identify(docs: DataFrame, model: Prototypes, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: id, ``keep``'s columns, ``lang_pred`` and ``score`` (0 to 1)."""
    keep = keep or {}
    source = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in keep.items()], F.col(text_col).cast("string").alias("text"))
    kept = [f for f in source.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_text(x.as_py(), model) for x in batch.column("text")]
            out = {f.name: batch.column(f.name) for f in kept}
            yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Prototypes, text_col: str = "text", least_score: float = 0.05) -> DataFrame:
    """``docs`` without the rows whose language stays undetermined or scores under ``least_score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_text(x.as_py(), model) for x in batch.column(text_col)]
            yield batch.filter(pa.array([lang != UNDETERMINED and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id, written as text, leaves ``remainder``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(modulus)) == remainder, F.lit(False))
