r"""Masked pseudo-likelihood by a bidirectional window network trained in numpy.

Every token (lower-cased run of non-white-space) is predicted from the
``reach`` tokens on each side of it, with itself left out of all counts; the
sum of the log-probabilities scores a text. A word's probability has two parts:

* Its cell, by the network. The ``own`` most frequent words have cells of their
  own, all others share ``suffixes`` cells by their last three bytes. Cells are
  the network's input, so every word has an embedding on the left and one on the
  right, and its output: summed embeddings of the neighbours, tanh, then a softmax
  over classes of ``members`` cells and one over the members of the class, both of them given
  the context.
* The word in its cell, by its own count over the whole corpus. A word that
  occurs nowhere else takes the share of words that occur once, spread over all
  spellings by a byte-pair model.

Gathered from all documents: counts of every word (a distributed table that
grows with the corpus), counts of byte pairs, and the network. Each task trains
on its tokens, in rounds; after a round the tasks' weights are averaged by their
numbers of tokens, block by block in the cluster. The first round takes a
sixteenth of every group of texts, the last one all tokens. The driver holds one
network, ``vocabulary`` words and some sums by cell. That vocabulary travels
with the model, a text's other words are joined with the distributed counts;
``vocabulary`` decides only what is joined, no score.

Null texts and texts without words have no tokens, sum 0 and a null mean. An
empty corpus gives an empty result. Each row gives one row, repeated rows and
null ids too; other columns are not looked at. Memory follows one group of texts
(two megabytes, or one longer text). Weights depend in their last digits on how
rows are dealt to tasks; all counts do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .textcore import SPACES, group_words, mix, text_groups, word_hashes

_U = np.uint64
#: Logarithms of joined counts are summed as whole multiples of this.
FIXED = 2.0**-32
_BLOCK = 1 << 14


@dataclass(frozen=True)
class Shape:
    own: int = 1024
    suffixes: int = 1024
    members: int = 32
    reach: int = 2
    hidden: int = 24
    vocabulary: int = 65_536
    batch: int = 4096
    rate: float = 0.1
    rounds: tuple[float, ...] = (0.0625, 1.0)
    seed: int = 5

    @property
    def cells(self) -> int:
        return self.own + self.suffixes

    @property
    def classes(self) -> int:
        return self.cells // self.members


class Network:
    """The weights, and Adagrad steps over batches of (neighbours' cells, cell)."""

    def __init__(self, shape: Shape, weights: list[np.ndarray]):
        self.shape, self.weights = shape, weights

    @staticmethod
    def shapes(s: Shape) -> list[tuple[int, ...]]:
        """Embeddings to the left and to the right, hidden offsets, class weights and offsets, member weights and offsets."""
        return [(2 * (s.cells + 1), s.hidden), (s.hidden,), (s.hidden, s.classes), (s.classes,), (s.classes, s.hidden, s.members), (s.classes, s.members)]

    @classmethod
    def fresh(cls, shape: Shape, totals: np.ndarray) -> Network:
        """Small random weights around the cells' shares of all tokens."""
        rng = np.random.default_rng(shape.seed)
        sizes = cls.shapes(shape)
        share = (totals + 0.5).reshape(shape.classes, shape.members)
        offsets = np.log(share.sum(axis=1) / share.sum()), np.log(share / share.sum(axis=1, keepdims=True))
        draw = lambda size, scale: rng.normal(0, scale, size)
        made = [draw(sizes[0], 0.2), np.zeros(sizes[1]), draw(sizes[2], 0.1), offsets[0], draw(sizes[4], 0.1), offsets[1]]
        return cls(shape, [x.astype(np.float32) for x in made])

    @classmethod
    def of(cls, shape: Shape, flat: np.ndarray) -> Network:
        out, at = [], 0
        for size in cls.shapes(shape):
            n = int(np.prod(size))
            out.append(flat[at : at + n].reshape(size).astype(np.float32))
            at += n
        return cls(shape, out)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.weights])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        out = self.weights[0].take(near[:, 0], axis=0)
        for k in range(1, near.shape[1]):
            out += self.weights[0].take(near[:, k], axis=0)
        out += self.weights[1]
        return np.tanh(out, out=out)

    def log_probs(self, near: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Log-probability of each token's cell given its neighbours' cells."""
        s, (_, _, w1, c1, w2, c2) = self.shape, self.weights
        out = np.empty(len(cell), dtype=np.float64)
        for at in range(0, len(cell), _BLOCK):
            order = at + _by(cell[at : at + _BLOCK] // s.members)
            h = self.hidden(near.take(order, axis=0))
            kind, member = np.divmod(cell[order], s.members)
            logits = h @ w1
            logits += c1
            logp = _log_share(logits, kind).astype(np.float64)
            for k, x, y in _segments(kind):
                logits = h[x:y] @ w2[k]
                logits += c2[k]
                logp[x:y] += _log_share(logits, member[x:y])
            out[order] = logp
        return out

    def train(self, near: np.ndarray, cell: np.ndarray, memory: list[np.ndarray]) -> None:
        """One Adagrad step; ``memory`` holds the squared slopes so far."""
        s, p = self.shape, self.weights
        order = _by(cell // s.members)
        near, (kind, member) = near.take(order, axis=0), np.divmod(cell[order], s.members)
        every = np.arange(len(kind))
        h = self.hidden(near)
        slope = h @ p[2]
        slope += p[3]
        slope = _softmax(slope)
        slope.ravel()[every * s.classes + kind] -= 1
        back = slope @ p[2].T
        self._step(2, memory, h.T @ slope)
        self._step(3, memory, slope.sum(axis=0))
        segments = _segments(kind)
        inner = np.empty((len(kind), s.members), dtype=np.float32)
        for k, x, y in segments:
            np.matmul(h[x:y], p[4][k], out=inner[x:y])
        at, starts = np.array([k for k, _, _ in segments]), np.array([x for _, x, _ in segments])
        inner += p[5].take(kind, axis=0)
        inner = _softmax(inner)
        inner.ravel()[every * s.members + member] -= 1
        slopes = np.empty((len(at), s.hidden, s.members), dtype=np.float32)
        for i, (k, x, y) in enumerate(segments):
            back[x:y] += inner[x:y] @ p[4][k].T
            np.matmul(h[x:y].T, inner[x:y], out=slopes[i])
        self._step(4, memory, slopes, at)
        self._step(5, memory, np.add.reduceat(inner, starts, axis=0), at)
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        self._step(1, memory, back.sum(axis=0))
        # Slopes of the neighbours' embeddings, added up by row.
        flat = near.ravel()
        order = _by(flat) if len(p[0]) <= 1 << 16 else np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        self._step(0, memory, np.add.reduceat(back.take(order // near.shape[1], axis=0), starts, axis=0), flat[starts])

    def _step(self, which: int, memory: list[np.ndarray], slope: np.ndarray, at=slice(None)) -> None:
        if not isinstance(at, slice) and len(at) == len(memory[which]):
            at = slice(None)
        seen = slope * slope
        seen += memory[which][at]
        memory[which][at] = seen
        seen += 1e-6
        np.sqrt(seen, out=seen)
        slope *= self.shape.rate
        slope /= seen
        self.weights[which][at] -= slope


def _by(numbers: np.ndarray) -> np.ndarray:
    """The order of small numbers; numpy sorts sixteen bits in linear time."""
    return np.argsort(numbers.astype(np.uint16), kind="stable")


#: Differences of logits whose exponentials float32 holds as normal numbers.
_SPAN = 60.0


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` becomes the exponentials of its rows less what each row was lowered by; that, and the rows' sums.

    All rows are lowered by the same number where their values lie close enough
    together, since a row's own maximum takes numpy longer than its exponentials.
    """
    top = x.max(keepdims=True)
    if not top[0, 0] - x.min() <= _SPAN:
        top = x.max(axis=1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    return top[:, 0], x @ np.ones(x.shape[1], dtype=x.dtype)


def _softmax(x: np.ndarray) -> np.ndarray:
    _, total = _exp(x)
    x *= (1 / total)[:, None]
    return x


def _log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at one place; ``x`` is used up."""
    own = x[np.arange(len(x)), at]
    top, total = _exp(x)
    return own - top - np.log(total)


def _segments(kind: np.ndarray) -> list[tuple[int, int, int]]:
    """(class, start, end) of the runs of a sorted array."""
    new = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))).tolist()
    return [(int(kind[x]), x, y) for x, y in zip(new, [*new[1:], len(kind)], strict=True)]


@dataclass(frozen=True)
class Model:
    shape: Shape
    own_hashes: np.ndarray  # sorted hashes of the words with cells of their own
    own_cells: np.ndarray  # their cells
    hashes: np.ndarray  # sorted vocabulary
    counts: np.ndarray  # of the vocabulary's words
    totals: np.ndarray  # tokens by cell
    once: np.ndarray  # words that occur once, by cell
    spelling: np.ndarray  # log-probability of a byte after another; 0 is a word's border
    network: Network | None = None
    rare: DataFrame | None = None  # ``word, c`` of all words beyond the vocabulary that occur twice or more


@dataclass(frozen=True)
class Tokens:
    """The words of some texts."""

    hashes: np.ndarray
    suffix: np.ndarray
    first: np.ndarray  # each text's first word
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def tokens_of(raw: list[bytes]) -> Tokens:
    data, _, starts, ends, first = group_words(raw, lower=True)
    sizes, padded = ends - starts, np.concatenate((np.zeros(2, dtype=np.uint8), data))
    suffix = padded.take(ends + 1).astype(np.int64)
    for k in (2, 3):
        suffix <<= 8
        suffix += padded.take(ends + (2 - k)) * (sizes >= k)
    return Tokens(word_hashes(data, starts, ends), suffix, first, data, starts, ends)


def suffix_cells(suffix: np.ndarray, shape: Shape) -> np.ndarray:
    return shape.own + (mix(suffix.astype(np.uint64) + _U(1)) % _U(shape.suffixes)).astype(np.int64)


def cells_of(tokens: Tokens, own_hashes: np.ndarray, own_cells: np.ndarray, shape: Shape) -> np.ndarray:
    if not len(own_hashes):
        return suffix_cells(tokens.suffix, shape)
    at = np.minimum(np.searchsorted(own_hashes, tokens.hashes), len(own_hashes) - 1)
    out = own_cells.take(at)
    others = np.flatnonzero(own_hashes.take(at) != tokens.hashes)
    out[others] = suffix_cells(tokens.suffix.take(others), shape)
    return out


def neighbours(cells: np.ndarray, first: np.ndarray, shape: Shape, some: np.ndarray | None = None) -> np.ndarray:
    """The embeddings' rows of the cells around each token (or ``some``), left ones first; beyond a text's borders a row of its own."""
    r, texts, side = shape.reach, len(first) - 1, shape.cells + 1
    at = np.arange(len(cells)) + r * (np.repeat(np.arange(texts), np.diff(first)) + 1)
    padded = np.full(len(cells) + r * (texts + 1), shape.cells, dtype=np.int32)
    padded[at] = cells
    at = at if some is None else at[some]
    return np.stack([padded[at + k] + (side if k > 0 else 0) for k in (*range(-r, 0), *range(1, r + 1))], axis=1)


#: Every byte, white space as 0.
_UNSPACED = np.where(SPACES, 0, np.arange(256)).astype(np.uint8)


def byte_pairs(tokens: Tokens) -> np.ndarray:
    """For every place of the data, its byte and the one after it as one number; borders of words are 0."""
    data = np.zeros(len(tokens.data) + 2, dtype=np.uint16)
    data[1:-1] = _UNSPACED[tokens.data]
    return data[:-1] << 8 | data[1:]


def word_counts(texts: DataFrame, shape: Shape) -> DataFrame:
    """``word`` (hash), ``suffix``, ``c`` over all texts."""
    full = 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(counts: np.ndarray, step: int = 500_000) -> Iterator[pa.RecordBatch]:
            for at in range(0, counts.shape[1], step):
                part = counts[:, at : at + step]
                yield pa.RecordBatch.from_pydict({"word": pa.array(part[0].view(np.int64)), "suffix": pa.array(part[1].astype(np.int32)), "c": pa.array(part[2].astype(np.int64))})

        def merged() -> np.ndarray:
            h, s, c = np.concatenate(held, axis=1)
            order = np.argsort(h, kind="stable")
            h, s, c = h[order], s[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return np.stack([h[new], s[new], np.add.reduceat(c, new)])

        size = 0
        for batch in batches:
            for raw in text_groups(x.as_py() for x in batch.column("text")):
                tokens = tokens_of(raw)
                if not len(tokens.hashes):
                    continue
                kinds, at, counts = np.unique(tokens.hashes, return_index=True, return_counts=True)
                held.append(np.stack([kinds, tokens.suffix[at].astype(np.uint64), counts.astype(np.uint64)]))
                size += len(kinds)
                if size > 2 * full:
                    held[:] = [merged()]
                    size = held[0].shape[1]
                    if size > full:
                        yield from out(held[0])
                        held.clear()
                        size = 0
        if held:
            yield from out(merged())

    rows = texts.mapInArrow(run, "word long, suffix int, c long")
    return rows.groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("c").alias("c"))


def train_round(texts: DataFrame, network: Network, own: tuple[np.ndarray, np.ndarray], share: float, spelled: bool = True) -> tuple[Network, np.ndarray]:
    """The average of the networks that the tasks train on ``share`` of their tokens, and counts of byte pairs (0 unless ``spelled``)."""
    shape, start = network.shape, network.flat()
    blocks = -(-len(start) // _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network.of(shape, start)
        memory = [np.zeros_like(x) for x in mine.weights]
        pairs, seen, groups = np.zeros(1 << 16, dtype=np.float64), 0, 0
        for batch in batches:
            for raw in text_groups(x.as_py() for x in batch.column("text")):
                tokens = tokens_of(raw)
                if not len(tokens.hashes):
                    continue
                if spelled:
                    pairs += np.bincount(byte_pairs(tokens), minlength=1 << 16)
                cells = cells_of(tokens, *own, shape)
                order = np.random.default_rng([shape.seed, groups]).permutation(len(cells))[: max(1, round(share * len(cells)))]
                near, drawn = neighbours(cells, tokens.first, shape, order), cells[order]
                for at in range(0, len(order), shape.batch):
                    mine.train(near[at : at + shape.batch], drawn[at : at + shape.batch], memory)
                seen += len(order)
                groups += 1
        if seen:
            made = mine.flat().astype(np.float64) * seen
            rows = [(k, float(seen), made[k * _BLOCK : (k + 1) * _BLOCK]) for k in range(blocks)]
            rows += [(blocks + k, 1.0, pairs[k * _BLOCK : (k + 1) * _BLOCK]) for k in range((1 << 16) // _BLOCK)]
            yield _block_rows(rows)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, seen, made in zip(batch.column("block").to_pylist(), batch.column("seen").to_pylist(), batch.column("made").to_pylist(), strict=True):
                held = sums.setdefault(k, [0.0, 0.0])
                held[0], held[1] = held[0] + seen, held[1] + np.frombuffer(made, dtype=np.float64)
        yield _block_rows([(k, *held) for k, held in sorted(sums.items())])

    schema = "block int, seen double, made binary"
    found = {r["block"]: (r["seen"], np.frombuffer(r["made"], dtype=np.float64)) for r in texts.mapInArrow(run, schema).repartition(blocks, "block").mapInArrow(total, schema).collect()}
    if not found:
        return network, np.zeros(1 << 16)
    flat = np.concatenate([found[k][1] / found[k][0] for k in range(blocks)])
    return Network.of(shape, flat), np.concatenate([found[blocks + k][1] for k in range((1 << 16) // _BLOCK)])


def _block_rows(rows: list[tuple[int, float, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int32()), "seen": pa.array([r[1] for r in rows], pa.float64()), "made": pa.array([np.asarray(r[2]).tobytes() for r in rows], pa.binary())})


def frequent_words(counts: DataFrame, most: int) -> list:
    """The most frequent words, at most ``most``, by count and then hash.

    Words are binned by count, exactly up to 4096 and in steps of a
    sixty-fourth of a power of two above; the bins that fit as a whole are
    taken. So the driver gets some thousand bins and then only these words.
    """
    binned = counts.withColumn("bin", F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2("c") * 64)))
    sizes = sorted(((r["bin"], r["count"]) for r in binned.groupBy("bin").count().collect()), reverse=True)
    taken, least = 0, None
    for k, n in sizes:
        if taken + n > most:
            break
        taken, least = taken + n, k
    if least is None:
        return []
    return sorted(binned.where(F.col("bin") >= least).select("word", "suffix", "c").collect(), key=lambda r: (-r["c"], r["word"]))


def learn(docs: DataFrame, text_col: str = "text", shape: Shape = Shape()) -> Model:
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    counts = cut(word_counts(texts, shape))
    top = frequent_words(counts, shape.vocabulary)
    words = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64)
    amount = np.array([r["c"] for r in top], dtype=np.float64)
    suffix = np.array([r["suffix"] for r in top], dtype=np.int64)
    n_own = min(len(top), shape.own)
    by_hash = np.argsort(words[:n_own])
    own = words[:n_own][by_hash], by_hash.astype(np.int64)

    # Three bytes make 16 million suffixes at most; the cells' sums are made from far fewer that occur.
    totals, once = np.zeros(shape.cells), np.zeros(shape.cells)
    sums = counts.groupBy("suffix").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).mapInArrow(_cell_sums(shape), "cell int, c long, once long")
    for r in sums.groupBy("cell").agg(F.sum("c").alias("c"), F.sum("once").alias("once")).collect():
        totals[r["cell"]], once[r["cell"]] = r["c"], r["once"]
    shared = suffix_cells(suffix[:n_own], shape)
    np.subtract.at(totals, shared, amount[:n_own])
    np.subtract.at(once, shared, amount[:n_own] == 1)
    totals[:n_own] = amount[:n_own]

    network, pairs = Network.fresh(shape, totals), np.zeros(1 << 16)
    for k, share in enumerate(shape.rounds, 1):
        network, pairs = train_round(texts, network, own, share, spelled=k == len(shape.rounds))
    pairs = pairs.reshape(256, 256)
    pairs[0, 0] = 0
    spelling = np.log((pairs + 1) / (pairs + 1).sum(axis=1, keepdims=True))
    # The vocabulary takes whole bins of counts, so the words beyond it are those below its least count.
    rare = counts.where(F.col("c") > 1).select("word", "c")
    if len(top):
        rare = rare.where(F.col("c") < int(amount.min()))
    order = np.argsort(words)
    return Model(shape, *own, words[order], amount[order], totals, once, spelling, network, rare)


def _cell_sums(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = suffix_cells(batch.column("suffix").to_numpy().astype(np.int64), shape)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.astype(np.int32)), "c": batch.column("c"), "once": batch.column("once")})

    return run


def _near_scores(raw: list[bytes], model: Model, seen: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tokens]:
    """Of every token: log-probability as far as the model alone tells, whether its count must be joined, and what a joined count replaces.

    ``seen`` is 1 if the texts are part of the corpus, whose own token is left out, else 0.
    """
    tokens = tokens_of(raw)
    if not len(tokens.hashes):
        return np.zeros(0), np.zeros(0, dtype=bool), np.zeros(0), tokens
    shape = model.shape
    cells = cells_of(tokens, model.own_hashes, model.own_cells, shape)
    scores = model.network.log_probs(neighbours(cells, tokens.first, shape), cells)
    new = model.once + 1.0
    letters = np.concatenate(([0.0], np.cumsum(model.spelling.ravel()[byte_pairs(tokens)])))
    novel = np.log(new[cells]) + letters[tokens.ends + 1] - letters[tokens.starts]
    alone = cells < shape.own
    scores -= np.where(alone, 0.0, np.log(np.maximum(model.totals - seen, 0.0) + new)[cells])
    known = alone
    if len(model.hashes):
        at = np.minimum(np.searchsorted(model.hashes, tokens.hashes), len(model.hashes) - 1)
        known = alone | (model.hashes[at] == tokens.hashes)
        left = np.where(known, model.counts[at] - seen, 0.0)
        scores += np.where(alone, 0.0, np.where(known & (left > 0), np.log(np.maximum(left, 1.0)), novel))
    else:
        scores += novel
    return scores, ~known, novel, tokens


def _fixed(x: Column) -> Column:
    return F.round(x / FIXED).cast("long")


def token_scores(raw: list[bytes], model: Model, in_corpus: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of every token of a few texts, and each text's first token; on the driver."""
    scores, beyond, novel, tokens = _near_scores(raw, model, int(in_corpus))
    if beyond.any():
        hashes = tokens.hashes.view(np.int64)
        wanted = model.rare.sparkSession.createDataFrame([(x,) for x in np.unique(hashes[beyond]).tolist()], "word long")
        left = {r["word"]: r["c"] - int(in_corpus) for r in model.rare.join(wanted, "word").collect()}
        for i in np.flatnonzero(beyond):
            if left.get(int(hashes[i]), 0) > 0:
                scores[i] += np.log(left[int(hashes[i])]) - novel[i]
    return scores, tokens.first


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", in_corpus: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, log_prob, mean_log_prob``.

    ``in_corpus`` says that ``docs`` are among the documents that were learned
    from, so that each token leaves itself out.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    near, seen = replace(model, rare=None), int(in_corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raw in text_groups(x.as_py() for x in batch.column("text")):
                scores, beyond, novel, tokens = _near_scores(raw, near, seen)
                first = tokens.first
                sums = np.array([scores[a:b].sum() for a, b in zip(first[:-1], first[1:], strict=True)])
                upto = pa.array(np.concatenate(([0], np.cumsum(beyond)))[first], pa.int32())
                words = pa.ListArray.from_arrays(upto, pa.array(tokens.hashes[beyond].view(np.int64)))
                other = pa.ListArray.from_arrays(upto, pa.array(novel[beyond].astype(np.float32)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(raw)), "n_tokens": pa.array(np.diff(first), pa.int64()), "near": pa.array(sums, pa.float64()), "words": words, "novel": other})
                at += len(raw)

    rows = source.mapInArrow(run, f"doc_id {id_type}, n_tokens long, near double, words array<long>, novel array<float>")
    rows = cut(rows).withColumn("row", F.monotonically_increasing_id())
    # Words beyond the vocabulary are rare, so no count has many rows to meet.
    tokens = rows.select("row", F.explode(F.arrays_zip("words", "novel")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.novel").alias("novel"))
    far = tokens.join(model.rare.where(F.col("c") > seen), "word").groupBy("row").agg(F.sum(_fixed(F.log(F.col("c") - seen) - F.col("novel"))).alias("far"))
    found = rows.select("row", "doc_id", "n_tokens", "near").join(far, "row", "left")
    total = F.col("near") + F.coalesce(F.col("far"), F.lit(0)) * F.lit(FIXED)
    return found.select("doc_id", "n_tokens", total.alias("log_prob"), (total / F.nullif(F.col("n_tokens"), F.lit(0))).alias("mean_log_prob"))
