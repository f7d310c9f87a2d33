r"""Near-duplicate detection: one-permutation hashing, banded buckets, star-shaped edges.

A text's set holds its distinct shingles (runs of ``words`` words; fewer words
make one shingle). Texts are linked if their sets' Jaccard similarity reaches
``similarity``; a group is what links connect.

1. Sketch. One hash per shingle. The hash's high part picks one of ``bands *
   rows`` bins and the smallest hash of a bin is its value. Empty bins borrow
   from a filled bin in a fixed random order of their own (optimal
   densification), so sketches of small sets stay comparable.
2. Equal sets. Texts with the same 128-bit digest of the whole set are one
   vertex, named by a number of its own, from here on, however many copies there are.
3. Stars. Vertices that agree in all rows of a band share a bucket. In each
   bucket only the vertex that meets most others over all its buckets (the hub;
   ties go to the last by number) is paired with the others, so pairs grow with
   the bucket, not with its square. Sizes alone rule out most pairs that can't
   reach the similarity.
4. Confirmation on full sets, word by word from the texts, and components of the
   links. A hub's text is sent once for each slice of its pairs.
5. What stars may miss: vertices of one bucket that are in different components
   after that. Every member of a bucket is in the cluster of its hub. In
   clusters that span components, members outside the largest component meet all
   members of others. Their sets are told by how they differ from the hub's, so
   the exact similarity takes a few numbers, and only links come out of the join.
   After it, each pair of a bucket is connected or has been compared.

Two texts of similarity s share a bucket with probability 1-(1-s^rows)^bands;
with the defaults 1 - 5e-6 at 0.8, and more above. Nothing is capped or dropped.

Null texts, and texts without words, have an empty set and are linked with
nothing. Each row gives one row; an empty table gives none. Rows that repeat an
id keep their own texts; a component's id is its smallest document id that isn't
null. ``drop_near_duplicates`` keeps exactly one row of each group: the one of
the smallest id (null last), then text key, then the hash of all its columns.
Other columns of the input, whatever their names, are not looked at. Memory
follows one group of texts, or one very long text and its hub's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import connected_components
from .joins import join_hot, join_sliced
from .textcore import group_words, mix, pair_hashes, text_groups, word_hashes

_U = np.uint64
_CACHE: dict = {}


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; all words as one run if they are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    h = words[: len(words) - width + 1]
    for k in range(1, width):
        h = pair_hashes(h, words[k : len(words) - width + 1 + k])
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _borrow_order(bins: int) -> np.ndarray:
    """For each bin, the rank of every bin in its own random order."""
    if bins not in _CACHE:
        _CACHE[bins] = np.array([np.random.default_rng([97, bins, i]).permutation(bins) for i in range(bins)], dtype=np.uint16 if bins < 65536 else np.uint32)
    return _CACHE[bins]


def sketch(shingles: np.ndarray, bins: int) -> np.ndarray:
    """One value per bin; ``shingles`` are sorted, so a bin's first is its smallest."""
    bin_of = ((shingles >> _U(32)) * _U(bins)) >> _U(32)
    first = np.concatenate(([True], bin_of[1:] != bin_of[:-1]))
    filled = bin_of[first].astype(np.int64)
    out = np.zeros(bins, dtype=np.uint64)
    out[filled] = shingles[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        lender = filled[_borrow_order(bins)[empty][:, filled].argmin(axis=1)]
        out[empty] = out[lender]
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = values.reshape(bands, rows)
    h = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(rows):
        h = pair_hashes(h, table[:, k])
    return h


def _sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, digest (null: empty set), keys (null: empty set)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for raw in text_groups(x.as_py() for x in batch.column("text")):
                data, _, starts, ends, first = group_words(raw, lower=True)
                hashes = word_hashes(data, starts, ends)
                sizes, digests, keys = [], [], []
                for i in range(len(raw)):
                    own = shingle_hashes(hashes[first[i] : first[i + 1]], words)
                    sizes.append(len(own))
                    if len(own):
                        digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                        keys.append(band_keys(sketch(own, bands * rows), bands, rows).view(np.int64))
                    else:
                        digests.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(at, len(raw)),
                        "text_key": batch.column("text_key").slice(at, len(raw)),
                        "n_shingles": pa.array(sizes, pa.int64()),
                        "digest": pa.array(digests, pa.binary()),
                        "keys": pa.array(keys, pa.list_(pa.int64())),
                    }
                )
                at += len(raw)

    return docs.mapInArrow(run, f"doc_id {id_type}, text_key long, n_shingles long, digest binary, keys array<long>")


def exact_shingles(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves; white space and lower case as in the sketches."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[k:] for k in range(min(width, len(words)))), strict=False))


def _numbers(shingles: set[tuple[bytes, ...]]) -> set[int]:
    return {xxhash.xxh3_64_intdigest(b" ".join(x)) - (1 << 63) for x in shingles}


def _with_sets(pairs: DataFrame, texts: DataFrame, words: int, schema: str, row):
    """For pairs (a, b): rows of ``schema`` made from both full sets by ``row(a, b, set_a, set_b)``, None for no row.

    b's set is kept while b repeats, so a hub's text is cut into words once per run of pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, set] = (None, set())
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
        for batch in batches:
            rows = []
            for a, b, text_a, text_b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if held[0] != b:
                    held = b, exact_shingles(text_b.as_py(), words)
                made = row(a, b, exact_shingles(text_a.as_py(), words), held[1])
                if made is not None:
                    rows.append(made)
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)], names=names)

    pairs = cut(pairs)
    joined = join_sliced(pairs.join(texts.toDF("a", "text_a"), "a"), texts.toDF("b", "text_b"), "b", F.col("a"), pairs)
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def linked(a: int, b: int, x: set, y: set) -> tuple[int, int] | None:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return None
        common = len(x & y)
        return (a, b) if 100 * common >= percent * (len(x) + len(y) - common) else None

    return _with_sets(pairs, texts, words, "a long, b long", linked)


def _differences(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """For pairs (a, b): sizes of both sets, what b's has more (``lost``) and what a's has more (``new``), as hashes of the shingles."""

    def differing(a: int, b: int, x: set, y: set) -> tuple:
        return a, b, len(x), len(y), sorted(_numbers(y - x)), sorted(_numbers(x - y))

    return _with_sets(pairs, texts, words, "a long, b long, n long, hub_n long, lost array<long>, new array<long>", differing)


def _links_inside(clusters: DataFrame, percent: int) -> DataFrame:
    """Links between different components of the same cluster, as (a, b).

    ``clusters`` (hub, vertex, comp, largest, slices, n, hub_n, lost, new) tells
    each set by how it differs from its hub's, which gives the exact size of any
    two members' intersection. Members outside a cluster's largest component
    meet all others, dealt in slices of the cluster so that a large one fills
    many tasks.
    """
    rows = cut(clusters)
    left = rows.where("comp != largest").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    left = left.select("hub", "slice", *[F.col(c).alias(f"{c}_1") for c in ("vertex", "comp", "n", "lost", "new")], "hub_n")
    right = rows.withColumn("slice", F.pmod(F.xxhash64("vertex"), F.col("slices")).cast("int"))
    right = right.select("hub", "slice", *[F.col(c).alias(f"{c}_2") for c in ("vertex", "comp", "n", "lost", "new")])
    both = F.col("n_1") + F.col("n_2")
    most = F.col("hub_n") - F.greatest(F.size("lost_1"), F.size("lost_2")) + F.least(F.size("new_1"), F.size("new_2"))
    common = F.col("hub_n") - F.size("lost_1") - F.size("lost_2") + F.size(F.array_intersect("lost_1", "lost_2")) + F.size(F.array_intersect("new_1", "new_2"))
    on = (F.col("comp_1") != F.col("comp_2")) & ((100 + percent) * most >= percent * both) & ((100 + percent) * common >= percent * both)
    left, right = left.alias("x"), right.alias("y")
    found = left.join(right, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.slice") == F.col("y.slice")) & on)
    return found.select(F.col("vertex_1").alias("a"), F.col("vertex_2").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 40, rows: int = 6, slice_rows: int = 1000) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_shingles, component_id, kept, component``.

    ``text_key`` is Spark's xxhash64 of the text, to find the row again;
    ``component`` names the group, also where all its ids are null, and is null
    for an empty set.
    """
    percent = round(100 * similarity)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    base = cut(_sketches(source, words, bands, rows))
    # A vertex is a number: shorter than its digest, and no two digests share it.
    reps = cut(
        base.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.min("doc_id").alias("low"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
        .select(F.monotonically_increasing_id().alias("vertex"), "digest", F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key"), "low", "keys", "n", "copies")
    )

    rows_of = reps.select("vertex", "n", F.explode("keys").alias("key"))
    crowded = cut(rows_of.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = cut(join_hot(rows_of, crowded, "key", "size"))
    weights = members.groupBy("vertex").agg(F.sum("size").alias("weight"))
    members = cut(members.join(weights, "vertex").select("key", "vertex", "n", "weight"))

    def sizes_allow(a: str, b: str):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    hubs = members.groupBy("key").agg(F.max(F.struct("weight", "vertex", "n")).alias("hub"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("size"))
    hubs = cut(hubs.select("key", F.col("hub.vertex").alias("hub"), F.col("hub.n").alias("hub_n"), ((F.col("size") > 2) | sizes_allow("least", "most")).alias("wanted"), "size"))
    members = join_hot(members.drop("weight"), hubs, "key", "size")
    cluster_rows = cut(members.groupBy("vertex", "n", "hub", "hub_n").agg(F.max("wanted").alias("wanted")))
    stars = cluster_rows.where((F.col("vertex") != F.col("hub")) & sizes_allow("n", "hub_n")).select(F.col("vertex").alias("a"), F.col("hub").alias("b"))

    # Texts are fetched once, for the vertices of buckets in which sizes allow a link.
    wanted = cluster_rows.where("wanted").select("vertex").distinct().join(reps.select("vertex", "doc_id", "text_key"), "vertex")
    texts = source.toDF("i", "text", "k").join(wanted, (F.col("i").eqNullSafe(F.col("doc_id"))) & (F.col("k") == F.col("text_key")))
    texts = cut(texts.select("vertex", "text").dropDuplicates(["vertex"]))

    links = cut(_confirm(stars, texts, words, percent))
    comps = connected_components(links)

    def comp_of(df: DataFrame, node: str, out: str) -> DataFrame:
        return df.join(comps.toDF("_node", out), F.col(node) == F.col("_node"), "left").drop("_node").withColumn(out, F.coalesce(out, node))

    def joined_by(fresh: DataFrame) -> DataFrame:
        """Components after ``fresh`` links between members of old components."""
        ends = comp_of(comp_of(fresh, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        moved = connected_components(ends).toDF("_from", "to")
        nodes = comps.union(fresh.select("a", "a")).union(fresh.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))
        nodes = nodes.join(moved, F.col("component") == F.col("_from"), "left")
        return cut(nodes.select("node", F.coalesce("to", "component").alias("component")))

    # Vertices that share a bucket are in the cluster of its hub. Clusters that span components are looked into.
    clusters = cut(comp_of(cluster_rows.select("vertex", "hub"), "vertex", "comp"))
    sizes = clusters.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("hub").agg(F.max(F.struct("c", "comp")).alias("largest"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    sizes = cut(sizes.select("hub", F.col("largest.comp").alias("largest"), F.ceil(F.col("c") / slice_rows).cast("int").alias("slices"), "c"))
    if not sizes.isEmpty():
        clusters = cut(join_hot(clusters, sizes, "hub", "c").drop("c"))
        apart = _differences(clusters.where("vertex != hub").select(F.col("vertex").alias("a"), F.col("hub").alias("b")), texts, words)
        apart = cut(apart.withColumnsRenamed({"a": "vertex", "b": "hub"}))
        none = F.array().cast("array<long>")
        own = apart.groupBy("hub").agg(F.max("hub_n").alias("hub_n")).select(F.col("hub").alias("vertex"), "hub", F.col("hub_n").alias("n"), "hub_n", none.alias("lost"), none.alias("new"))
        fresh = cut(_links_inside(clusters.join(apart.unionByName(own), ["hub", "vertex"]), percent).distinct())
        if not fresh.isEmpty():
            comps = joined_by(fresh)

    lows = cut(comp_of(reps.select("vertex", "digest", "low", "copies"), "vertex", "comp"))
    lowest = cut(lows.groupBy("comp").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size")))
    groups = cut(join_hot(lows.drop("low", "vertex"), lowest, "comp", "size").drop("size"))
    full = join_hot(base.drop("keys").where(F.col("digest").isNotNull()), groups, "digest", "copies").select("doc_id", "text_key", "n_shingles", "component_id", F.col("comp").alias("component"))
    empty = base.where(F.col("digest").isNull()).select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return full.unionByName(empty).select("doc_id", "text_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with exactly one row of each group, also where rows or ids repeat; all columns as they are."""
    found = cut(near_duplicates(docs, id_col, text_col, **options).where(F.col("component").isNotNull()))
    at = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")
    best = found.groupBy("component").agg(F.min(at).alias("at")).select(F.col("at.doc_id").alias("_best_id"), F.col("at.text_key").alias("_best_key"))
    rows = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("_rows")).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    verdicts = rows.join(best, F.col("_id").eqNullSafe(F.col("_best_id")) & (F.col("_key") == F.col("_best_key")), "left")
    verdicts = cut(verdicts.select("_id", "_key", F.col("_best_key").isNotNull().alias("_stays"), "_rows").where("_rows > 1 or not _stays"))
    key = F.xxhash64(docs[text_col].cast("string"))

    def on(side: DataFrame):
        return docs[id_col].eqNullSafe(side["_id"]) & (key == side["_key"])

    single = docs.join(verdicts, on(verdicts), "left_anti")
    repeated = verdicts.where("_stays")
    if repeated.isEmpty():
        return single
    kinds = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    chosen = docs.join(repeated, on(repeated)).groupBy(repeated["_id"], repeated["_key"]).agg(F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.xxhash64(*[docs[c] for c in kinds])).alias("_row"))
    return single.unionByName(chosen.select("_row.*"))
