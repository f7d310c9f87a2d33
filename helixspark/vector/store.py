"""A vector table per space: versioned Parquet with upsert, delete and nearest-neighbour search.

A table is a list of parts, folders that never change once written: rows, or the
chunk ids of a deletion. An upsert or deletion writes only its own rows, to a
folder with a name of its own, and then a commit file that lists the parts of the
new version. The commit file is created only if no other writer made it first;
who comes second reads the other's commit and adds its part to that, so no
writer can undo or overwrite what another has committed. A row is there if no
later part holds its chunk id. ``optimize_index`` merges all parts to one.

Readers see whole versions. All file access goes through Spark's file systems;
the store's folder must be on one whose ``create`` fails for an existing file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import squared_distance
from .layout import SHARDS, space_path

SCHEMA = "id string, chunk_id string, space_id string, vector array<float>, text string, metadata string"
COLUMNS = ("id", "chunk_id", "space_id", "vector", "text", "metadata")


class ConcurrentWrite(RuntimeError):
    """Another writer made the same file first."""


@dataclass(frozen=True)
class Part:
    """A folder of the table: ``rows``, or only chunk ids that are gone. Cells in it are those of index ``index``."""

    path: str
    version: int
    rows: bool = True
    index: str = ""


@dataclass(frozen=True)
class Commit:
    """What a version's commit file holds; ``index`` names the file with the cells' centres, empty without an index."""

    version: int
    dim: int
    parts: list[Part] = field(default_factory=list)
    index: str = ""


class Files:
    """The few file operations needed, on whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def create(self, path: str, text: str) -> None:
        p, fs = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise ConcurrentWrite(path) from e
            raise
        out.write(bytearray(text.encode()))
        out.close()

    def write(self, path: str, data: bytes) -> None:
        p, fs = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)


class VectorStore:
    def __init__(self, spark: SparkSession, base_path: str, attempts: int = 50):
        self.spark, self.base, self.files, self.attempts = spark, base_path.rstrip("/"), Files(spark), attempts
        self.files.make(self.base)

    # State of a space

    def _path(self, space_id: str) -> str:
        return space_path(self.base, space_id)

    def commit_of(self, space_id: str) -> Commit | None:
        names = self.files.names(f"{self._path(space_id)}/commits")
        if not names:
            return None
        held = json.loads(self.files.read(f"{self._path(space_id)}/commits/{names[-1]}"))
        return Commit(**held | {"parts": [Part(**p) for p in held["parts"]]})

    def _needed(self, space_id: str) -> Commit:
        commit = self.commit_of(space_id)
        if commit is None:
            raise LookupError(f"space {space_id!r} has no table")
        return commit

    def _commit(self, space_id: str, made: Callable[[Commit | None], Commit]) -> Commit:
        """Commits what ``made`` makes of the latest version, again on top of another's if that came first."""
        for _ in range(self.attempts):
            latest = self.commit_of(space_id)
            commit = made(latest)
            try:
                self.files.create(f"{self._path(space_id)}/commits/{commit.version:08d}.json", json.dumps(asdict(commit)))
                return commit
            except ConcurrentWrite:
                continue
        raise ConcurrentWrite(f"space {space_id!r} is written too often")

    def _write(self, space_id: str, rows: DataFrame) -> str:
        """A new folder with ``rows``; nothing refers to it yet."""
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self._path(space_id)}/{name}")
        return name

    def _add(self, space_id: str, name: str, rows: bool, index: str = "") -> None:
        def added(latest: Commit | None) -> Commit:
            if latest is None:
                raise LookupError(f"space {space_id!r} has no table")
            return replace(latest, version=latest.version + 1, parts=[*latest.parts, Part(name, latest.version + 1, rows, index)])

        self._commit(space_id, added)

    def _part(self, space_id: str, part: Part, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self._path(space_id)}/{part.path}")

    def table(self, space_id: str, commit: Commit | None = None) -> DataFrame:
        """A version's rows, the latest ones by default, with ``cell`` (null where the index has none)."""
        commit = commit or self._needed(space_id)
        out = self.spark.createDataFrame([], f"{SCHEMA}, cell int, _version long")
        for part in (p for p in commit.parts if p.rows):
            rows = self._part(space_id, part, f"{SCHEMA}, cell int").withColumn("_version", F.lit(part.version).cast("long"))
            out = out.unionByName(rows if part.index == commit.index else rows.withColumn("cell", F.lit(None).cast("int")))
        later = commit.parts[1:]
        if later:
            # Each later part replaces or deletes its chunk ids in those before it.
            gone = [self._part(space_id, p, "chunk_id string").select(F.col("chunk_id").alias("_gone"), F.lit(p.version).cast("long").alias("_at")) for p in later]
            last = gone[0]
            for more in gone[1:]:
                last = last.unionByName(more)
            last = last.groupBy("_gone").agg(F.max("_at").alias("_at"))
            out = out.join(last, (F.col("chunk_id") == F.col("_gone")) & (F.col("_at") > F.col("_version")), "left_anti")
        return out.drop("_version")

    def centers(self, space_id: str, commit: Commit) -> np.ndarray | None:
        """The centres of the index's cells, one row each."""
        return np.array(json.loads(self.files.read(f"{self._path(space_id)}/{commit.index}")), dtype=np.float64) if commit.index else None

    # Operations

    def ensure_table(self, space_id: str, dim: int) -> None:
        """Creates an empty table if there is none; a table of another dimension is an error."""
        commit = self.commit_of(space_id)
        if commit is None:
            commit = self._commit(space_id, lambda latest: latest and replace(latest, version=latest.version + 1) or Commit(0, dim))
        if commit.dim != dim:
            raise ValueError(f"space {space_id!r} has dimension {commit.dim}, not {dim}")

    def upsert(self, space_id: str, records: DataFrame, dedupe: bool = False) -> int:
        """Replaces all rows of the records' chunk ids by the records; their number.

        Repeated chunk ids are all kept unless ``dedupe``. A vector of another
        size becomes null and its row stays. Only the records are written.
        """
        commit = self._needed(space_id)
        vector = F.col("vector").cast("array<float>")
        batch = records.select(*[F.when(F.size(vector) == commit.dim, vector).alias(c) if c == "vector" else F.col(c).cast("string").alias(c) for c in COLUMNS])
        if dedupe:
            batch = batch.dropDuplicates(["chunk_id"])
        name = self._write(space_id, batch.withColumn("cell", nearest_cell(F.col("vector"), self.centers(space_id, commit))))
        n = self.spark.read.schema(SCHEMA).parquet(f"{self._path(space_id)}/{name}").count()
        if n:
            self._add(space_id, name, True, commit.index)
        else:
            self.files.remove(f"{self._path(space_id)}/{name}")
        return n

    def upsert_json(self, space_id: str, records_json: str) -> int:
        rows = [tuple([float(x) for x in r["vector"]] if c == "vector" else r[c] for c in COLUMNS) for r in json.loads(records_json)]
        return self.upsert(space_id, self.spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>"))) if rows else 0

    def delete_chunks(self, space_id: str, chunk_ids: list[str] | DataFrame) -> int:
        """Deletes rows by chunk id (a list, or a table with ``chunk_id``); the number of ids asked for."""
        self._needed(space_id)
        if isinstance(chunk_ids, list):
            if not chunk_ids:
                return 0
            chunk_ids = self.spark.createDataFrame([(x,) for x in chunk_ids], "chunk_id string")
        name = self._write(space_id, chunk_ids.select(F.col("chunk_id").cast("string").alias("chunk_id")))
        self._add(space_id, name, False)
        return self.spark.read.schema("chunk_id string").parquet(f"{self._path(space_id)}/{name}").count()

    def _replace(self, space_id: str, base: Commit, rows: DataFrame, index: str) -> None:
        """Puts ``rows`` in the place of the parts of ``base``; parts that others added since stay."""
        name = self._write(space_id, rows)

        def merged(latest: Commit | None) -> Commit:
            if latest is None:
                raise LookupError(f"space {space_id!r} has no table")
            since = [p for p in latest.parts if p.version > base.version]
            return Commit(latest.version + 1, latest.dim, [Part(name, base.version, True, index), *since], index)

        self._commit(space_id, merged)

    def create_index(self, space_id: str, cells: int | None = None, sample_rows: int = 100_000, seed: int = 3) -> None:
        """Coarse cells by k-means, fitted on about ``sample_rows`` rows chosen by id hash at most; every row gets a cell."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        commit = self._needed(space_id)
        rows = self.table(space_id, commit).drop("cell")
        filled = rows.where("vector is not null")
        share = min(1.0, sample_rows / max(filled.count(), 1))
        sample = filled.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 31)) < int(share * (1 << 31)))
        n = sample.count()
        if n == 0:
            return
        k = max(1, min(cells or round(n**0.5), n))
        model = KMeans(k=k, seed=seed, featuresCol="f", maxIter=10).fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("f"))) if k > 1 else None
        centers = np.array(model.clusterCenters()) if model else np.zeros((1, commit.dim))
        index = f"index-{uuid.uuid4().hex}.json"
        self.files.create(f"{self._path(space_id)}/{index}", json.dumps(centers.tolist()))
        self._replace(space_id, commit, rows.withColumn("cell", nearest_cell(F.col("vector"), centers)), index)

    def optimize_index(self, space_id: str, rows_per_file: int = 1_000_000) -> None:
        """Merges all parts to one of larger files ordered by cell, gives cells to rows without, and removes what the new version doesn't need."""
        commit = self._needed(space_id)
        rows = self.table(space_id, commit)
        rows = rows.withColumn("cell", F.coalesce("cell", nearest_cell(F.col("vector"), self.centers(space_id, commit))))
        files = max(1, -(-rows.count() // rows_per_file))
        self._replace(space_id, commit, rows.repartitionByRange(files, "cell", "chunk_id").sortWithinPartitions("cell", "chunk_id"), commit.index)
        path, latest = self._path(space_id), self._needed(space_id)
        kept = {p.path for p in latest.parts}
        for part in commit.parts:  # folders that no commit names may be another writer's
            if part.path not in kept:
                self.files.remove(f"{path}/{part.path}")
        for name in self.files.names(f"{path}/commits"):
            if int(name.removesuffix(".json")) <= commit.version:
                self.files.remove(f"{path}/commits/{name}")

    def nearest(self, space_id: str, query: list[float], top_k: int, condition: str | None = None, probes: int | None = None) -> DataFrame:
        """``chunk_id, score, text, metadata, distance``: squared distances, nearest first, ties by chunk id.

        ``condition`` is SQL over the table's columns and applies first. With an
        index, ``probes`` looks only into that many nearest cells (and at rows
        without one); otherwise the search is exact.
        """
        if not query:
            raise ValueError("empty query vector")
        commit = self._needed(space_id)
        rows = self.table(space_id, commit)
        if condition:
            rows = rows.where(F.expr(condition))
        if probes and commit.index:
            order = np.argsort(((self.centers(space_id, commit) - np.array(query)) ** 2).sum(axis=1), kind="stable")
            rows = rows.where(F.col("cell").isNull() | F.col("cell").isin(order[:probes].tolist()))
        q = F.array(*[F.lit(float(x)).cast("float") for x in query])
        near = rows.where("vector is not null").withColumn("distance", squared_distance(F.col("vector"), q)).where("distance is not null")
        return near.orderBy("distance", "chunk_id").limit(top_k).select("chunk_id", (1 - F.col("distance")).alias("score"), "text", "metadata", "distance")

    def nearest_many(self, space_id: str, queries: DataFrame, top_k: int, condition: str | None = None, probes: int | None = None, block: int = 4096) -> DataFrame:
        """``query_id, chunk_id, score, distance`` of the ``top_k`` rows nearest to each of ``queries`` (query_id, vector).

        Queries go to the tasks in blocks of about ``block``; a task compares a
        batch of rows with a block by one matrix product (with ``probes``, each
        cell's rows only with the queries that look into it) and passes on its
        ``top_k`` for each query, so no pair but those is ever a row.
        """
        commit = self._needed(space_id)
        rows = self.table(space_id, commit).where(F.expr(condition) if condition else F.lit(True)).where("vector is not null").select("chunk_id", "vector", "cell")
        queries = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).where(F.size("vector") == commit.dim)
        blocks = max(1, -(-queries.count() // block))
        centers = self.centers(space_id, commit) if probes else None
        id_type = queries.schema["query_id"].dataType.simpleString()
        found = self.spark.createDataFrame([], f"query_id {id_type}, chunk_id string, distance double")
        for k in range(blocks):
            own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow()
            if own.num_rows:
                run = _block_search(own.column("query_id").combine_chunks(), np.array(own.column("vector").to_pylist(), dtype=np.float64), top_k, centers, probes)
                found = found.unionByName(rows.mapInArrow(run, found.schema))
        order = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
        best = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top_k)
        return best.select("query_id", "chunk_id", (1 - F.col("distance")).alias("score"), "distance")

    def probes_for(self, space_id: str, queries: DataFrame, top_k: int, recall: float = 0.95, most: int = 256) -> int:
        """How many cells a query must look into to find the share ``recall`` of its neighbours, told by about ``most`` of ``queries`` and an exact search."""
        commit = self._needed(space_id)
        centers = self.centers(space_id, commit)
        if centers is None:
            raise LookupError(f"space {space_id!r} has no index")
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, queries.count() // most))) == 0).select("query_id", "vector")
        hits = self.nearest_many(space_id, some, top_k).select("query_id", "chunk_id").join(self.table(space_id, commit).select("chunk_id", "cell").where("cell is not null"), "chunk_id")
        cells = {r["query_id"]: r["cells"] for r in hits.groupBy("query_id").agg(F.collect_list("cell").alias("cells")).collect()}
        ranks = []
        for q in some.collect():
            order = ((centers - np.array(q["vector"], dtype=np.float64)) ** 2).sum(axis=1).argsort(kind="stable").argsort(kind="stable")
            ranks += [int(order[c]) + 1 for c in cells.get(q["query_id"], [])]
        return sorted(ranks)[min(len(ranks) - 1, int(recall * len(ranks)))] if ranks else 1

    def search_json(self, space_id: str, query_json: str, top_k: int, condition: str | None = None) -> str:
        return json.dumps([r.asDict() for r in self.nearest(space_id, json.loads(query_json), top_k, condition).collect()])

    def drop_table(self, space_id: str) -> None:
        self._needed(space_id)
        self.files.remove(self._path(space_id))

    def stats(self, space_id: str) -> dict:
        commit = self.commit_of(space_id)
        rows = self.table(space_id, commit).count() if commit else 0
        return {"path": self._path(space_id), "space_id": space_id, "table_rows": rows, "indexed": bool(commit and commit.index and rows), "vector_dim": commit.dim if commit else None, "open_connections": 0, "shard_count": SHARDS}

    def ping(self, space_id: str) -> bool:
        self.files.make(self._path(space_id))
        return True


def nearest_cell(vector: Column, centers: np.ndarray | None) -> Column:
    """The index of the nearest centre; null without centres or vector."""
    if centers is None:
        return F.lit(None).cast("int")

    def cells(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype="Int32")
        filled = vectors.notna().to_numpy()
        if filled.any():
            x = np.stack(vectors[filled].to_list()).astype(np.float64)
            out[filled] = ((centers * centers).sum(axis=1) - 2 * (x @ centers.T)).argmin(axis=1)
        return out

    return F.pandas_udf(cells, "int")(vector)


def _block_search(ids: pa.Array, queries: np.ndarray, top_k: int, centers: np.ndarray | None, probes: int | None):
    """A function of batches (chunk_id, vector, cell) that gives each batch's nearest rows to every query."""
    norms = (queries * queries).sum(axis=1)
    looks = None
    if centers is not None:
        order = ((centers * centers).sum(axis=1) - 2 * (queries @ centers.T)).argsort(axis=1, kind="stable")[:, :probes]
        looks = np.zeros((len(queries), len(centers)), dtype=bool)
        looks[np.arange(len(queries))[:, None], order] = True

    def candidates(rows: np.ndarray, at: np.ndarray, who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, rows, distances) that may be among the nearest: a matrix product chooses them, differences measure them."""
        x = rows[at]
        near = norms[who][:, None] - 2 * (queries[who] @ x.T) + (x * x).sum(axis=1)
        if len(at) > top_k:
            limit = np.partition(near, top_k - 1, axis=1)[:, top_k - 1]
            q, r = np.nonzero(near <= (limit + 1e-6 * (1 + np.abs(limit) + norms[who]))[:, None])
        else:
            q, r = (z.ravel() for z in np.indices(near.shape))
        if len(q):
            yield who[q], at[r], ((queries[who[q]] - x[r]) ** 2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                rows = np.array(batch.column("vector").to_pylist(), dtype=np.float64)
                every = np.arange(len(rows))
                if looks is None:
                    found = list(candidates(rows, every, np.arange(len(queries))))
                else:
                    cells = np.array([-1 if c is None else c for c in batch.column("cell").to_pylist()])
                    found = [f for c in np.unique(cells) for f in candidates(rows, every[cells == c], np.arange(len(queries)) if c < 0 else np.flatnonzero(looks[:, c]))]
                if not found:
                    continue
                q, r, d = (np.concatenate(z) for z in zip(*found, strict=True))
                names = np.array(batch.column("chunk_id").to_pylist(), dtype=object)[r]
                order = np.lexsort((names.astype(str), d, q))
                first = np.searchsorted(q[order], q[order])
                order = order[np.arange(len(order)) - first < top_k]
                yield pa.RecordBatch.from_pydict({"query_id": ids.take(pa.array(q[order])), "chunk_id": pa.array(names[order].tolist(), pa.string()), "distance": pa.array(d[order])})

    return run
