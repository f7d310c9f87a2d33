"""The registered queries of the engine's own operators, with SQL for each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import svg
from ..functions.sequence import CODE, CODONS, gc_content, reverse_complement, translate_dna
from ..functions.tokens import CJK_RANGES, estimate_tokens
from ..functions.vectors import cosine
from ..operators import formats, kmer, lengths, motif, orf, protein, tfidf
from ..session import cut, shared_dir, table
from ..sources import text as text_formats
from ..sources import writers
from ..svg import convert as svg_convert
from ..vector import layout
from ..vector.store import Files, VectorStore
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Engines add floats in different orders; six places are compared."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Counts of characters by what is left without them: the same in every dialect.
def _n(letters: str, of: str = "seq") -> str:
    return f"(length({of}) - length(translate({of}, '{letters}', '')))"


_GC = f"CASE WHEN {_n('ACGTUacgtu')} = 0 THEN 0.0 ELSE 100.0 * {_n('GCgc')} / {_n('ACGTUacgtu')} END"


@query(f"SELECT seq_id, round({_GC}, 6) AS gc FROM ({t.DNA_SQL})")
def gc_content_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(t.dna(spark, sf_dir).select("seq_id", gc_content(F.col("seq")).alias("gc")), "gc")


@query(f"SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM ({t.DNA_SQL})")
def reverse_complement_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.dna(spark, sf_dir).select("seq_id", reverse_complement(F.col("seq")).alias("rc"))


_WINDOWS = "SELECT seq_id, i, substr(seq, i, {k}) AS w FROM (SELECT seq_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM ({dna}) WHERE length(seq) >= {k})"


@query(f"SELECT seq_id, kmer, count FROM (SELECT seq_id, w AS kmer, count(*) AS count, row_number() OVER (PARTITION BY seq_id ORDER BY count(*) DESC, w) AS r FROM ({_WINDOWS.format(k=6, dna=t.DNA_SQL)}) GROUP BY seq_id, w) WHERE r <= 10")
def kmer_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.kmer_count(t.dna(spark, sf_dir), 6, 10)


@query(f"SELECT w AS kmer, count(*) AS count FROM ({_WINDOWS.format(k=8, dna=t.DNA_SQL)}) GROUP BY w")
def kmer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer.kmer_corpus(t.dna(spark, sf_dir), 8)


_CODON_VALUES = ", ".join(f"('{c}', '{a}')" for c, a in zip(CODONS, CODE, strict=True))


@query(
    f"""WITH d AS ({t.DNA_SQL}), g(codon, aa) AS (VALUES {_CODON_VALUES}),
    c AS (SELECT seq_id, i, substr(seq, 3 * i + 1, 3) AS codon FROM (SELECT seq_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM d)),
    p AS (SELECT seq_id, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS protein FROM c LEFT JOIN g USING (codon) GROUP BY seq_id)
    SELECT seq_id, coalesce(protein, '') AS protein FROM d LEFT JOIN p USING (seq_id)"""
)
def translate_dna_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.dna(spark, sf_dir).select("seq_id", translate_dna(F.col("seq")).alias("protein"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.dna(spark, sf_dir).select(F.length("seq").cast("long").alias("length"), gc_content(F.col("seq")).alias("gc"))


_N50 = f"SELECT coalesce(max(len), 0) AS n50 FROM (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS run, sum(len) OVER () AS total FROM (SELECT CAST(length(seq) AS BIGINT) AS len FROM ({t.DNA_SQL}))) WHERE run >= total // 2"


@query(_N50)
def seq_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.seq_n50(_measured(spark, sf_dir))


@query(f"SELECT count(*) AS count, CAST(sum(length(seq)) AS BIGINT) AS total_length, CAST(min(length(seq)) AS BIGINT) AS min_length, CAST(max(length(seq)) AS BIGINT) AS max_length, round(avg(length(seq)), 6) AS avg_length, round(avg({_GC}), 6) AS avg_gc, ({_N50}) AS n50 FROM ({t.DNA_SQL})")
def summarize_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lengths.summarize_sequences(_measured(spark, sf_dir)), "avg_length", "avg_gc")


MOTIF = "TATAWAW"


def _motif_sql(masks: list[int], strand: str) -> str:
    pattern = motif.mask_pattern(masks)
    windows = _WINDOWS.format(k=len(masks), dna=t.DNA_SQL)
    return f"SELECT seq_id, CAST(i - 1 AS BIGINT) AS start, CAST(i - 1 + {len(masks)} AS BIGINT) AS \"end\", w AS matched, '{strand}' AS strand FROM ({windows}) WHERE regexp_full_match(w, '{pattern}')"


_MASKS = motif.motif_masks(MOTIF)
_PLUS, _MINUS = _motif_sql(_MASKS, "+"), _motif_sql(motif.complement_masks(_MASKS), "-")


@query(_PLUS)
def find_motifs_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.find_motifs(t.dna(spark, sf_dir), MOTIF, "+")


@query(_MINUS)
def find_motifs_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.find_motifs(t.dna(spark, sf_dir), MOTIF, "-")


@query(f"{_PLUS} UNION ALL {_MINUS}")
def find_motifs_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.find_motifs(t.dna(spark, sf_dir), MOTIF)


def _sites_sql(names: tuple[str, ...]) -> str:
    chosen = {n: e for n, e in motif.ENZYMES.items() if not names or n in names}
    values = ", ".join(f"('{n}', '{s}', {c})" for n, (s, c) in chosen.items())
    parts = [f"SELECT seq_id, i, w FROM ({_WINDOWS.format(k=k, dna=t.DNA_SQL)})" for k in sorted({len(s) for s, _ in chosen.values()})]
    return f"WITH e(enzyme_name, site, cut) AS (VALUES {values}) SELECT seq_id, enzyme_name, CAST(i - 1 AS BIGINT) AS position, CAST(i - 1 + cut AS BIGINT) AS cut_position, site AS recognition_site, '+' AS strand FROM ({' UNION ALL '.join(parts)}) JOIN e ON w = site"


@query(_sites_sql(()))
def restriction_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.find_restriction_sites(t.dna(spark, sf_dir))


@query(_sites_sql(("EcoRI", "NotI")))
def restriction_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motif.find_restriction_sites(t.dna(spark, sf_dir), ["ecori", "NOTI", "unknown"])


def _weighted_sql(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"({w}) * {_n(x)}" for x, w in weights.items()) + ")"


def _overlapping(pair: str) -> str:
    """Overlapping counts: doubled letters are counted place by place."""
    if pair[0] != pair[1]:
        return f"((length(seq) - length(replace(seq, '{pair}', ''))) // 2)"
    return f"list_sum(list_transform(regexp_extract_all(seq, '{pair[0]}+'), lambda r: length(r) - 1))"


_PAIRS_SQL = "(" + " + ".join(f"{w} * coalesce({_overlapping(p)}, 0)" for p, w in protein.INSTABILITY.items()) + ")"
_P, _M = _n("KRH"), _n("DE")


@query(
    f"""SELECT seq_id, CAST(n AS BIGINT) AS length, round(CASE WHEN n = 0 THEN 0 ELSE mass + 18.015 END, 6) AS molecular_weight,
    round(CASE WHEN p + m = 0 THEN 7.0 ELSE least(greatest(7.0 + 0.3 * (p - m) / CAST(p + m AS DOUBLE) * 10.0, 2.0), 13.0) END, 6) AS isoelectric_point,
    CAST(p - m AS DOUBLE) AS net_charge_ph7, round(CASE WHEN n = 0 THEN 0 ELSE fwy / CAST(n AS DOUBLE) END, 6) AS aromaticity,
    round(CASE WHEN n = 0 THEN 0 ELSE 10.0 * pairs / CAST(n AS DOUBLE) END, 6) AS instability_index, round(CASE WHEN n = 0 THEN 0 ELSE kd / CAST(n AS DOUBLE) END, 6) AS gravy
    FROM (SELECT seq_id, length(seq) AS n, CAST({_weighted_sql(protein.MASS)} AS DOUBLE) AS mass, {_P} AS p, {_M} AS m, {_n('FWY')} AS fwy, CAST({_PAIRS_SQL} AS DOUBLE) AS pairs, CAST({_weighted_sql(protein.HYDROPATHY)} AS DOUBLE) AS kd FROM ({t.PROTEIN_SQL}))"""
)
def protein_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = protein.protein_properties(t.proteins(spark, sf_dir)).drop("aa_composition")
    return rounded(found, "molecular_weight", "isoelectric_point", "aromaticity", "instability_index", "gravy")


@query(f"SELECT seq_id, aa, round(100.0 * count(*) / any_value(n), 6) AS percent FROM (SELECT seq_id, length(seq) AS n, unnest(string_split(seq, '')) AS aa FROM ({t.PROTEIN_SQL})) WHERE aa <> '' GROUP BY seq_id, aa")
def aa_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(protein.aa_composition(t.proteins(spark, sf_dir)), "percent")


@query(
    f"""WITH d AS ({t.DNA_SQL}), s AS (SELECT seq_id, '+' AS strand, seq FROM d UNION ALL SELECT seq_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM d),
    f AS (SELECT seq_id, strand, length(seq) AS n, frame, regexp_extract_all(substr(seq, frame + 1), '...') AS cs FROM (SELECT *, unnest([0, 1, 2]) AS frame FROM s)),
    z AS (SELECT *, list_filter(range(1, len(cs) + 1), lambda i: cs[i] IN ('TAA', 'TAG', 'TGA')) AS stops FROM f),
    p AS (SELECT seq_id, strand, n, frame, unnest(stops) AS stop, unnest(list_prepend(0, stops[1:len(stops) - 1])) AS before FROM z),
    o AS (SELECT p.*, cs, before + coalesce(list_position(cs[before + 1:stop], 'ATG'), 0) AS a FROM p JOIN f USING (seq_id, strand, n, frame)),
    w AS (SELECT *, 3 * (stop - a + 1) AS len, 3 * (a - 1) + frame AS spot FROM o WHERE a > before AND 3 * (stop - a + 1) >= 30)
    SELECT seq_id, CAST(CASE strand WHEN '+' THEN spot ELSE n - spot - len END AS BIGINT) AS start, CAST(CASE strand WHEN '+' THEN spot + len ELSE n - spot END AS BIGINT) AS "end", CAST(len AS BIGINT) AS length, strand, CAST(frame AS INTEGER) AS frame,
    'ATG' AS start_codon, cs[stop] AS stop_codon, array_to_string(list_transform(cs[a:stop - 1], lambda c: coalesce(substr('{CODE}', CAST(list_position({CODONS}, c) AS INTEGER), 1), 'X')), '') AS protein FROM w"""
)
def find_orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orf.find_orfs(t.dna(spark, sf_dir))


_CJK = "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in CJK_RANGES) + "]"
_TEXTS = ("hello world", "abcd", "abcde", "你好世界", "你好 world", "", "🐍🐍🐍🐍", "🐍🐍🐍🐍🐍")
_TEXT_SQL = ", ".join(f"('{x}')" for x in _TEXTS)


@query(f"SELECT kind, id, CAST(cjk + (length(text) - cjk + 3) // 4 AS BIGINT) AS tokens FROM (SELECT kind, id, text, length(text) - length(regexp_replace(text, '{_CJK}', '', 'g')) AS cjk FROM (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'literal', row_number() OVER () - 1, x FROM (VALUES {_TEXT_SQL}) v(x)) WHERE text IS NOT NULL)")
def estimate_tokens_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    literals = spark.createDataFrame([("literal", k, x) for k, x in enumerate(_TEXTS)], "kind string, id long, text string")
    return docs.unionByName(turns).unionByName(literals).where("text is not null").select("kind", "id", estimate_tokens(F.col("text")).alias("tokens"))


_Q_TOKENS = ["the", "of", "and", "in", "zzzunknown", "the"]
_Q_VALUES = ", ".join(f"('{x}', {_Q_TOKENS.count(x)})" for x in dict.fromkeys(_Q_TOKENS))
_TFIDF = f"""WITH d AS ({t.TOKEN_SQL}), n AS (SELECT count(*) AS n FROM d),
    tf AS (SELECT doc_ord, id, token, count(*) AS tf FROM (SELECT doc_ord, id, unnest(tokens) AS token FROM d) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)"""


@query(
    f"""{_TFIDF}, p AS (SELECT doc_ord, id, token, tf * ln(1 + n / (1 + df)::DOUBLE) AS w FROM tf JOIN df USING (token), n),
    q AS (SELECT token, c * ln(1 + n / (1 + coalesce(df, 0))::DOUBLE) AS qw FROM (VALUES {_Q_VALUES}) v(token, c) LEFT JOIN df USING (token), n),
    s AS (SELECT doc_ord, id, sum(w * qw) AS dot FROM p JOIN q USING (token) GROUP BY ALL), m AS (SELECT doc_ord, sum(w * w) AS n2 FROM p GROUP BY ALL)
    SELECT doc_ord, id, round(dot / sqrt(n2 * (SELECT sum(qw * qw) FROM q)), 6) AS base FROM s JOIN m USING (doc_ord) WHERE dot > 0 ORDER BY dot / sqrt(n2 * (SELECT sum(qw * qw) FROM q)) DESC, doc_ord LIMIT 20"""
)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tfidf.TfidfIndex(spark)
    index.ensure("documents", t.tokens(spark, sf_dir))
    found = cut(rounded(index.score(_Q_TOKENS, 20), "base"))
    index.clear()
    return found


@query(f"{_TFIDF} SELECT (SELECT n FROM n) AS n, (SELECT count(*) FROM df) AS df_size, (SELECT count(*) FROM d) AS entries_len")
def tfidf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tfidf.TfidfIndex(spark)
    index.ensure("documents", t.tokens(spark, sf_dir))
    held = json.loads(index.info())
    index.clear()
    return spark.createDataFrame([(held["n"], held["dfSize"], held["entriesLen"])], "n long, df_size long, entries_len long")


@query(f"{_TFIDF} SELECT step, built, ok, dfs FROM (SELECT 'first' AS step, 1 AS built, true AS ok, (SELECT count(*) FROM df) AS dfs UNION ALL SELECT 'same key', 0, true, (SELECT count(*) FROM df) UNION ALL SELECT 'cleared', NULL, false, NULL UNION ALL SELECT 'again', 1, true, 3)")
def tfidf_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index is built, kept under its key, cleared, and built from JSON."""
    index, steps = tfidf.TfidfIndex(spark), []

    def state(step: str, built: int | None) -> None:
        held = json.loads(index.info())
        steps.append((step, built, held["ok"], held.get("dfSize")))

    state("first", index.ensure("documents", t.tokens(spark, sf_dir)))
    state("same key", index.ensure("documents", t.tokens(spark, sf_dir).limit(1)))
    index.clear()
    state("cleared", None)
    state("again", index.ensure_json("other", json.dumps([{"id": "a", "tokens": ["x", "y", "x"]}, {"id": "b", "tokens": ["z"]}])))
    index.clear()
    return spark.createDataFrame(steps, "step string, built int, ok boolean, dfs long")


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE)))"


@query(f"SELECT vec_id, round({_DOT.format(a='e.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='e.embedding', b='e.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')})), 6) AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def embedding_cosine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.vectors(spark, sf_dir)
    q = v.where("vec_id = 0").select(F.col("vector").alias("q"))
    return rounded(v.crossJoin(F.broadcast(q)).select("vec_id", cosine(F.col("vector"), F.col("q")).alias("cosine")), "cosine")  # the query is one row


@query(f"SELECT a.vec_id AS vec_id, round({_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t.vectors(spark, sf_dir)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("next"))
    return rounded(v.join(other, "vec_id").select("vec_id", cosine(F.col("vector"), F.col("next")).alias("cosine")), "cosine")


_DISTANCE = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda t: (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE)) * (CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE))))"
# Every vector whose id is divisible by 20 is a query, against all rows.
_SEARCH = "SELECT query_id, chunk_id, round(1 - d, 6) AS score, round(d, 6) AS distance FROM (SELECT q.vec_id AS query_id, CAST(e.vec_id AS VARCHAR) AS chunk_id, " + _DISTANCE + " AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY " + _DISTANCE + ", CAST(e.vec_id AS VARCHAR)) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {where}) WHERE r <= 10"


def _with_store(spark: SparkSession, sf_dir: str, run: Callable[[VectorStore, DataFrame], DataFrame]) -> DataFrame:
    """What ``run`` makes of a store that holds all embeddings in space ``s``, their labels as metadata, and of the queries."""
    v = t.vectors(spark, sf_dir)
    base = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    store = VectorStore(spark, base)
    store.ensure_table("s", v.select(F.max(F.size("vector"))).first()[0] or 0)
    store.upsert("s", v.select(F.col("chunk_id").alias("id"), "chunk_id", F.lit("s").alias("space_id"), "vector", F.lit("").alias("text"), F.col("label").cast("string").alias("metadata")))
    found = cut(run(store, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")))
    store.files.remove(base)
    return found


def _search(spark: SparkSession, sf_dir: str, condition: str | None = None) -> DataFrame:
    return rounded(_with_store(spark, sf_dir, lambda store, queries: store.nearest_many("s", queries, 10, condition)), "score", "distance")


@query(_SEARCH.format(where="true"))
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir)


@query(_SEARCH.format(where="e.label = 5"))
def vector_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "metadata = '5'")


@query("SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexed search of every query, held against the exact one: how many queries, and whether nine of ten neighbours are found."""

    def run(store: VectorStore, queries: DataFrame) -> DataFrame:
        exact = store.nearest_many("s", queries, 10).select("query_id", "chunk_id")
        store.create_index("s")
        store.optimize_index("s")
        near = store.nearest_many("s", queries, 10, probes=store.probes_for("s", queries, 10)).select("query_id", "chunk_id", F.lit(1).alias("hit"))
        pairs = exact.join(near, ["query_id", "chunk_id"], "left")
        return pairs.agg(F.count_distinct("query_id").alias("queries"), (F.sum("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))

    return _with_store(spark, sf_dir, run)


_LIVE = "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CASE WHEN vec_id % 7 = 0 THEN 'new' ELSE CAST(label AS VARCHAR) END AS metadata, round(CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings"


def _changed(store: VectorStore, also_deleted: bool) -> DataFrame:
    """After every seventh row was replaced, and every third deleted."""
    rows = store.table("s").where("cast(chunk_id as long) % 7 = 0")
    store.upsert("s", rows.withColumn("vector", F.transform("vector", lambda x: x * 2)).withColumn("metadata", F.lit("new")))
    if also_deleted:
        store.delete_chunks("s", store.table("s").where("cast(chunk_id as long) % 3 = 0").select("chunk_id"))
    return rounded(store.table("s").select("chunk_id", "metadata", F.get("vector", F.lit(0)).cast("double").alias("first")), "first")


@query(_LIVE)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_store(spark, sf_dir, lambda store, _: _changed(store, False))


@query(f"{_LIVE} WHERE vec_id % 3 <> 0")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_store(spark, sf_dir, lambda store, _: _changed(store, True))


@query("SELECT step, rows, indexed, CAST((SELECT max(len(embedding)) FROM embeddings) AS INTEGER) AS dim, pinged FROM (SELECT 'full' AS step, (SELECT count(*) FROM embeddings) AS rows, false AS indexed, true AS pinged UNION ALL SELECT 'indexed', (SELECT count(*) FROM embeddings), true, true UNION ALL SELECT 'deleted', (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0), true, true)")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(store: VectorStore, _: DataFrame) -> DataFrame:
        def state(step: str) -> tuple:
            found = store.stats("s")
            return step, found["table_rows"], found["indexed"], found["vector_dim"], store.ping("s")

        states = [state("full")]
        store.create_index("s", cells=8)
        states.append(state("indexed"))
        store.delete_chunks("s", store.table("s").where("cast(chunk_id as long) % 3 = 0").select("chunk_id"))
        states.append(state("deleted"))
        return spark.createDataFrame(states, "step string, rows long, indexed boolean, dim int, pinged boolean")

    return _with_store(spark, sf_dir, run)


def _shard_sql(source: str) -> str:
    return f"SELECT space_id, 'shard_' || printf('%02x', CAST(list_reduce(list_prepend(37::BIGINT, list_transform(string_split(space_id, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, b: (xor(h, b) * 179) & 255) AS BIGINT)) AS shard FROM (SELECT DISTINCT {source}) WHERE space_id <> ''"


@query(_shard_sql("c_name AS space_id FROM customer"))
def shard_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("space_id")).distinct().where("space_id != ''")
    return names.select("space_id", layout.shard_column(F.col("space_id")).alias("shard"))


# Each document is rendered as a FASTA record and parsed again.
@query(f"SELECT seq_id AS ordinal, 'seq' || seq_id AS id, 'from documents' AS description, CAST(length(seq) AS BIGINT) AS length, round({_GC}, 6) AS gc FROM ({t.DNA_SQL})")
def fasta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    rendered = t.dna(spark, sf_dir).select(F.col("seq_id").alias("ordinal"), F.concat(F.lit(">seq"), F.col("seq_id"), F.lit(" from documents\n"), wrapped).alias("value"))
    return rounded(formats.fasta_stats(text_formats.parse_fasta(rendered)), "gc")


@query(
    f"""SELECT count(*) AS read_count, CAST(sum(length(seq)) AS BIGINT) AS total_bases, round(sum(q) / CAST(sum(length(seq)) AS DOUBLE), 6) AS avg_quality, round(100.0 * sum(q20) / sum(length(seq)), 6) AS q20_percent,
    round(100.0 * sum(q30) / sum(length(seq)), 6) AS q30_percent, round(100.0 * sum(gc) / sum(acgt), 6) AS gc_percent FROM (SELECT seq, coalesce(list_sum(list_transform(string_split(qual, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ascii(c) - 33 END)), 0) AS q,
    length(regexp_replace(qual, '[^5-~]', '', 'g')) AS q20, length(regexp_replace(qual, '[^?-~]', '', 'g')) AS q30, {_n('GCgc')} AS gc, {_n('ACGTacgt')} AS acgt FROM ({t.FASTQ_SQL}))"""
)
def fastq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(formats.fastq_stats(t.fastq_reads(spark, sf_dir)), "avg_quality", "q20_percent", "q30_percent", "gc_percent")


@query(
    f"""SELECT count(*) AS read_count, count(*) FILTER (flag & 4 = 0) AS mapped_count, count(*) FILTER (flag & 4 <> 0) AS unmapped_count, count(*) FILTER (flag & 1 <> 0) AS paired_count, count(*) FILTER (flag & 2 <> 0) AS proper_pair_count,
    count(*) FILTER (flag & 1024 <> 0) AS duplicate_count, CAST(sum(length(seq)) AS BIGINT) AS total_bases, round(sum(mapq) / CAST(count(*) FILTER (flag & 4 = 0) AS DOUBLE), 6) AS avg_mapq, round(avg(length(seq)), 6) AS avg_length,
    round(100.0 * sum({_n('GCgc')}) / sum({_n('ACGTacgt')}), 6) AS gc_percent FROM ({t.BAM_SQL})"""
)
def bam_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(formats.bam_stats(t.bam_reads(spark, sf_dir)), "avg_mapq", "avg_length", "gc_percent")


def _through_files(spark: SparkSession, rows: DataFrame, encode, kind: str, read) -> DataFrame:
    """What ``read`` finds in files that hold ``rows``."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    writers.write_files(rows, path, encode, kind)
    found = cut(read(spark, path))
    Files(spark).remove(path)
    return found


@query(SQL["fastq_stats"])
def fastq_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _through_files(spark, t.fastq_reads(spark, sf_dir), writers.fastq_file, "fastq.gz", formats.read_fastq_stats)
    return rounded(found, "avg_quality", "q20_percent", "q30_percent", "gc_percent")


@query(SQL["bam_stats"])
def bam_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _through_files(spark, t.bam_reads(spark, sf_dir), writers.bam_file, "bam", formats.read_bam_stats)
    return rounded(found, "avg_mapq", "avg_length", "gc_percent")


_SNP = "length(ref) = 1 AND (alt = '.' OR len(list_filter(string_split(alt, ','), lambda a: length(a) <> 1)) = 0)"


@query(f"SELECT count(*) AS variant_count, count(*) FILTER ({_SNP}) AS snp_count, count(*) FILTER (NOT ({_SNP})) AS indel_count, count(*) FILTER (contains(alt, ',')) AS multi_allelic_count, count(*) FILTER (filter = 'PASS') AS pass_count, round(avg(CAST(CAST(nullif(qual, '.') AS FLOAT) AS DOUBLE)), 6) AS avg_qual, count(DISTINCT chrom) AS chromosome_count, CAST(2 AS BIGINT) AS sample_count FROM ({t.VCF_SQL})")
def vcf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(formats.vcf_stats(t.vcf_lines(spark, sf_dir)), "avg_qual")


@query(SQL["vcf_stats"])
def bcf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = text_formats.parse_vcf(t.vcf_lines(spark, sf_dir)).select("chrom", "pos", "ids", "ref", "alts", "qual", "filters")
    return rounded(_through_files(spark, variants, lambda rows: writers.bcf_file(rows, ("S1", "S2")), "bcf", formats.read_bcf_stats), "avg_qual")


_FILTERED = f"SELECT o_orderkey AS ordinal, chrom, pos, CASE id WHEN '.' THEN '' ELSE id END AS id, ref, CASE alt WHEN '.' THEN '' ELSE alt END AS alt, CAST(coalesce(CAST(nullif(qual, '.') AS FLOAT), 0) AS DOUBLE) AS qual, filter, info FROM ({t.VCF_SQL})"


@query(f"SELECT * FROM ({_FILTERED}) WHERE chrom = 'chr7' AND pos BETWEEN 10 AND 9000000 AND qual >= 50000 AND filter = 'PASS'")
def filter_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = text_formats.parse_vcf(t.vcf_lines(spark, sf_dir))
    return formats.filter_variants(variants, min_quality=50000.0, pass_only=True, chromosome="chr7", region_start=10, region_end=9_000_000)[0]


@query(f"SELECT CAST(max(ordinal) + 1 AS BIGINT) AS total_count, count(*) AS filtered_count FROM (SELECT ordinal FROM ({_FILTERED}) WHERE filter = 'PASS' ORDER BY ordinal LIMIT 25)")
def filter_vcf_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = text_formats.parse_vcf(t.vcf_lines(spark, sf_dir))
    return formats.filter_variants(variants, pass_only=True, max_variants=25)[1]


@query(f"SELECT count(*) AS feature_count, count(DISTINCT source) AS source_count, count(DISTINCT seqid) AS chromosome_count, count(*) FILTER (strand = '+') AS strand_plus, count(*) FILTER (strand = '-') AS strand_minus, count(*) FILTER (strand = '.') AS strand_none, CAST(sum(CASE WHEN stop > start THEN stop - start + 1 ELSE 0 END) AS BIGINT) AS total_span FROM ({t.GFF_SQL})")
def gff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.gff_stats(text_formats.parse_gff(t.gff_lines(spark, sf_dir)))


@query(f"SELECT type, count(*) AS count FROM ({t.GFF_SQL}) GROUP BY type")
def gff_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.gff_types(text_formats.parse_gff(t.gff_lines(spark, sf_dir)))


_BED = f"SELECT chrom, greatest(stop - start, 0) AS len FROM ({t.BED_SQL})"


@query(f"SELECT count(*) AS feature_count, count(DISTINCT chrom) AS chromosome_count, CAST(sum(len) AS BIGINT) AS total_span, min(len) AS min_length, max(len) AS max_length, round(avg(len), 6) AS avg_length FROM ({_BED})")
def bed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(formats.bed_stats(text_formats.parse_bed(t.bed_lines(spark, sf_dir))), "avg_length")


@query(f"SELECT chrom, count(*) AS count, CAST(sum(len) AS BIGINT) AS span FROM ({_BED}) GROUP BY chrom")
def bed_chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.bed_chroms(text_formats.parse_bed(t.bed_lines(spark, sf_dir)))


_UNITS = ("", "px", "in", "cm", "mm", "pt", "pc", "q")
_UNIT_SQL = " ".join(f"WHEN '{u}' THEN {svg.UNIT_PX[u]!r}" for u in _UNITS)
_UNIT_OF = "list_extract(['', 'px', 'in', 'cm', 'mm', 'pt', 'pc', 'q', 'zz'], CAST(p_partkey % 9 + 1 AS INTEGER))"


def _length_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array(*[F.lit(u) for u in (*_UNITS, "zz")])
    return table(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_partkey") % 500).cast("string"), F.lit(".5"), F.get(units, (F.col("p_partkey") % 9).cast("int"))).alias("s"))


@query(f"SELECT p_partkey, round(v * CASE u {_UNIT_SQL} ELSE 1.0 END, 6) AS px, u AS unit, round(v * CASE u {_UNIT_SQL} ELSE 1.0 END / 96.0, 6) AS inches FROM (SELECT p_partkey, CAST(p_partkey % 500 + 0.5 AS DOUBLE) AS v, {_UNIT_OF} AS u FROM part)")
def parse_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_length_texts(spark, sf_dir).select("p_partkey", svg.parse_length(F.col("s")).alias("x")).select("p_partkey", "x.*"), "px", "inches")


@query("SELECT p_partkey, (p_partkey % 300) || 'cm' AS width, CAST(p_partkey % 7 AS VARCHAR) AS height FROM part")
def extract_svg_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = F.expr("concat('<?xml version=\"1.0\"?><SVG xmlns=\"x\" width=\"', p_partkey % 300, 'cm\" height=''', p_partkey % 7, '''><rect/></SVG>')")
    return table(spark, sf_dir, "part").select("p_partkey", svg.extract_svg_size(markup).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, CAST(p_partkey % 256 AS INTEGER) AS r, CAST(p_partkey // 256 % 256 AS INTEGER) AS g, CAST(p_partkey % 16 * 17 AS INTEGER) AS b, CAST(CASE WHEN p_partkey % 2 = 0 THEN 255 ELSE p_partkey % 100 END AS INTEGER) AS a FROM part")
def parse_hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = F.expr("concat(lpad(hex(p_partkey % 256), 2, '0'), lpad(hex(p_partkey div 256 % 256), 2, '0'), lpad(hex(p_partkey % 16 * 17), 2, '0'))")
    color = F.concat(F.lit("##"), F.expr("case when p_partkey % 2 = 0 then '' else lpad(hex(p_partkey % 100), 2, '0') end"), rgb)
    return table(spark, sf_dir, "part").select("p_partkey", svg.parse_hex_color(color).alias("x")).select("p_partkey", "x.*")


@query(
    """SELECT p_partkey, CAST(least(greatest(CASE k WHEN 0 THEN 400 WHEN 1 THEN 300 WHEN 2 THEN floor(w * (150.0 / h) + 0.5) WHEN 3 THEN floor(w / 96.0 * 300 + 0.5) WHEN 4 THEN floor(w * 2.5 + 0.5) ELSE floor(w + 0.5) END, 1), 65535) AS INTEGER) AS w,
    CAST(least(greatest(CASE k WHEN 0 THEN 200 WHEN 1 THEN floor(h * (300.0 / w) + 0.5) WHEN 2 THEN 150 WHEN 3 THEN floor(h / 96.0 * 300 + 0.5) WHEN 4 THEN floor(h * 2.5 + 0.5) ELSE floor(h + 0.5) END, 1), 65535) AS INTEGER) AS h
    FROM (SELECT p_partkey, p_partkey % 6 AS k, CAST(p_partkey % 400 + 10 AS DOUBLE) AS w, CAST(p_partkey % 300 + 7 AS DOUBLE) AS h FROM part)"""
)
def target_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    w, h = (F.col("p_partkey") % 400 + 10).cast("double"), (F.col("p_partkey") % 300 + 7).cast("double")

    def when(*pairs: tuple[int, float]) -> Column:
        out = F.lit(None).cast("double")
        for at, value in pairs:
            out = F.when(k == at, F.lit(float(value))).otherwise(out)
        return out

    found = svg.target_size(w, h, when((0, 400), (1, 300)), when((0, 200), (2, 150)), F.coalesce(when((4, 2.5)), F.lit(1.0)), k == 3, F.lit(300.0), w / 96.0, h / 96.0)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.w", "x.h")


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawing of a rectangle for each part."""
    markup = F.expr("concat('<svg width=\"', p_partkey % 40 + 8, '\" height=\"', p_partkey % 30 + 6, 'pt\"><rect width=\"', p_partkey % 40 + 8, '\" height=\"5\" fill=\"#', lpad(hex(p_partkey % 4096), 3, '0'), '\"/></svg>')")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.encode(markup, "UTF-8").alias("content"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, true AS ok, CAST(p_partkey % 40 + 8 AS DOUBLE) AS width, round((p_partkey % 30 + 6) * 96.0 / 72.0, 6) AS height, CAST(p_partkey % 40 + 8 AS VARCHAR) AS width_unit, (p_partkey % 30 + 6) || 'pt' AS height_unit, round((p_partkey % 40 + 8) / 96.0, 6) AS physical_width_in, round((p_partkey % 30 + 6) / 72.0, 6) AS physical_height_in, CAST(NULL AS VARCHAR) AS error FROM part")
def svg_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(svg_convert.svg_info(_drawings(spark, sf_dir)), "width", "height", "physical_width_in", "physical_height_in")


def _stored_size(kind: str) -> tuple[Column, Column]:
    """Width and height as the image's own header has them."""
    text = F.hex(F.substring("image", 1, 1024))

    def number(byte: int, little: bool) -> Column:
        digits = [F.substring(text, 2 * (byte + k) + 1, 2) for k in range(4)]
        return F.conv(F.concat(*(reversed(digits) if little else digits)), 16, 10).cast("int")

    if kind == "pdf":
        latin = F.decode(F.substring("image", 1, 1024), "ISO-8859-1")
        return tuple(F.regexp_extract(latin, rf"/{x} ([0-9]+)", 1).cast("int") for x in ("Width", "Height"))
    if kind == "jpeg":  # the frame header: marker, length 17, eight bits, height, width
        frame = lambda k: F.conv(F.regexp_extract(text, "FFC0001108(.{4})(.{4})", k), 16, 10).cast("int")
        return frame(2), frame(1)
    at = {"png": (16, 20, False), "bmp": (18, 22, True), "tiff": (18, 30, True)}[kind]
    return number(at[0], at[2]), number(at[1], at[2])


#: Of the formats without compression, the size of the file and (TIFF) the first pixel.
_RAW = {"bmp": "CAST(54 + (3 * w + 3) // 4 * 4 * h AS BIGINT)", "tiff": "CAST(142 + 4 * w * h AS BIGINT)"}


def _encoded(kind: str) -> None:
    sql = f"SELECT path, true AS ok, w AS width, h AS height, '{kind}' AS format, CAST(96 AS DOUBLE) AS dpi, CAST(NULL AS VARCHAR) AS error, w AS stored_width, h AS stored_height"
    sql += f", {_RAW[kind]} AS bytes_written" if kind in _RAW else ""
    sql += ", c[1] || c[1] || c[2] || c[2] || c[3] || c[3] || 'FF' AS first_pixel" if kind == "tiff" else ""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = svg_convert.convert_svgs(_drawings(spark, sf_dir), svg_convert.Options(format=kind))
        w, h = _stored_size(kind)
        found = found.withColumns({"stored_width": w, "stored_height": h, "first_pixel": F.hex(F.substring("image", 143, 4))})
        return found.drop("image", *([] if kind in _RAW else ["bytes_written"]), *([] if kind == "tiff" else ["first_pixel"]))

    run.__name__ = f"svg_convert_{kind}"
    query(f"{sql} FROM (SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_partkey % 40 + 8 AS INTEGER) AS w, CAST(floor((p_partkey % 30 + 6) * 96.0 / 72.0 + 0.5) AS INTEGER) AS h, string_split(printf('%03X', CAST(p_partkey % 4096 AS INTEGER)), '') AS c FROM part)")(run)


for _kind in ("png", "jpeg", "tiff", "bmp", "pdf"):
    _encoded(_kind)


def queries() -> dict[str, Query]:
    return {name.removesuffix("_query"): f for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name.removesuffix("_query"): sql for name, sql in SQL.items()}
