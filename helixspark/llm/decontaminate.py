r"""Benchmark decontamination with a broadcast hash set of test n-grams; DataFrame functions only.

Texts are lower-cased (A-Z only) and cut into words. A window is ``n``
consecutive words of a benchmark item, or the whole item if it is shorter.

* Hashes of words are paired to hashes of 2, 4, 8 words and so on, and these to
  hashes of windows, so a window costs a few steps whatever its length.
* The benchmark's distinct window hashes are broadcast, and one pass over the
  texts keeps the windows whose hash is among them. A pass takes
  ``windows_per_pass`` hashes at most; a larger benchmark is split by hash into
  as many passes as it needs, with the same results.
* Hits are verified word by word against the items' windows, and the words they
  cover are counted once.

Null texts have no words and no hits; items without id, text or words match
nothing. Items with equal text all count, in the order of their ids as strings.
Rows that repeat id and text each get a row, a null id is kept as such, an empty
table gives no rows, and without items nothing is hit. Texts of any length are
scanned as a whole; other columns, whatever their names, are not looked at. A
window that many texts share is joined by a broadcast of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .joins import join_hot

# Upper and lower case, and what a word is made of.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _with_runs(df: DataFrame, longest: int) -> DataFrame:
    """``df`` with ``_1``, ``_2``, ``_4`` and so on up to ``longest``: hashes of runs of so many words of ``w`` from each place on."""
    df, k = df.withColumn("_1", F.transform("w", lambda x: F.xxhash64(x))), 1
    while 2 * k <= longest:
        later = F.slice(F.col(f"_{k}"), F.lit(k + 1), F.size(f"_{k}"))
        df, k = df.withColumn(f"_{2 * k}", F.zip_with(f"_{k}", later, lambda x, y: F.xxhash64(x, y))), 2 * k
    return df


def _windows(n: int) -> Column:
    """Hashes of all windows of ``n`` words, from the hashes of runs that make them up."""
    runs, at = [], 0
    for k in (1 << b for b in reversed(range(n.bit_length()))):
        if n & k:
            runs.append((k, at))
            at += k
    first, more = runs[0], runs[1:]
    whole = F.slice(F.col(f"_{first[0]}"), F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(0)))
    return F.transform(whole, lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(F.col(f"_{k}"), i + at) for k, at in more]))


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """hash, need (words), window (its words), items: the distinct windows of all items."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    items = cut(items.withColumn("need", F.least(F.size("w"), F.lit(n))))
    sizes = sorted(r[0] for r in items.select("need").distinct().collect())  # n at most
    items, found = _with_runs(items, max(sizes, default=1)), []
    for need in sizes:
        places = items.where(F.col("need") == need).select("item", "w", F.posexplode(_windows(need)).alias("i", "hash"))
        found.append(places.select("hash", F.lit(need).alias("need"), F.slice("w", F.col("i") + 1, F.lit(need)).alias("window"), "item"))
    if not found:
        return items.select(F.lit(0).cast("long").alias("hash"), "need", F.col("w").alias("window"), F.array("item").alias("items")).where("false")
    return reduce(DataFrame.unionByName, found).groupBy("hash", "need", "window").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", windows_per_pass: int = 2_000_000, broadcast_docs: int = 500_000) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_words, n_hit, items, spans``.

    ``items`` are the ids of items with an occurring window, as strings, sorted;
    ``spans`` the hit windows as (first word, number of words), sorted, which may overlap.
    """
    windows = cut(benchmark_windows(benchmark, n, item_col, item_text_col))
    sizes = sorted(r[0] for r in windows.select("need").distinct().collect())  # n at most
    passes = max(1, -(-windows.count() // windows_per_pass))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text"))

    # Every row has one place more, which isn't a window and stands for the row.
    runs = _with_runs(source.select("doc_id", "text_key", word_array(F.col("text")).alias("w")), max(sizes, default=1))
    every = F.concat(F.array(F.lit(0).cast("long")), *[_windows(k) for k in sizes])
    places = runs.select("doc_id", "text_key", F.size("w").alias("n_words"), F.posexplode(every).alias("at", "hash"))
    found = []
    for k in range(passes):
        part = F.broadcast(windows.where(F.pmod("hash", F.lit(passes)) == k).groupBy("hash").agg(F.lit(True).alias("_known")))
        found.append((places.where("at > 0") if k else places).join(part, "hash", "left").where("_known or at = 0"))
    rows = reduce(DataFrame.unionByName, found)
    hits = F.collect_set(F.when(F.col("at") > 0, F.struct("at", "hash")))
    rows = cut(rows.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("at") == 0).alias("copies"), hits.alias("hits")))

    # Only texts with hits are cut into words again.
    hit = rows.where("size(hits) > 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_words", "hits")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    few = hit.count() <= broadcast_docs  # of two numbers
    texts = source.join(F.broadcast(hit.select("_id", "_key")), same, "left_semi") if few else source
    texts = texts.join(hit, same).select("_id", "_key", word_array(F.col("text")).alias("w"), "hits", "n_words").select("_id", "_key", "w", F.explode("hits").alias("h"), "n_words")
    # Places run through the windows of each size in turn.
    start, need, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for k in sizes:
        here = (F.col("h.at") >= before) & (F.col("h.at") < before + F.greatest(F.col("n_words") - k + 1, F.lit(0)))
        start, need = F.when(here, F.col("h.at") - before).otherwise(start), F.when(here, F.lit(k)).otherwise(need)
        before = before + F.greatest(F.col("n_words") - k + 1, F.lit(0))
    texts = texts.select("_id", "_key", F.col("h.hash").alias("hash"), start.alias("i"), need.alias("n"), F.slice("w", start + 1, need).alias("seen"))
    texts = cut(texts.distinct())
    known = windows.join(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")), "hash")
    sure = cut(join_hot(texts, known, "hash", "rows").where("seen = window").select("_id", "_key", "i", "n", "items"))
    per = sure.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.struct(F.col("i").alias("at"), "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))

    def cover(acc: Column, s: Column) -> Column:
        end = s["at"] + s["n"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["sum"] + F.greatest(F.lit(0), end - F.greatest(s["at"], acc["end"]))).alias("sum"))

    per = per.withColumn("n_hit", F.aggregate("spans", zero, cover)["sum"].cast("long"))
    out = rows.join(per, same, "left").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    no_spans = F.array().cast("array<struct<at:int,n:int>>")
    return out.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", no_spans).alias("spans"))


def is_contaminated(percent: int = 5) -> Column:
    """The contamination rule: ``percent`` of the words or more are hit."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", percent: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) without the hit words of all documents.

    All columns stay as they are, but for the text where spans are removed.
    """
    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).where("n_hit > 0")
    key = F.xxhash64(docs[text_col].cast("string"))
    if remove == "documents":
        bad = found.where(is_contaminated(percent)).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
        return docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (key == bad["_key"]), "left_anti")
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    bad = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), hit.alias("_hit")).dropDuplicates(["_id", "_key"])
    joined = docs.join(bad, docs[id_col].eqNullSafe(bad["_id"]) & (key == bad["_key"]), "left")
    # A piece is a word with the separators before it; what follows the last word is the tail.
    text, gap = docs[text_col].cast("string"), WORD.removesuffix("+").replace("[^", "[").replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(text, F.lit(f"{gap}*{gap.replace('[', '[^', 1)}+"), F.lit(0))
    kept = F.filter(F.transform(pieces, lambda x, i: F.when(~F.array_contains(bad["_hit"], i), x)), lambda x: x.isNotNull())
    cleaned = F.concat(F.array_join(kept, ""), F.regexp_extract(text, rf"({gap}*)\z", 1))
    new = F.when(bad["_hit"].isNull(), docs[text_col]).otherwise(cleaned)
    return joined.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
