r"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

Sources form a tree domain - language - source. Every level has weights; a leaf
may be used up to ``max_epochs`` times, which caps what it can give. The budget
of a node goes to its children by weight; children that can't take their share
take what they can and the shortage is spread over their siblings by weight,
and only what all siblings together can't take is left to the node's own
siblings. For one node that is: find the level at which ``min(cap, level *
weight)`` adds up to the budget. Windows over the leaf table find it exactly.

A leaf takes ``budget / supply`` whole epochs and then a prefix of one more:
its documents in the order of a seeded hash of that epoch, up to the last that
fits. The prefix sums run in two steps, over hash buckets of each leaf and then
inside a bucket, so the largest leaf needs no task of its own.

Tokens are words (runs of non-white-space); null texts have none. Null
languages and sources are leaves of their own, named ``?``. Weights not named
get ``default_weight``. Documents without tokens are in every whole epoch, and
in a prefix if their place is. An empty table gives no rows. Rows that repeat
an id and text have equal places and are taken or left together. Very long texts
are counted whole; one that exceeds a leaf's rest is left and the prefix ends
there. Other columns, whatever their names, are passed on or not looked at. A
leaf's buckets are 16**bucket_digits rows at most, so its window over them is
bounded whatever the leaf holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mixture:
    """Target weights by name for each level; ``share`` of all tokens is the budget unless ``tokens`` is given."""

    domains: dict[str, float] = field(default_factory=dict)
    languages: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    default_weight: float = 1.0
    share: float = 0.5
    tokens: int | None = None
    max_epochs: int = 4
    seed: int = 7
    bucket_digits: int = 3
    broadcast_leaves: int = 200_000  # of three names and two numbers; more are joined by a shuffle


def numbered_domain(source: Column) -> Column:
    """The production tree's domains: ``bulk`` for src0, ``web`` for odd and ``books`` for other numbers, else ``other``."""
    number = F.regexp_extract(source, r"^src([0-9]{1,9})$", 1)
    kind = F.when(number == "", "other").when(number.rlike("^0+$"), "bulk").when(number.rlike("[13579]$"), "web").otherwise("books")
    return F.coalesce(kind, F.lit("other"))


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for key in sorted(weights, reverse=True):
        out = F.when(name == key, F.lit(float(weights[key]))).otherwise(out)
    return out


def _spread(children: DataFrame, parent: list[str], cap: str, weight: str, budget: str, out: str) -> DataFrame:
    """``children`` with column ``out``: each one's part of its parent's ``budget``."""
    ratio = F.col(cap) / F.col(weight)
    names = [c for c in LEVELS if c in children.columns]
    ordered = Window.partitionBy(*parent).orderBy("_ratio", *names)
    upto, whole = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*parent)
    t = children.withColumn("_ratio", ratio)
    t = t.withColumn("_caps", F.sum(cap).over(upto)).withColumn("_rest", F.sum(weight).over(whole) - F.sum(weight).over(upto))
    t = t.withColumn("_full", F.col("_caps") + F.col("_ratio") * F.col("_rest") <= F.col(budget))
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col(cap))).over(whole), F.lit(0.0))
    free = F.sum(F.when(~F.col("_full"), F.col(weight))).over(whole)
    level = (F.col(budget) - taken) / free
    t = t.withColumn(out, F.when(F.col("_full"), F.col(cap)).otherwise(F.least(F.col(cap), level * F.col(weight))))
    return t.drop("_ratio", "_caps", "_rest", "_full")


def leaf_budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``leaves`` (domain, lang, source, supply) with ``budget`` in tokens; leaves without supply get none."""
    t = leaves.where("supply > 0").withColumn("cap", (F.col("supply") * mixture.max_epochs).cast("double"))
    t = t.withColumn("w3", _weight(F.col("source"), mixture.sources, mixture.default_weight)).where("w3 > 0")
    two = t.groupBy("domain", "lang").agg(F.sum("cap").alias("cap2")).withColumn("w2", _weight(F.col("lang"), mixture.languages, mixture.default_weight)).where("w2 > 0")
    one = two.groupBy("domain").agg(F.sum("cap2").alias("cap1")).withColumn("w1", _weight(F.col("domain"), mixture.domains, mixture.default_weight)).where("w1 > 0")
    total = F.lit(float(mixture.tokens)) if mixture.tokens is not None else None
    if total is None:
        whole = leaves.agg(F.floor(F.sum("supply") * F.lit(mixture.share)).cast("double").alias("b0"))
        one = one.crossJoin(F.broadcast(whole))  # one row
    else:
        one = one.withColumn("b0", total)
    one = _spread(one, ["b0"], "cap1", "w1", "b0", "b1").select("domain", "b1")
    two = _spread(two.join(one, "domain"), ["domain"], "cap2", "w2", "b1", "b2").select("domain", "lang", "b2")
    three = _spread(t.join(two, ["domain", "lang"]), ["domain", "lang"], "cap", "w3", "b2", "b3")
    # Rounded down a millionth above, so that engines that sum in another order agree.
    return three.select(*LEVELS, "supply", F.floor(F.col("b3") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, mixture: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain=numbered_domain) -> DataFrame:
    """One row per taken document and epoch: ``doc_id, text_key, domain, lang, source, n_tokens, epoch``."""
    named = F.coalesce(docs[source_col].cast("string"), F.lit("?"))
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("text_key"), domain(named).alias("domain"), F.coalesce(docs[lang_col].cast("string"), F.lit("?")).alias("lang"), named.alias("source"), n_tokens(docs[text_col].cast("string")).alias("n_tokens"))
    leaves = leaf_budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), mixture)
    leaves = leaves.withColumn("whole", F.expr("budget div supply")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply")).drop("supply", "budget")
    leaves = cut(leaves)
    if leaves.count() <= mixture.broadcast_leaves:
        leaves = F.broadcast(leaves)
    rows = rows.join(leaves, list(LEVELS))

    order = F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).cast("binary"))
    rows = rows.withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, mixture.bucket_digits))
    sums = rows.groupBy(*LEVELS, "_bucket").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEVELS, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*LEVELS, "_bucket").orderBy("_order", "text_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(sums, [*LEVELS, "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inside))
    taken = F.col("whole") + (F.col("_upto") <= F.col("rest")).cast("long")
    rows = rows.where(taken > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), taken - 1)))
    return rows.select("doc_id", "text_key", *LEVELS, "n_tokens", "epoch")


def mixed_documents(docs: DataFrame, mixture: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as often as the mixture takes them, with ``mix_epoch`` added (``epoch`` of the mixture)."""
    taken = mix(docs, mixture, id_col, text_col, **options).groupBy("doc_id", "text_key").agg(F.max("epoch").alias("_last"))
    taken = taken.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    rows = docs.join(taken, docs[id_col].eqNullSafe(taken["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == taken["_key"]))
    return rows.select(*[docs[c] for c in docs.columns if c != "mix_epoch"], F.explode(F.sequence(F.lit(0).cast("long"), taken["_last"])).alias("mix_epoch"))
