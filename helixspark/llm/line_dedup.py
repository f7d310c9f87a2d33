r"""Line dedup with a log-template tree; DataFrame functions only.

A line's words are masked where they hold a digit, and the masked line is its
template. The tree has fixed depth: a line's branch is its number of words, its
leaf the first ``depth`` masked words below that. Below a leaf the words that
follow are cut into ``blocks`` blocks (one word each in lines of ``depth +
blocks`` words or fewer). A general template leaves ``fields`` of the blocks
open (one block in lines shorter than ``long_words``) and fixes all others, so
it holds all lines of the leaf that differ in these blocks only. Each line
belongs to every general template that fits it; none is chosen by order or
rank, and a leaf may have any number of them.

A template recurs if it stands in enough different documents, and its lines are
dropped in all of them but the first. Enough are ``long_docs`` for
``long_words`` words or more and ``short_docs`` for fewer (``merged_docs`` for
general templates, which take lines of ``merged_words`` words or more). Shorter
lines count together too: from each line on, the fewest consecutive lines with
words that have ``long_words`` words in all are one passage, which recurs like a
long line. Copies of a whole document thus lose all but one set of their lines.

Only 128-bit digests travel, and the words of lines in leaves with several
templates. Counting sums map-side by document first, and hot templates are
joined by a broadcast of bounded size, so a line that a third of all documents
share needs no task of its own. Texts are shuffled once, with the places to drop.

Null texts stay null, lines without words stay. Which line is first: smallest
document id (null last), then text key, then place; a line that fits several
recurring templates stays only if it is the first of each. Each row gives one
row, an empty table none; rows that repeat id and text are one document. Very
long texts and lines are handled like all others. Other columns are untouched
and may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, written
from .joins import join_hot


@dataclass(frozen=True)
class LineRules:
    depth: int = 3
    blocks: int = 10
    fields: int = 2
    long_words: int = 10
    long_docs: int = 2
    short_docs: int = 10
    merged_words: int = 5
    merged_docs: int = 10
    broadcast_leaves: int = 500_000  # of eight bytes; more are joined by a shuffle


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _even(text: Column) -> Column:
    """The text with one blank between the words of a line and none around them; most texts are so already."""
    signs = ["  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r"]
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for sign in signs:
        odd = odd | F.contains(text, F.lit(sign))
    single = F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")
    return F.when(odd, F.regexp_replace(single, r"(?dm)^\x20|\x20$", "")).otherwise(text)


def _masked(line: Column) -> Column:
    """A word with a digit is a variable field."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>")).otherwise(line)


def _n_words(line: Column) -> Column:
    # Of bytes, which strings know; letters would be counted.
    return F.when(line == "", F.lit(0)).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1)


def _worded_lines(text: Column) -> Column:
    """The lines of an even text that have words: place, line, number of words."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"), _n_words(x).alias("n"))), lambda x: x["n"] > 0)


def _range(first: Column, last: Column) -> Column:
    """Two places as one number that sorts by the first."""
    return F.call_function("shiftleft", first.cast("long"), F.lit(32)) + last


def _passage(lines: Column, x: Column, i: Column, rules: LineRules) -> Column:
    """For a short line: the lines from it on that have ``long_words`` words in all, as an array of one; null if the text ends before."""
    add = lambda a, y: F.when(a["n"] >= rules.long_words, a).otherwise(F.struct((a["n"] + y["n"]).alias("n"), (a["k"] + 1).alias("k")))
    upto = F.aggregate(F.slice(lines, i + 1, F.lit(rules.long_words)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), add)

    def unit(k: Column) -> Column:
        own = F.transform(F.slice(lines, i + 1, k), lambda y: y["line"])
        return F.struct(F.array_join(own, " ").alias("line"), F.lit(rules.long_words).alias("n"), _range(x["at"], F.get(lines, i + k - 1)["at"]).alias("range"), F.lit(False).alias("single"))

    # One element or none, so that the end of the run is looked for once.
    ends = F.filter(F.array(upto), lambda a: a["n"] >= rules.long_words)
    return F.when(x["n"] < rules.long_words, F.transform(ends, lambda a: unit(a["k"])))


def _units(docs: DataFrame, rules: LineRules) -> DataFrame:
    """doc_id, text_key, key (digest), n words, leaf (null for passages), range (first and last line): the lines and passages of all texts."""
    rows = docs.select("doc_id", "text_key", _worded_lines(_even(F.col("text"))).alias("ls"))
    line = lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), _range(x["at"], x["at"]).alias("range"), F.lit(True).alias("single"))
    passages = F.filter(F.transform("ls", lambda x, i: _passage(F.col("ls"), x, i, rules)), lambda p: p.isNotNull())
    rows = rows.select("doc_id", "text_key", F.explode(F.concat(F.transform("ls", line), F.flatten(passages))).alias("u"))
    rows = rows.select("doc_id", "text_key", "u.range", "u.n", "u.single", _masked(F.col("u.line")).alias("masked"))
    key = _digest(F.when(F.col("single"), F.col("masked")).otherwise(F.concat(F.lit("\n"), F.col("masked"))))
    leaf = F.when(F.col("single"), _leaf(F.col("n"), _head(F.col("masked"), rules)))
    return rows.select("doc_id", "text_key", key.alias("key"), F.least("n", F.lit(rules.long_words)).alias("n"), leaf.alias("leaf"), "range")


def _head(line: Column, rules: LineRules) -> Column:
    return F.substring_index(line, " ", rules.depth)


def _leaf(n: Column, head: Column) -> Column:
    """``head``: the first masked words."""
    return F.xxhash64(n, head)


def _with_blocks(lines: DataFrame, rules: LineRules) -> DataFrame:
    """``lines`` (masked, n) as key, n, head and digests of their blocks."""
    m = F.col("n") - rules.depth
    b = F.least(m, F.lit(rules.blocks))
    edge = lambda i: (F.lit(rules.depth) + F.floor(i * m / b)).cast("int")
    block = lambda i: F.md5(F.array_join(F.slice(F.col("words"), edge(i) + 1, edge(i + 1) - edge(i)), " ").cast("binary"))
    head = F.md5(F.concat_ws(" ", F.col("n").cast("string"), _head(F.col("masked"), rules)).cast("binary"))
    # Cut here, so that words are made once for each line and not for each block.
    lines = cut(lines.select(_digest(F.col("masked")).alias("key"), "n", head.alias("head"), F.split("masked", " ").alias("words")))
    return lines.select("key", "n", "head", F.transform(F.sequence(F.lit(0), b - 1), block).alias("blocks"))


#: A general template's digest, in two numbers.
_GENERAL = ["high", "low"]


def _general(lines: DataFrame, rules: LineRules) -> DataFrame:
    """``line, high, low``: digests of the general templates that each of ``lines`` (line, n, head, blocks) fits.

    Each half is the exclusive or of one number for the head and one for each
    fixed block and its place, so an open block is taken out of the line's own number.
    """
    last = F.col("blocks") - 1
    one = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), i.alias("j")))
    two = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    open_ = one if rules.fields == 1 else F.when(F.col("n") < rules.long_words, one).otherwise(two)
    halves = dict(zip(_GENERAL, (1, 17), strict=True))

    def terms(at: int) -> Column:
        return F.transform("blocks", lambda x, k: F.xxhash64(k, F.substring(x, at, 16)))

    def alone(c: str, at: int) -> Column:
        return F.aggregate(c, F.xxhash64(F.lit(-1), F.substring("head", at, 16)), lambda x, y: x.bitwiseXOR(y))

    rows = lines.select("line", "n", "head", F.size("blocks").alias("blocks"), *(terms(at).alias(c) for c, at in halves.items()))
    rows = rows.select("line", *_GENERAL, *(alone(c, at).alias(f"all_{c}") for c, at in halves.items()), F.explode(open_).alias("o"))

    def without(c: str) -> Column:
        i = F.col(f"all_{c}").bitwiseXOR(F.get(c, F.col("o.i")))
        return F.when(F.col("o.i") == F.col("o.j"), i).otherwise(i.bitwiseXOR(F.get(c, F.col("o.j"))))

    return rows.select("line", *(without(c).alias(c) for c in _GENERAL))


def _first_and_last() -> tuple[Column, Column]:
    at = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")
    return F.min(at).alias("first"), F.max(at).alias("last")


def _general_recurring(docs: DataFrame, per_doc: DataFrame, counts: DataFrame, rules: LineRules) -> DataFrame:
    """``key, first``: lines' templates that fit a general one that recurs, and where the first of those stands."""
    single = counts.where(F.col("leaf").isNotNull())
    leaves = single.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("docs").alias("all_docs"), F.max("n").alias("n"))
    leaves = cut(leaves.where((F.col("kinds") > 1) & (F.col("n") >= rules.merged_words) & ((F.col("n") >= rules.long_words) | (F.col("all_docs") >= rules.merged_docs))).select("leaf"))
    lines = docs.select(F.explode(F.split(_even(F.col("text")), "\n")).alias("line")).where("line != ''").withColumn("n", _n_words(F.col("line")))
    # Masks keep the number of words, so the leaf needs only the masks of its words.
    lines = lines.withColumn("leaf", _leaf(F.col("n"), _masked(_head(F.col("line"), rules))))
    lines = lines.join(F.broadcast(leaves) if leaves.count() <= rules.broadcast_leaves else leaves, "leaf", "left_semi").select(_masked(F.col("line")).alias("masked"), "n").distinct()
    # A line is a number from here on.
    lines = cut(_with_blocks(lines, rules).join(single.select("key", "docs", "first", "last"), "key").withColumn("line", F.monotonically_increasing_id()))
    pairs = _general(lines, rules)
    crowded = cut(pairs.groupBy(*_GENERAL).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    if crowded.count() <= rules.broadcast_leaves:
        pairs = pairs.join(F.broadcast(crowded), _GENERAL)
    else:
        pairs = join_hot(cut(pairs), crowded, _GENERAL, "kinds")
    info = lines.select("line", "key", "n", "docs", "first", "last")
    fits = cut(pairs.drop("kinds").join(info, "line"))
    groups = fits.groupBy(*_GENERAL).agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("n"), F.sum("docs").alias("docs"), F.max("docs").alias("most"), F.min("first").alias("first"), F.max("last").alias("last"))
    groups = cut(groups.where(((F.col("n") >= rules.long_words) & (F.col("first") != F.col("last"))) | ((F.col("n") < rules.long_words) & (F.col("docs") >= rules.merged_docs))))
    # Short lines need more documents, which several variants may share. A template in that many is enough by itself, so only rarer ones are looked up.
    sure = (F.col("n") >= rules.long_words) | (F.col("most") >= rules.merged_docs)
    if rules.long_docs > 2:
        sure = F.col("most") >= F.when(F.col("n") >= rules.long_words, rules.long_docs).otherwise(rules.merged_docs)
    open_ = join_hot(fits.select("key", *_GENERAL), groups.where(~sure).select(*_GENERAL, "kinds"), _GENERAL, "kinds").select("key", *_GENERAL)
    least = F.when(F.col("n") >= rules.long_words, rules.long_docs).otherwise(rules.merged_docs)
    enough = open_.join(per_doc.select("key", "n", "doc_id", "text_key"), "key").select(*_GENERAL, "n", "doc_id", "text_key").distinct().groupBy(*_GENERAL, "n").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    wide = cut(groups.where(sure).select(*_GENERAL, "first", "kinds").unionByName(groups.join(enough.select(*_GENERAL), _GENERAL).select(*_GENERAL, "first", "kinds")))
    return join_hot(fits.select("key", *_GENERAL), wide, _GENERAL, "kinds").groupBy("key").agg(F.min("first").alias("first"))


def recurring_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``doc_id, text_key, at``: the lines to drop, and some without words between them. ``docs`` has doc_id, text and text_key."""
    # A document is its id and text; rows that repeat both are merged here.
    per_doc = written(_units(docs, rules).groupBy("key", "leaf", "n", "doc_id", "text_key").agg(F.collect_set("range").alias("ranges")))
    counts = cut(per_doc.groupBy("key", "leaf", "n").agg(F.count(F.lit(1)).alias("docs"), *_first_and_last()))
    enough = F.when(F.col("n") >= rules.long_words, F.lit(rules.long_docs)).otherwise(F.lit(rules.short_docs))
    exact = counts.where(F.col("docs") >= enough).select("key", "first")
    dropped = exact.unionByName(_general_recurring(docs, per_doc, counts, rules)).groupBy("key").agg(F.min("first").alias("first"))
    dropped = cut(dropped.join(counts.select("key", "docs"), "key"))

    marked = join_hot(per_doc.select("key", "doc_id", "text_key", "ranges"), dropped, "key", "docs")
    here = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_key").eqNullSafe(F.col("first.text_key"))
    # The first document keeps the first place of the template.
    kept = F.when(here, F.array_min("ranges"))
    begin, end = (lambda r: F.call_function("shiftright", r, F.lit(32)).cast("int")), (lambda r: r.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    rows = marked.select("doc_id", "text_key", kept.alias("kept"), F.explode("ranges").alias("r")).where("kept is null or r != kept")
    rows = rows.select("doc_id", "text_key", "kept", F.explode(F.sequence(begin(F.col("r")), end(F.col("r")))).alias("at"))
    return rows.where(F.col("kept").isNull() | (F.col("at") < begin(F.col("kept"))) | (F.col("at") > end(F.col("kept")))).select("doc_id", "text_key", "at")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("text_key", F.xxhash64("text"))


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with recurring lines removed from the text; all columns as they are.

    ``counts`` adds ``n_lines`` and ``n_dropped`` instead of passing other columns on.
    """
    gone = recurring_lines(_keyed(docs, id_col, text_col), rules)
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("_gone")).withColumnsRenamed({"doc_id": "_gone_id", "text_key": "_gone_key"})
    text = docs[text_col].cast("string")
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(text) == gone["_gone_key"]), "left")

    # Lines without words in a passage stay.
    keep = lambda line, at: ~F.array_contains(gone["_gone"], at) | ~line.rlike(r"[^\x20\x09-\x0D]")
    left = F.filter(F.split(text, "\n"), keep)
    new = F.when(gone["_gone"].isNull(), text).otherwise(F.array_join(left, "\n"))
    if counts:
        n = F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long")
        dropped = F.when(gone["_gone"].isNull(), F.lit(0)).otherwise(F.size(F.split(text, "\n")) - F.size(left)).cast("long")
        return joined.select(docs[id_col].alias("doc_id"), new.alias("text"), n.alias("n_lines"), dropped.alias("n_dropped"))
    return joined.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
