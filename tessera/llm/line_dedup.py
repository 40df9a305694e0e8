"""Delete repeated runs of lines, keeping the first copy, with DataFrame functions only.

The non-blank lines of each document form a sequence of line ids. Ranks of the suffixes of these sequences by their
first 1, 2, 4, ... lines come from prefix doubling: the rank over 2k lines orders pairs of ranks over k lines, k lines
apart. Each round counts the distinct pairs, sorts them over range partitions and numbers them in that order, so no key
and no order passes through one task. Suffixes of equal rank are one interval of the suffix array with a common prefix
of that many lines; intervals of one suffix cannot repeat and drop out before the next round.

A repeated run counts when it has at least ``min_words`` words. For every line the shortest run of that many words that
begins there, and the one that ends there, is looked up as an interval: two overlapping ranks of the largest power of
two that fits name a run of any length. A run of lines that also occurs earlier (smaller doc_id, then smaller line)
is covered exactly by such shortest runs, hence every maximal repeated run is deleted in full but for its first copy,
and nothing else is.

Lines end at newline characters. Blank lines belong to no run and stay, as does the text around a run. A null text has
no lines and stays null; a row with a null doc_id is left alone. The input is stored once with a row number, and rows
are told apart by it: of rows that share a doc_id each has its own lines, the one with the smallest number comes first.
Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROW, stored, with_row

MIN_WORDS = 8
#: What tells documents apart, in the order that decides which copy is first.
DOC = ["doc_id", ROW]


def lines_of(docs: DataFrame) -> DataFrame:
    """(*DOC, line, pos, h, words): non-blank lines; ``line`` counts all lines, ``pos`` the non-blank ones. Rows
    without a number get one; a result that is read more than once must then be stored."""
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias(ROW), "text")
    every = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("own")))
    solid = F.filter(every, lambda x: x["own"].rlike(r"\S"))  # numbered inside the row: no line moves for it
    split = own.where("doc_id is not null and text is not null").select(*DOC, F.posexplode(solid).alias("pos", "own"))
    return split.select(*DOC, "own.line", "pos", F.unhex(F.md5("own.own")).alias("h"),
                        F.regexp_count("own.own", F.lit(r"\S+")).alias("words"))


def _ranked(groups: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows (one per group) with a number that grows with ``keys``: the range partition and the place in it."""
    return stored(groups.repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .withColumn(name, F.monotonically_increasing_id()), name)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A small aggregated side dealt by another hash, so that a join shuffles both sides and can split a hot key."""
    return df.repartition(F.xxhash64(*keys, F.lit(1)))


def _shortest_runs(active: DataFrame, min_words: int) -> DataFrame:
    """(*DOC, pos, n): the shortest runs of repeated lines with ``min_words`` words that begin or end at a line."""
    by_doc = Window.partitionBy(*DOC).orderBy("pos")
    apart = active.withColumn("segment", F.col("pos") - F.row_number().over(by_doc))
    upto = Window.partitionBy(*DOC, "segment").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    total = apart.withColumn("upto", F.sum("words").over(upto)).withColumn("before", F.col("upto") - F.col("words"))
    ahead = Window.partitionBy(*DOC, "segment").orderBy("before").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy(*DOC, "segment").orderBy("upto").rangeBetween(-(min_words - 1), 0)
    measured = total.select(
        *DOC, "pos",
        F.when(F.max("upto").over(ahead) - F.col("before") >= min_words, F.count(F.lit(1)).over(ahead)).alias("fore"),
        F.when(F.col("upto") - F.min("before").over(behind) >= min_words, F.count(F.lit(1)).over(behind)).alias("aft"))
    begins = F.struct(F.col("pos").alias("pos"), F.col("fore").alias("n"))
    ends = F.struct((F.col("pos") - F.col("aft") + 1).alias("pos"), F.col("aft").alias("n"))
    same = (F.col("fore") == 1) & (F.col("aft") == 1)
    return (measured.select(*DOC, F.inline(F.when(same, F.array(begins)).otherwise(F.array(begins, ends))))
            .where("n is not null"))


def doubled(suffixes: DataFrame, k: int) -> DataFrame:
    """From (*DOC, pos, r), ranks by the first k lines, the ranks by the first 2k lines: pairs of ranks k lines apart,
    numbered in their order. Suffixes without 2k lines, and those whose first 2k lines occur once, are in no interval
    with another and drop out."""
    after = suffixes.select(*DOC, (F.col("pos") - k).alias("pos"), F.col("r").alias("r2"))
    pairs = stored(suffixes.join(after, [*DOC, "pos"]), "rank-pairs")
    again = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("r", "r2")
    order = _ranked(again, ["r", "r2"], "rank")
    return stored(pairs.join(order, ["r", "r2"]).select(*DOC, "pos", F.col("rank").alias("r")), "suffix-ranks")


def suffix_ranks(lines: DataFrame, doublings: int) -> DataFrame:
    """(*DOC, pos, r): the suffix array of the line sequences by their first 2 ** ``doublings`` lines, restricted to
    intervals of at least two suffixes; equal ranks share that prefix, smaller ranks sort first."""
    repeated = lines.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    out = lines.join(_ranked(repeated, ["h"], "r"), "h").select(*DOC, "pos", "r")
    for n in range(doublings):
        out = doubled(out, 2 ** n)
    return out


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(*DOC, pos, n): shortest runs that also occur earlier. ``lines`` as from ``lines_of``, stored."""
    repeated = lines.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    ranks = _ranked(repeated, ["h"], "r")
    active = stored(lines.join(ranks, "h").select(*DOC, "pos", "words", "r"), "active-lines")
    runs = stored(_shortest_runs(active, min_words), "runs")
    longest = runs.agg(F.max("n")).first()[0] or 0
    suffixes, k, found = active.select(*DOC, "pos", "r"), 1, []
    while k <= longest:
        # runs of k to 2k - 1 lines: the ranks over k lines at their first and their last k lines
        own = runs.where(F.col("n").between(k, 2 * k - 1))
        named = own.join(suffixes, [*DOC, "pos"])
        if k > 1:
            tail = suffixes.select(*DOC, F.col("pos").alias("at"), F.col("r").alias("r2"))
            named = (named.withColumn("at", F.col("pos") + F.col("n") - k).join(tail, [*DOC, "at"])
                     .select(*DOC, "pos", "n", "r", "r2"))
        else:
            named = named.withColumn("r2", F.lit(0).cast("long"))
        named = stored(named, "named-runs")
        place = F.struct(*DOC, "pos")
        first = (named.groupBy("n", "r", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
                 .where("c > 1").select("n", "r", "r2", "first"))
        copies = named.join(_dealt(first, "r", "r2", "n"), ["n", "r", "r2"]).where(place > F.col("first"))
        found.append(stored(copies.select(*DOC, "pos", "n"), "later-copies"))
        k *= 2
        if k > longest:
            break
        suffixes = doubled(suffixes, k // 2)
    if not found:
        return runs.limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(*DOC, runs): per document that holds later copies, the stretches of lines to delete, as an ascending array of
    (first, last) line numbers from 0."""
    lines = stored(lines_of(docs), "lines")
    covered = (later_copies(lines, min_words)
               .select(*DOC, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos"))
               .distinct())
    marked = covered.join(lines.select(*DOC, "pos", "line"), [*DOC, "pos"])
    island = F.col("line") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line"))
    runs = marked.select(*DOC, "line", island.alias("island")).groupBy(*DOC, "island").agg(
        F.min("line").alias("first"), F.max("line").alias("last"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _cut(docs: DataFrame, min_words: int) -> DataFrame:
    """The columns of ``docs`` with the new text, and __n_lines, __n_deleted, __emptied."""
    rows = with_row(docs)
    runs = repeated_runs(rows, min_words).select(ROW, F.col("runs").alias("__runs"))
    joined = rows.join(runs, ROW, "left")
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    some = F.size("__runs")
    # what stays: the stretches between the deleted ones
    stays = F.filter(F.transform(F.sequence(F.lit(0), some), lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.get("__runs", i - 1)["last"] + 1).alias("a"),
        F.when(i == some, n).otherwise(F.get("__runs", i)["first"]).alias("b"))), lambda x: x["b"] > x["a"])
    text = F.array_join(F.transform("__stays", lambda x: F.array_join(
        F.slice("__lines", x["a"] + 1, x["b"] - x["a"]), "\n")), "\n")
    gone = F.coalesce(F.aggregate("__runs", F.lit(0), lambda t, x: t + x["last"] - x["first"] + 1), F.lit(0))
    changed = joined.withColumns({"__n_lines": n, "__n_deleted": gone,
                                  "__lines": F.when(some > 0, F.split("text", "\n")),
                                  "__stays": F.when(some > 0, stays)})
    out = changed.withColumn("__new", F.when(some > 0, text).otherwise(F.col("text")))
    emptied = (F.col("__n_deleted") > 0) & ~F.col("__new").rlike(r"\S")
    return out.select(*[F.col("__new").alias(c) if c == "text" else F.col(c) for c in docs.columns], "__n_lines",
                      "__n_deleted", emptied.alias("__emptied"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies deleted from ``text``, and the columns n_lines (before), n_deleted and emptied
    (every non-blank line was deleted), in place of input columns of these names."""
    added = ["n_lines", "n_deleted", "emptied"]
    out = _cut(docs, min_words)
    return out.select(*[c for c in docs.columns if c not in added], *[F.col(f"__{c}").alias(c) for c in added])


def without_later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the same columns and the later copies deleted; documents of nothing else are left out, and n_chars,
    if there is such a column, counts the letters of a changed text."""
    out = _cut(docs, min_words).where(~F.col("__emptied"))
    if "n_chars" in docs.columns:
        chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__n_deleted") > 0, chars).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
