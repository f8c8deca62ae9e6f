"""Cross-document line frequency, with DataFrame functions only.

Each line is normalised (lower case, without ASCII digits and common punctuation, trimmed) and
hashed together with its host. A line that more than `max_docs` documents of its host hold is removed
everywhere in that host; a document of whose word characters more than `max_removed` went that way is
depleted and rejected.

The limit is a count of documents, not a share of the host: more rows can only add to the lines that
are removed, and a host that grows protects none.

Defined results: a null text has no words and no lines; lines without a word are never counted; a
null host is a host of its own; a line that a document repeats counts once for it; two rows that
have both id and text in common are one document for the counts, and each gets the result; empty
tables give empty results. Extra columns are left out of the result.

A line that a third of all rows hold is no hot task: counts are summed before the shuffle, and the
join that finds the removed lines is a plain equi-join that adaptive execution splits by size or
broadcasts when the frequent lines turn out to be few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Left out of a line before it is hashed.
DROPPED = "0123456789.,;:!?\"'()[]-_\t\x0b\f\r"


def word_characters(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def line_array(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.translate(x, SPACES, "") != "")


def normalised(line: Column) -> Column:
    bare = F.trim(F.translate(F.lower(line), DROPPED, ""))
    return F.when(bare != "", bare).otherwise(F.trim(F.lower(line)))


def base_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    n_repeat_words is worked out from hashes of the 3-word windows: only a text that has some window
    twice sorts them (by hash, then place), and the places found are joined to a count of words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.withColumn("_w", word_array(F.col(text_col))).withColumn("_lines", line_array(F.col(text_col)))
    step = step.withColumn("n_words", F.size("_w").cast("long")).withColumn(
        "_h",
        F.when(F.size("_w") < 3, F.expr("cast(array() as array<bigint>)")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
        ),
    )
    step = step.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "n_words",
        word_characters(text).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ).alias("_s"),
    )
    twice = lambda s, k: (s["h"] == F.get("_s", k - 1)["h"]) | (s["h"] == F.get("_s", k + 1)["h"])
    places = F.filter(F.transform("_s", lambda s, k: F.when(F.coalesce(twice(s, k), F.lit(False)), s["i"])), lambda p: p.isNotNull())
    step = step.withColumn("_p", F.sort_array(places))
    gained = F.transform("_p", lambda p, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("_p", k - 1))).cast("long"))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(gained, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_s", "_p")
    return step.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def removed_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10) -> DataFrame:
    """(id, text hash, total and removed word characters) of every document that has a line."""
    lines = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_text"),
        F.xxhash64(host_col).alias("_host"),
        F.explode(line_array(F.col(text_col))).alias("_line"),
    ).select("_id", "_text", "_host", F.xxhash64("_host", normalised(F.col("_line"))).alias("_h"), word_characters(F.col("_line")).cast("long").alias("_chars"))
    held = lines.groupBy("_id", "_text", "_host", "_h").agg(F.sum("_chars").alias("_chars"))
    # counts _chars, never null, so that both uses of `held` ask for the same columns and share its exchange
    counted = held.groupBy("_host", "_h").agg(F.count("_chars").alias("_docs")).where(F.col("_docs") > max_docs)
    frequent = counted.select("_h", F.lit(True).alias("_frequent"))
    return (
        held.join(frequent, "_h", "left")
        .groupBy("_id", "_text")
        .agg(F.sum("_chars").alias("_total"), F.sum(F.when(F.col("_frequent"), F.col("_chars")).otherwise(0)).alias("_removed"))
    )


def line_frequency_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10, max_removed: float = 0.7
) -> DataFrame:
    """Per document: id, the base measures, removed_chars, base_failed and kept."""
    base = base_measures(docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col).alias("_text")), text_col).drop(text_col)
    share = removed_share(docs, id_col, text_col, host_col, max_docs)
    joined = base.join(share, base[id_col].eqNullSafe(share["_id"]) & (base["_text"] == share["_text"]), "left").select(base["*"], "_total", "_removed")
    depleted = F.coalesce(F.col("_removed") > F.lit(max_removed) * F.col("_total"), F.lit(False))
    return joined.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 10) -> DataFrame:
    """`docs` with the removed lines cut out of the texts; the order of the rest is kept.

    The lines go through a shuffle with their texts, so this is for when the cut texts are wanted.
    """
    columns = docs.columns
    keyed = docs.withColumn("_text", F.xxhash64(text_col)).withColumn("_host", F.xxhash64(host_col))
    lines = keyed.select(F.col(id_col).alias("_id"), "_text", "_host", F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("_at", "_line"))
    lines = lines.withColumn("_h", F.when(F.translate("_line", SPACES, "") != "", F.xxhash64("_host", normalised(F.col("_line")))))
    held = lines.where(F.col("_h").isNotNull()).select("_id", "_text", "_host", "_h").distinct()
    counted = held.groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > max_docs)
    frequent = counted.select("_h", F.lit(True).alias("_frequent"))
    cut = lines.join(frequent, "_h", "left").where(F.col("_frequent").isNull()).groupBy("_id", "_text").agg(F.collect_set(F.struct("_at", "_line")).alias("_left"))
    joined = keyed.join(cut, keyed[id_col].eqNullSafe(cut["_id"]) & keyed["_text"].eqNullSafe(cut["_text"]), "left")
    text = F.array_join(F.transform(F.array_sort("_left"), lambda x: x["_line"]), "\n")
    return joined.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.coalesce(text, F.lit("")))).select(*[keyed[c] if c != text_col else F.col(text_col) for c in columns])
