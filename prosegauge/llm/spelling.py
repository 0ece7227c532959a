"""Operator 11: groups of spelling variants by permuterm rotations."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosegauge.llm.common import dropped, saved

#: A word's letters, and the mark that ends a word; it is no letter.
RUN, END = "[A-Za-zÀ-ÿ]+", "$"
#: Fewest code points and occurrences of a word, and how much more often its form must occur.
LENGTH, TIMES, RATIO = 7, 2, 10
#: Parts in which the rotations are sorted, one after the other.
PASSES = 4
#: A run loses a letter where its checksum is a multiple of this.
SLIPS = 31


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else."""
    return F.when(F.lower(text) == text, text).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(docs: DataFrame) -> DataFrame:
    """Different words of whole texts, ``word``, and how often each occurs, ``n``.

    A run of letters whose crc32 with its document's id is a multiple of ``SLIPS`` loses one code point. Runs of null
    texts do not exist; runs of rows without doc_id stay as they are. Short words and single occurrences are left out.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))
    runs = docs.select(F.col("doc_id").cast("string").alias("_id"), run.alias("_run")).where(F.length("_run") >= LENGTH)
    runs = runs.select("_id", lower_ascii(F.col("_run")).alias("word"))
    runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary")))
    at = (F.col("_h") % F.length("word")).cast("int")
    slip = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    found = runs.select(F.when(F.col("_h") % SLIPS == 0, slip).otherwise(F.col("word")).alias("word"))
    return found.where(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TIMES)


def rotations(found: DataFrame, turn: int) -> DataFrame:
    """The rotations of ``word + END`` as prefixes that words near each other share: ``key``, ``skipped``, ``n``.

    A rotation starts behind a place in the word and ends before it: what stands behind, ``END``, what stands before.
    With the whole rotation as key nothing is skipped; without its last letter, that letter is. Two words that share a
    key and both skip a letter differ by a replacement; one that skips a letter is the one that skips none and a letter
    more. Only keys whose length has the remainder ``turn``: keys of two lengths never meet.
    """
    length = F.length("word")
    before, behind = F.substring(F.col("word"), F.lit(1), F.col("_at")), F.substring(F.col("word"), F.col("_at") + 1, length)
    turned = lambda first, turn: found.where((length + 1 - first) % PASSES == turn).select(
        "word", "n", F.explode(F.sequence(F.lit(first), length)).alias("_at")).select("n", behind.alias("_b"), before.alias("_a"))
    whole = turned(0, turn).select(F.concat("_b", F.lit(END), "_a").alias("key"), F.lit("").alias("skipped"), "n")
    cut = turned(1, turn).select(
        F.concat("_b", F.lit(END), F.expr("left(_a, length(_a) - 1)")).alias("key"), F.expr("right(_a, 1)").alias("skipped"), "n")
    return whole.unionByName(cut)


def _scanned(found: DataFrame, turn: int) -> DataFrame:
    """``word``, ``near`` (words near it) and ``best`` of them under each key of a turn.

    Rotations are sorted and each key's group is scanned once. A group holds one row a letter of the alphabet and one
    without, so it is bounded whatever the input; each of its rows leaves with the number of its partners and the best of
    them (largest n, ties to the smallest), so pairs are never listed. A replacement is found under one key. An indel is
    found under a key for each of the equal letters that the edited one stands with, and counts under the one that skips
    the first of them.
    """
    rank = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    word = F.concat(F.substring_index("key", END, -1), F.col("skipped"), F.substring_index("key", END, 1))
    rows = rotations(found, turn).select(
        "key", "n", word.alias("word"), (F.col("skipped") == "").alias("whole"),
        ((F.col("skipped") != "") & (F.right(F.substring_index("key", END, -1), F.lit(1)) != F.col("skipped"))).alias("first"))
    group = W.partitionBy("key").orderBy("whole", F.desc("n"), "word").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cut, first, whole = ~F.col("whole"), F.col("first"), F.col("whole")
    seen = rows.select(
        "word", "whole", "first", rank.alias("own"),
        F.sum(cut.cast("int")).over(group).alias("cuts"), F.sum(first.cast("int")).over(group).alias("firsts"),
        F.sum(whole.cast("int")).over(group).alias("wholes"),
        F.first(F.when(cut, rank)).over(group).alias("top"), F.nth_value(F.when(cut, rank), 2).over(group).alias("next"),
        F.min(F.when(first, rank)).over(group).alias("top_first"), F.last(F.when(whole, rank)).over(group).alias("base"))
    other = F.when(F.col("top") != F.col("own"), F.col("top")).otherwise(F.col("next"))
    met = seen.select(
        "word", F.when(whole, F.col("firsts")).otherwise(F.col("cuts") - 1 + F.when(first, F.col("wholes")).otherwise(0)).alias("near"),
        F.when(whole, F.col("top_first")).otherwise(F.least(other, F.when(first, F.col("base")))).alias("best"))
    return met.where("near > 0")


def neighbours(found: DataFrame) -> DataFrame:
    """For each word with a near one: ``word``, ``n_near`` (how many) and ``best`` (its near word of largest n, ties to
    the smallest; minus its n first)."""
    met = reduce(DataFrame.unionByName, [saved(_scanned(found, turn), "near") for turn in range(PASSES)])
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word on its way over forms, for each word with a form.

    Every round doubles the steps taken. A form occurs ``RATIO`` times as often as its word, so there are no circles,
    and a way is no longer than the logarithm of the largest n.
    """
    ways = saved(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("_ahead"))
        longer = saved(ways.join(ahead, "root", "left").select(
            "word", F.coalesce("_ahead", "root").alias("root"), F.col("_ahead").isNotNull().alias("_more")), "ways")
        dropped(ways)
        ways = longer
        if ways.where("_more").isEmpty():
            return ways.drop("_more")
        ways = ways.drop("_more")
        ways._table_path = longer._table_path


def spelling_groups(docs: DataFrame) -> DataFrame:
    """One row for each word (see ``words``): word, form, root (string), n, n_near, form_n (long).

    Two words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is its near
    word of largest n (ties: smallest in code-point order), if it occurs ``RATIO`` times as often at least; else form and
    form_n are null and the word is its own root. Null and empty texts have no words; a row that occurs again counts
    again; rows without doc_id lose no letters; an empty table gives no rows. Other columns are not read.
    """
    found = saved(words(docs.select("doc_id", "text")), "words")
    near = neighbours(found)
    best_n = -F.col("best.minus")
    some = best_n >= RATIO * F.col("n")
    rated = saved(found.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(some, F.col("best.word")).alias("form"), F.when(some, best_n).alias("form_n")), "rated")
    dropped(found)
    roots = _roots(rated.where("form IS NOT NULL"))
    return rated.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
