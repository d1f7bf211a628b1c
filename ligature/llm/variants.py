"""Problem 4: variant spellings of names typed by people.

Method: metric-space partitioning (``metric``). A name is read into its proper words, first name and line of
business (``names``). Two names lie as far apart as the edits that turn the words of one into those of the
other, word by word in the best order; that is a metric on names, and names within its radius are joined. A word
may hold one edit for every ``LETTERS`` letters of it, a whole name ``RADIUS``.

The join comes down to words without losing a pair: names within two edits differ in one word by up to two
edits, or in two words by one edit each. The words that lie within the radius of each other are found by
pivots, and the names then meet on the whole name that such a step leads to; a step goes from the rarer word to
the commoner one, so a common word is never spread over its misspellings. Two names that are one word each say
less: of those, a spelling that stands in several other names too, and of which the other isn't many times
commoner, is a name of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ligature.llm.metric import radius_pairs
from ligature.llm.names import Lines, line_usage, read_name
from ligature.workspace import discard, materialize, scatter

RADIUS, LETTERS = 2, 4


def read_names(names: DataFrame) -> DataFrame:
    """(country, name) with its sorted distinct proper words, first name and line of business."""
    usage = line_usage(names, "name", "country")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines: dict[str, Lines] = {}
        for pdf in batches:
            parts = [read_name(n, lines[c] if c in lines else lines.setdefault(c, Lines(usage.get(c)))) for n, c in zip(pdf.name, pdf.country, strict=True)]
            yield pd.DataFrame({"country": pdf.country, "name": pdf.name, "words": [sorted(set(p[0])) for p in parts], "first": [p[1] for p in parts], "line": [p[2] for p in parts]})

    return scatter(names, "country", "name").mapInPandas(read, "country string, name string, words array<string>, first string, line string")


def _core(words: Column) -> Column:
    return F.array_join(words, " ")


def _replaced(words: Column, old: Column, new: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.when(w == old, new).otherwise(w))))


def linked_names(cores: DataFrame, times: int = 8) -> DataFrame:
    """(country, a, b), a < b: cores of names within the radius of each other.

    ``cores`` has distinct (country, words), the words sorted and distinct; a core is its words joined by blanks.
    """
    cores = cores.select("country", "words", _core(F.col("words")).alias("core"))
    parts = cores.select("country", "core", "words", F.explode("words").alias("word"))
    uses = materialize(parts.groupBy("country", "word").agg(F.count("*").alias("uses")), "proper-words")
    near = radius_pairs(uses, "country", "word", RADIUS).where(F.col("distance") * LETTERS <= F.greatest(F.length("word_a"), F.length("word_b")))
    # sizes are guessed from files before anything is joined: merge joins hold at any size
    n = lambda w, u: uses.select("country", F.col("word").alias(w), F.col("uses").alias(u)).hint("merge")
    near = near.join(n("word_a", "n_a"), ["country", "word_a"]).join(n("word_b", "n_b"), ["country", "word_b"])
    up = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("word_a") > F.col("word_b")))
    rarer, commoner = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    sure = ((rarer == 1) | (commoner >= times * rarer)).alias("sure")
    near = materialize(near.select("country", F.when(up, F.col("word_a")).otherwise(F.col("word_b")).alias("word"), F.when(up, F.col("word_b")).otherwise(F.col("word_a")).alias("meant"), "distance", sure), "near-words")
    # one step: the name with one word replaced by a commoner one
    step = parts.join(near.hint("merge"), ["country", "word"]).where(F.col("sure") | (F.size("words") > 1))
    step = step.select("country", "core", "words", "meant", "distance", _replaced(F.col("words"), F.col("word"), F.col("meant")).alias("changed"))
    step = materialize(step.where(F.size("changed") == F.size("words")).withColumn("target", _core(F.col("changed"))), "steps")
    known = cores.select("country", F.col("core").alias("target")).hint("merge")
    direct = step.select("country", "core", "target").join(known, ["country", "target"]).select("country", F.col("core").alias("x"), F.col("target").alias("y"))
    # two names one step from the same one: from a name that occurs, or by one edit each in different words
    ones = step.where("distance = 1")
    met = step.join(known.withColumn("known", F.lit(True)).hint("merge"), ["country", "target"], "left").where("known or distance = 1")
    a = met.select("country", "target", F.col("core").alias("x"), F.col("meant").alias("m"), F.col("distance").alias("c"), "known")
    b = met.select("country", "target", F.col("core").alias("y"), F.col("meant").alias("k"), F.col("distance").alias("d"))
    apart = a.join(b.hint("merge"), ["country", "target"]).where("x < y and (known or c = 1 and d = 1 and m <> k)").select("country", "x", "y")
    # two steps in a row, by different words
    again = ones.select("country", "core", "meant", "changed", F.explode("changed").alias("word")).where("word <> meant")
    again = again.join(near.where("distance = 1").select("country", "word", F.col("meant").alias("second")).hint("merge"), ["country", "word"])
    again = again.select("country", F.col("core").alias("x"), F.size("changed").alias("size"), _replaced(F.col("changed"), F.col("word"), F.col("second")).alias("words"))
    again = again.where(F.size("words") == F.col("size")).select("country", "x", _core(F.col("words")).alias("target")).join(known, ["country", "target"]).select("country", "x", F.col("target").alias("y"))
    every = direct.unionByName(apart).unionByName(again).where("x <> y")
    out = materialize(every.select("country", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-names")
    discard(uses, near, step)
    return out


def _fits() -> Column:
    """Equal first names, an initial that fits, or none on either side."""
    a, b = F.col("first_a"), F.col("first_b")
    return (a == b) | (F.least(F.length(a), F.length(b)) == 1) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))


def name_pairs(df: DataFrame, key: str, name: str, country: str) -> DataFrame:
    """Pairs of records of one organisation by name: (key_a, key_b), key_a < key_b, each pair once.

    A record counts once however often it was delivered. Null or empty names, and names without any letter
    or digit, make no pair. An initial fits every first name it may stand for; a missing line of business fits
    every line. Null countries are one country of their own.
    """
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(name).alias("name"), F.coalesce(F.col(country).cast("string"), F.lit("")).alias("country"))
    rows = rows.where("id is not null and name is not null").groupBy("id").agg(F.min(F.struct("name", "country")).alias("x")).select("id", "x.name", "x.country")
    rows = materialize(rows, "names")
    parsed = materialize(read_names(rows.select("country", "name").distinct()).where(F.size("words") > 0), "parsed-names")
    near = linked_names(parsed.select("country", "words").distinct())
    reading = ["country", "core", "first", "line"]
    parsed = parsed.withColumn("core", _core(F.col("words"))).drop("words")
    readings = materialize(parsed.select(*reading).distinct().withColumn("reading", F.monotonically_increasing_id()), "readings")
    cores = readings.select("country", F.col("core").alias("a")).distinct()
    both = near.unionByName(near.select("country", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(cores.select("country", "a", F.col("a").alias("b")))
    x = readings.select("country", F.col("core").alias("a"), F.col("first").alias("first_a"), F.col("line").alias("line_a"), F.col("reading").alias("i"))
    y = readings.select("country", F.col("core").alias("b"), F.col("first").alias("first_b"), F.col("line").alias("line_b"), F.col("reading").alias("j"))
    # equal lines meet on the line as well; a name without a line meets all names of its words
    from_x = both.join(x.hint("merge"), ["country", "a"])
    same = from_x.withColumn("line_b", F.col("line_a")).join(y.hint("merge"), ["country", "b", "line_b"]).where(_fits() & (F.col("i") <= F.col("j"))).select("i", "j")
    open_ = from_x.where("line_a = ''").join(y.where("line_b <> ''").hint("merge"), ["country", "b"]).where(_fits()).select("i", "j")
    linked = materialize(same.unionByName(open_), "linked-readings")
    members = materialize(rows.join(parsed.hint("merge"), ["country", "name"]).join(readings.hint("merge"), reading).select("id", "reading"), "members")
    m, o = members.select(F.col("reading").alias("i"), F.col("id").alias("p")), members.select(F.col("reading").alias("j"), F.col("id").alias("q"))
    pairs = linked.join(m.hint("merge"), "i").join(o.hint("merge"), "j").where((F.col("i") != F.col("j")) | (F.col("p") < F.col("q")))
    discard(rows, near)
    return pairs.select(F.least("p", "q").alias("key_a"), F.greatest("p", "q").alias("key_b"))
