"""Problem 1: the same postal address written differently.

Method: a self-built gazetteer. All addresses are read (``places``); the towns and, within each town, the
street spellings that occur are counted and clustered, a rare spelling pointing to the commoner ones one edit
away. The gazetteer's entries are (country, town, street); their spelling in the most common form is the
street's identifier. Every address is then resolved by a beam search over the entries: its readings are
expanded first by the towns they may mean, then by the streets of those towns, and after each step the best
``beam`` hypotheses stay. Addresses meet on identifier, direction and number, and on the unit if asked for; a
street type may be missing. A floor, building, landmark, area or state makes no other place.

Spellings one edit apart are found by an equi-join on words and their one-letter deletions, which is exact
and linear in the number of spellings. Nothing depends on how many records there are: a spelling always keeps
the commoner ones near it as hypotheses, and the entries that other addresses state decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ligature.llm.names import damerau
from ligature.llm.places import read_parts
from ligature.workspace import discard, materialize, scatter, spread

PLACE = ["country", "town", "street", "direction", "number", "type"]
#: A spelling of fewer letters than this has no near ones: one edit makes another word of it.
LEAST = 4


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("number", "direction", "street", "type", "town")
    for pdf in batches:
        parts = [read_parts(a, c) for a, c in zip(pdf.address, pdf.country, strict=True)]
        yield pdf.assign(unit=[p[1] for p in parts], readings=[[dict(zip(names, r, strict=True)) for r in p[0]] for p in parts])


def read_addresses(addresses: DataFrame) -> DataFrame:
    """Distinct (country, address) rows with their unit and array of readings."""
    reading = "struct<number:string,direction:string,street:string,type:string,town:string>"
    return scatter(addresses, "country", "address").mapInPandas(_read, f"country string, address string, unit string, readings array<{reading}>")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, to) of rows (key, at, uses), sorted by key: all pairs of a key, towards the one that isn't used less."""
    held = [np.empty(0, np.int64) for _ in range(3)]

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, at, uses = rows
        first, step = np.arange(len(key)), 1
        while len(first := first[first + step < len(key)]) and len(first := first[key[first] == key[first + step]]):
            a, b = first, first + step
            up, down = uses[b] >= uses[a], uses[a] >= uses[b]
            x, y = np.concatenate([at[a[up]], at[b[down]]]), np.concatenate([at[b[up]], at[a[down]]])
            yield pa.record_batch([pa.array(x[x != y]), pa.array(y[x != y])], ["at", "to"])
            step += 1

    for batch in batches:
        rows = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        # the last key may go on in the next batch
        n = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        yield from pairs([x[:n] for x in rows])
        held = [x[n:] for x in rows]
    yield from pairs(held)


def near_spellings(words: DataFrame, scope: list[str], word: str, uses: str) -> DataFrame:
    """(scope..., word, meant): a spelling and one not less common, one edit away, that it may stand for.

    Of equally common ones the smaller string counts as the commoner. Spellings with a digit ("5th") and of
    fewer than ``LEAST`` letters stand for themselves only.
    """
    rows = words.select(*scope, F.col(word).alias("word"), F.col(uses).alias("uses")).where((F.length("word") >= LEAST - 1) & ~F.col("word").rlike("[0-9]"))
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substr(F.col("word"), F.lit(1), i - 1), F.substr(F.col("word"), i + 1)))
    # only hashes are exploded and joined; the words themselves come back for the pairs that are left
    named = rows.withColumn("at", F.xxhash64(*scope, "word"))
    keyed = named.select("at", "uses", F.explode(F.array_distinct(F.transform(F.concat(F.array("word"), cut), lambda x: F.xxhash64(*scope, x)))).alias("key"))
    # spellings of one key stand together after one sort; a join of the keys with themselves would shuffle them twice
    sorted_keys = keyed.repartition(spread(words.sparkSession), "key").sortWithinPartitions("key").select("key", "at", F.col("uses").cast("long"))
    pairs = sorted_keys.mapInArrow(_meet, "at long, to long").distinct()
    meant = named.select(F.col("at").alias("to"), F.col("word").alias("meant"), F.col("uses").alias("m"))
    pairs = pairs.join(named.select("at", *scope, "word", "uses"), "at").join(meant, "to").where((F.col("m") > F.col("uses")) | (F.col("meant") < F.col("word")))
    pairs = pairs.where(F.greatest(F.length("word"), F.length("meant")) >= LEAST)

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([damerau(i, j, 1) <= 1 for i, j in zip(x, y, strict=True)], dtype=bool)

    return pairs.where(close("word", "meant")).select(*scope, "word", "meant")


def _best(df: DataFrame, by: list[Column | str], most: int) -> DataFrame:
    w = Window.partitionBy("at").orderBy(*by)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def resolve(addresses: DataFrame, beam: int = 4) -> DataFrame:
    """Places of distinct (country, address) rows: PLACE columns and unit beside country and address.

    Addresses in which no house number with a street can be read have no row.
    """
    # numbers stand for the addresses during the search; they are fixed by being written
    texts = materialize(read_addresses(addresses).withColumn("at", F.monotonically_increasing_id()), "address-readings")
    read = texts.select("at", "country", F.posexplode("readings").alias("reading", "r")).select("at", "country", "reading", "r.*")
    towns = materialize(read.groupBy("country", "town").agg(F.countDistinct("street", "number").alias("town_uses")), "towns")
    near = near_spellings(towns, ["country"], "town", "town_uses").select("country", F.col("word").alias("town"), "meant", F.lit(1).alias("edits"))
    to_town = towns.select("country", "town", F.col("town").alias("meant"), F.lit(0).alias("edits"), "town_uses").unionByName(near.join(towns.withColumnRenamed("town", "meant"), ["country", "meant"]))
    # first step of the search: towns that a reading may mean; one that nobody else states comes last
    step = read.join(to_town, ["country", "town"]).drop("town").withColumnRenamed("meant", "town")
    step = _best(step, [(F.col("town_uses") <= 1) & (F.col("edits") == 0), "edits", F.desc("town_uses"), "reading", "town"], beam)
    step = materialize(step, "town-hypotheses")
    # streets of the towns as stated there, without the addresses' own guesses at other towns
    streets = step.groupBy("country", "town", "street").agg(F.countDistinct("number", "at").alias("uses"), F.sum(F.when(F.col("edits") == 0, 1).otherwise(0)).alias("stated"))
    streets = materialize(streets, "streets")
    # written by itself, so that its shuffles are gone before those of the search begin
    other = materialize(near_spellings(streets, ["country", "town"], "street", "uses").select("country", "town", F.col("word").alias("street"), "meant", F.lit(1).alias("off")), "street-spellings")
    support = streets.select("country", "town", F.col("street").alias("meant"), "uses", "stated")
    to_street = streets.select("country", "town", "street", F.col("street").alias("meant"), F.lit(0).alias("off"), "uses", "stated").unionByName(other.join(support, ["country", "town", "meant"]))
    last = step.join(to_street, ["country", "town", "street"])
    # an entry that other addresses state beats one that only this address makes up
    others = F.col("uses") > F.when(F.col("off") == 0, 1).otherwise(0)
    stated = F.col("stated") > F.when((F.col("edits") == 0) & (F.col("off") == 0), 1).otherwise(0)
    one = _best(last, [~(others & stated), F.col("edits") + F.col("off"), F.desc("uses"), F.desc("town_uses"), "reading", "town", "meant"], 1)
    one = materialize(one.select("at", "country", "town", F.col("meant").alias("street"), "direction", "number", "type"), "places")
    discard(step, towns, streets, other)
    # a number on the same street, or in the same town, is evidence enough to take one edit as a typo
    for name, rest in (("town", "street"), ("street", "town"), ("town", "street")):
        before, one = one, _settle(one, ["country", "direction", "number", rest], name)
        discard(before)
    out = materialize(one.drop("country").join(texts.select("at", "country", "address", "unit"), "at").drop("at"), "places")
    discard(one, texts)
    return out


def _settle(places: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Replaces a spelling by the most used one of its scope that is one edit away and more used."""
    used = places.groupBy(*scope, name).agg(F.count("*").alias("uses"))
    several = used.groupBy(*scope).agg(F.count("*").alias("spellings")).where("spellings > 1").select(*scope)
    used = materialize(used.join(several, scope, "left_semi"), "spellings-of-places")
    near = near_spellings(used, scope, name, "uses")
    near = near.join(used.withColumnRenamed(name, "meant"), [*scope, "meant"]).groupBy(*scope, F.col("word").alias(name)).agg(F.min(F.struct((-F.col("uses")).alias("n"), "meant"))["meant"].alias("meant"))
    out = materialize(places.join(near, [*scope, name], "left").withColumn(name, F.coalesce("meant", name)).drop("meant").select(*places.columns), "places")
    discard(used)
    return out


def located(df: DataFrame, key: str, address: str, country: str) -> DataFrame:
    """Records with the place of their address: (id, PLACE..., unit), one row for each record with a readable address."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(address).alias("address"), F.coalesce(F.col(country).cast("string"), F.lit("")).alias("country"))
    rows = rows.where("id is not null and address is not null").groupBy("id").agg(F.min(F.struct("address", "country")).alias("x")).select("id", "x.address", "x.country")
    rows = materialize(rows, "addresses")
    places = resolve(rows.select("country", "address").distinct())
    out = materialize(rows.join(places, ["country", "address"]).select("id", *PLACE, "unit"), "located")
    discard(rows, places)
    return out


def place_members(df: DataFrame, key: str, address: str, country: str, by_unit: bool = False) -> DataFrame:
    """(key, place, links): each record with the number of its place and of the other records there.

    The short form of ``same_place``: linear in the records, also where very many stand at one place. Records
    whose street type is left out belong to the place of the commonest type, and count as links of every type.
    """
    rows = located(df, key, address, country)
    door = [c for c in PLACE if c != "type"] + (["unit"] if by_unit else [])
    kinds = rows.groupBy(*door, "type").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*door)  # one row for each street type of a door
    total, none = F.sum("n").over(w), F.coalesce(F.max(F.when(F.col("type") == "", F.col("n"))).over(w), F.lit(0))
    main = F.max(F.struct("n", "type")).over(w)["type"]
    main = F.coalesce(F.max(F.when(F.col("type") != "", F.struct("n", "type"))).over(w)["type"], main)
    kinds = kinds.select(*door, "type", F.xxhash64(*door, F.when(F.col("type") == "", main).otherwise(F.col("type"))).alias("place"), (F.when(F.col("type") == "", total).otherwise(F.col("n") + none) - 1).alias("links"))
    return rows.join(kinds, [*door, "type"]).select(F.col("id").alias("key"), "place", "links")


def same_place(df: DataFrame, key: str, address: str, country: str, by_unit: bool = False) -> DataFrame:
    """Pairs of records at one place: (key_a, key_b), key_a < key_b, each pair once.

    A record counts once however often it was delivered. Null, empty and unreadable addresses make no pair, nor
    do addresses without a house number. Null countries are one country of their own. With ``by_unit`` another
    suite or apartment, or one that is left out, makes another place.
    """
    rows = located(df, key, address, country)
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*PLACE[:-1], *(["unit"] if by_unit else []))]
    fits = (F.col("a.type") == F.col("b.type")) | (F.col("a.type") == "") | (F.col("b.type") == "")
    on = fits & (F.col("a.id") < F.col("b.id"))
    for c in same:
        on = on & c
    return a.join(b, on).select(F.col("a.id").alias("key_a"), F.col("b.id").alias("key_b"))
