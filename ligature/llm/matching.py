"""Problem 3: matching entities across sources without keys.

Method: sorted neighbourhood. Records of all sources are brought into one order under each of several
composite keys (place then name; name then place; the name run together, in both orders and backwards; the
name's consonants), and every record is compared with those at most ``window`` places away from it. Records
of a source that read the same take one place together, so copies don't fill a window; readings with equal
words and places are compared however many lie between them. One range-partitioned sort does all passes, and
windows reach over the seams between partitions. A pair's
confidence is a weighted sum of field similarities, put through the logistic function. In the end each pool
record goes to one reference record so that the total confidence is greatest; as a reference record may own
any number of pool records, that is the best reference record of every pool record, its confidence shared by
reference records that fit equally well.

The weights are parameters. The defaults were set by hand and held against the known matches of a sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ligature.functions.indic import has_indic, romanise
from ligature.functions.text import TRADE_NAME
from ligature.llm.gazetteer import resolve
from ligature.llm.names import LEGAL, LINES, LINES_OF_BUSINESS, Lines, damerau, deletions, line_usage, meeting, read_name
from ligature.workspace import discard, materialize, scatter, spread

#: Weights of the field similarities, see ``similarities``; the first is the constant.
WEIGHTS = (-9.0, 11.0, 1.0, 0.5, -5.0, -4.0, 2.5, -1.0, -6.0, 0.0)
NAMES = ("name", "line_same", "line_open", "line_other", "first_other", "place_same", "place_open", "place_other", "place_near")

_FORMER = re.compile(TRADE_NAME, re.I)
#: Pairs at different doors are compared if they have this share of the shorter name's letter pairs in common; 0 compares all.
SHARE = 2 / 3

_WEB = re.compile(r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|net|org|co\.in|in|co|fr|biz|info|us)/?$", re.I)
_VOWELS = re.compile(r"[aeiouyh]+")


def skeleton(word: str) -> str:
    """Consonants as they sound, for words spelled in another script."""
    s = word.replace("tion", "shn").replace("x", "ks").replace("ph", "f").replace("ch", "k").replace("q", "k")
    s = re.sub(r"c(?=[eiy])", "s", s).replace("c", "k")
    s = re.sub(r"g(?=[eiy])", "j", s)
    s = s.translate(str.maketrans("wzjdgb", "vsstkp"))
    return re.sub(r"(.)\1+", r"\1", _VOWELS.sub("", s))


class Spoken:
    """Lines of business and legal forms as they sound; of the lines only those that names of the country hold."""

    def __init__(self, used: dict[str, int]) -> None:
        self.known = {skeleton(w): LINES[w] for w in sorted(LINES_OF_BUSINESS) if LINES[w] in used and len(skeleton(w)) >= 3}
        self.known.update({skeleton(w): "" for w in sorted(LEGAL) if len(w) >= 5})
        self.meeting = meeting(k for k in self.known if len(k) >= 4)
        self.seen: dict[str, str | None] = {}

    def __call__(self, word: str) -> str | None:
        """The line that the word sounds like, "" for a legal form, None for neither."""
        if word not in self.seen:
            if len(self.seen) >= 50_000:
                self.seen.clear()
            s = skeleton(word)
            near = [s] if s in self.known else sorted({k for x in deletions(s) for k in self.meeting.get(x, ()) if damerau(s, k, 1) <= 1}) if len(s) >= 5 else []
            self.seen[word] = self.known[near[0]] if near else None
        return self.seen[word]


class Reader:
    """Like ``read_name``, also for names in Indic scripts, web addresses, handles and former names."""

    def __init__(self, used: dict[str, int] | None = None) -> None:
        self.lines, self.spoken = Lines(used), Spoken(used or {})

    def __call__(self, name: str) -> tuple[list[str], str, str]:
        text = _FORMER.sub("", name.strip())
        if m := _WEB.match(text.strip().strip("#@")):
            text = m[1]
        text = text.lstrip("#@")
        if not has_indic(text):
            return read_name(text, self.lines)
        words, first, line = read_name(romanise(text), self.lines)
        lines, kept = set(line.split()), []
        for w in words:
            spoken = self.spoken(w)
            if spoken is None:
                kept.append(w)
            elif spoken:
                lines.add(spoken)
        return (kept, first, " ".join(sorted(lines))) if kept else (words, first, line)


def read_any(name: str) -> tuple[list[str], str, str]:
    return Reader()(name)


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of edits."""
    return F.when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def similarities() -> dict[str, Column]:
    """Field similarities of columns a_* and b_*, in the order of NAMES."""
    c = F.col
    spelled = [(c("a_sorted"), c("b_sorted")), (c("a_run"), c("b_run")), (c("a_back"), c("b_run"))]
    # of equal names no edits are counted, whichever spelling is equal
    equal = (spelled[0][0] == spelled[0][1]) | (spelled[1][0] == spelled[1][1]) | (spelled[2][0] == spelled[2][1])
    name = F.when(equal, 1.0).otherwise(F.greatest(*[likeness(a, b) for a, b in spelled]))
    both = (c("a_line") != "") & (c("b_line") != "")
    la, lb = F.split("a_line", " "), F.split("b_line", " ")
    same = both & ((c("a_line") == c("b_line")) | (F.size(F.array_except(la, lb)) == 0) | (F.size(F.array_except(lb, la)) == 0))
    fa, fb = c("a_first"), c("b_first")
    first_other = (fa != "") & (fb != "") & (fa != fb) & ~((F.least(F.length(fa), F.length(fb)) == 1) & (F.substring(fa, 1, 1) == F.substring(fb, 1, 1)))
    known = (c("a_number") != "") & (c("b_number") != "")
    door = known & (c("a_number") == c("b_number")) & (c("a_direction") == c("b_direction")) & ((c("a_type") == c("b_type")) | (c("a_type") == "") | (c("b_type") == ""))
    place = door & (c("a_town") == c("b_town")) & (c("a_street") == c("b_street"))
    near = door & ~place & (likeness(c("a_street"), c("b_street")) >= 0.7) & (likeness(c("a_town"), c("b_town")) >= 0.6)
    flags = {"line_same": same, "line_open": ~both, "line_other": both & ~same, "first_other": first_other, "place_same": place, "place_open": ~known, "place_other": known & ~place & ~near, "place_near": near}
    return {"name": F.when((c("a_run") == "") | (c("b_run") == ""), 0.0).otherwise(name), **{k: v.cast("double") for k, v in flags.items()}}


def signature(words: list[str]) -> int:
    """64 bits that the letter pairs of the words, run together, set."""
    text, bits = "".join(sorted(words)), 0
    for i in range(len(text) - 1):
        bits |= 1 << (zlib.crc32(text[i : i + 2].encode()) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


#: The half of a door that stands for the house number.
_NUMBER = (1 << 32) - 1

FIELDS = ["id", "country", "source", "words", "first", "line", "town", "street", "direction", "number", "type", "bits"]
READING = FIELDS[1:]
RECORD = "id string, country string, source int, words array<string>, first string, line string, town string, street string, direction string, number string, type string, bits long"


def _read(usage: dict[str, dict[str, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers: dict[str, Reader] = {}
        for pdf in batches:
            parts = [(readers[c] if c in readers else readers.setdefault(c, Reader(usage.get(c))))(n or "") for n, c in zip(pdf.name, pdf.country, strict=True)]
            out = pdf.assign(words=[p[0] for p in parts], first=[p[1] for p in parts], line=[p[2] for p in parts], bits=[signature(p[0]) for p in parts])
            yield out[FIELDS].fillna({c: "" for c in ("town", "street", "direction", "number", "type")})

    return run


def records(reference: DataFrame, pool: DataFrame, key: str, name: str, address: str, country: str) -> DataFrame:
    """One row per key of both sides, names and addresses read; source is 0 for the reference, 1 for the pool."""
    sides = []
    for n, df in enumerate((reference, pool)):
        rows = df.select(F.col(key).cast("string").alias("id"), F.col(name).alias("name"), F.col(address).alias("address"), F.coalesce(F.col(country).cast("string"), F.lit("")).alias("country"))
        rows = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("name", "address", "country")).alias("x"))
        sides.append(rows.select("id", "x.name", "x.address", "x.country", F.lit(n).alias("source")))
    both = materialize(sides[0].unionByName(sides[1]), "sides")
    places = resolve(both.where("address is not null").select("country", "address").distinct())
    located = both.join(places.drop("unit"), ["country", "address"], "left").drop("address")
    read = scatter(located, "id").mapInPandas(_read(line_usage(both, "name", "country")), RECORD)
    out = materialize(read, "records")
    discard(both, places)
    return out


def distinct_readings(r: DataFrame) -> DataFrame:
    """The readings of records, each once for a source, with their number of records and smallest key."""
    # sorted by a number first: comparing it ends most comparisons
    alike = r.groupBy("bits", *[c for c in READING if c != "bits"]).agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    # numbers stand for the readings while pairs are made; they are fixed by being written
    return materialize(alike.withColumn("row", F.monotonically_increasing_id()), "readings")


def members(r: DataFrame, readings: DataFrame, source: int, name: str) -> DataFrame:
    """(name, id): the numbers of a source's readings, and the keys of their records."""
    on = [c for c in READING if c not in ("source", "bits")]
    numbers = readings.where(F.col("source") == source).select(F.col("row").alias(name), *on)
    return r.where(F.col("source") == source).select("id", *on).join(numbers, on).select(name, "id")


def _passes(r: DataFrame) -> list[tuple[int, Column]]:
    """The keys of a reading: the pass of each, and whether the reading has it."""
    some, placed = F.size("words") > 0, F.col("number") != ""
    return [(1, placed), (2, some), (3, some), (3, some & (F.col("source") == 0) & (F.size("words") > 1)), (4, some), (5, some)]


def key_count(r: DataFrame) -> int:
    """Number of rows of ``sort_keys``, without making the keys."""
    return r.agg(F.sum(sum((has.cast("long") for _, has in _passes(r)), F.lit(0)))).first()[0] or 0


def sort_keys(r: DataFrame) -> DataFrame:
    """Rows (head, key, source, row, bits, door) for all passes; a pass whose fields are empty has no row of the record.

    The head is a number made of the pass, the country's hash and the first five bytes of the key, in the
    order of the key: most comparisons of the sort end with it. The upper half of the door stands for country,
    town and street, the lower one for the house number; 0 is no door.
    """
    words = F.array_join(F.sort_array("words"), " ")
    run, back = F.array_join("words", ""), F.array_join(F.reverse("words"), "")
    place = F.concat_ws("|", "town", "street", "number", "direction")
    # all words at once, as patterns cost less on one text; no word has a blank
    bones = F.regexp_replace(F.translate(F.array_join("words", " "), "aeiouyh", ""), r"([^ ])\1+", "$1")
    bones = F.translate(F.replace(F.array_join(F.sort_array(F.split(bones, " ")), " "), F.lit("ks"), F.lit("x")), "w", "v")
    bar = F.lit("|")
    keys = [F.concat(place, bar, words), F.concat(words, bar, F.col("first"), bar, place), F.concat(run, bar, F.col("first"), bar, place), F.concat(back, bar, F.col("first"), bar, place), F.concat(F.reverse(words), bar, place), F.concat(bones, bar, place)]
    made = F.array(*[F.when(has, F.struct(F.lit(n).alias("pass"), k.alias("key"))) for (n, has), k in zip(_passes(r), keys, strict=True)])
    door = F.when(F.col("number") != "", F.shiftleft(F.hash("country", "town", "street").cast("long"), 32).bitwiseOR(F.hash("number").cast("long").bitwiseAND(F.lit(_NUMBER))))
    out = r.select(F.explode(made).alias("k"), F.pmod(F.xxhash64("country"), F.lit(1 << 16)).alias("land"), "country", "source", "row", "bits", door.alias("door")).where("k is not null")
    begin = F.conv(F.rpad(F.hex(F.substring(F.encode("k.key", "utf-8"), 1, 5)), 10, "0"), 16, 10).cast("long")
    return out.select((F.col("k.pass") * (1 << 56) + F.col("land") * (1 << 40) + begin).alias("head"), F.concat("country", bar, "k.key").alias("key"), "source", "row", "bits", "door")


def _near(bits_a: np.ndarray, bits_b: np.ndarray, door_a: np.ndarray, door_b: np.ndarray, share: float, other_doors: bool = True) -> np.ndarray:
    """Whether two records may match: at one door, or with this share of the letter pairs of the shorter name in common.

    Without ``other_doors`` no two records match whose house numbers are known and differ.
    """
    out = np.ones(len(bits_a), bool)
    if share > 0:
        common = np.bitwise_count(bits_a & bits_b).astype(np.int32)
        least = np.minimum(np.bitwise_count(bits_a), np.bitwise_count(bits_b)).astype(np.int32)
        out = ((door_a == door_b) & (door_a != 0)) | ((least > 0) & (common >= share * least))
    if not other_doors:
        out &= (door_a == 0) | (door_b == 0) | (((door_a ^ door_b) & _NUMBER) == 0)
    return out


def _slide(window: int, share: float, other_doors: bool = True):
    names = ("kind", "reference", "pool", "source", "bits", "door", "part", "at")

    def batch(kind: int, *columns) -> pa.RecordBatch:
        n = len(columns[0])
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.record_batch([pa.array(np.broadcast_to(c, n) if np.ndim(c) == 0 else c, t) for c, t in zip((kind, *columns), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [np.empty(0, np.int64) for _ in range(4)]  # source, row, bits, door
        head: list[list[np.ndarray]] = []
        seen = 0
        for b in batches:
            new = [b.column(i + 1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            if seen < window:
                head.append([c[: window - seen] for c in new])
            seen += len(new[0])
            old = len(held[0])
            source, row, bits, door = rows = [np.concatenate(x) for x in zip(held, new, strict=True)]
            for step in range(1, min(window, len(source) - 1) + 1):
                differ = source[:-step] != source[step:]
                differ[: max(0, old - step)] = False  # both held over from before: compared already
                at = np.flatnonzero(differ)
                at = at[_near(bits[at], bits[at + step], door[at], door[at + step], share, other_doors)]
                first = source[at] == 0
                if len(at):
                    yield batch(0, np.where(first, row[at], row[at + step]), np.where(first, row[at + step], row[at]), 0, 0, 0, part, 0)
            held = [c[-window:] for c in rows]
        if seen:
            # rows at the seams: the first ones of this partition, and the last ones with their distance to its end
            source, row, bits, door = (np.concatenate(x) for x in zip(*head, strict=True))
            yield batch(1, row, row, source, bits, door, part, np.arange(1, len(row) + 1))
            source, row, bits, door = held
            yield batch(2, row, row, source, bits, door, part + 1, np.arange(len(row) - 1, -1, -1))
            one = np.zeros(1, np.int64)
            yield batch(3, one, one + seen, 0, 0, 0, part, 0)

    return run


def neighbours(rows: DataFrame, window: int, share: float = SHARE, part_rows: int = 250_000, other_doors: bool = True, total: int | None = None) -> DataFrame:
    """Distinct (reference, pool) rows that lie at most ``window`` places apart in the order of the keys and may match.

    ``share`` and ``other_doors`` are those of ``_near``; 0 keeps every pair. Partitions of the order hold about
    ``part_rows`` rows; ``total`` is the number of rows, if it is known.
    """
    order = [c for c in ("head", "key", "source", "row") if c in rows.columns]
    total = rows.count() if total is None else total
    # partitions much larger than a window, so that a window meets one seam at most
    parts = int(max(1, min(max(spread(rows.sparkSession), total // part_rows), total // (50 * window))))
    while True:
        ordered = rows.select(*order, "bits", "door").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        ordered = ordered.select("key", "source", "row", "bits", "door")
        made = materialize(ordered.mapInArrow(_slide(window, share, other_doors), "kind int, reference long, pool long, source int, bits long, door long, part int, at int"), "windows")
        full = made.where((F.col("kind") == 3) & (F.col("pool") >= window)).count()
        if parts == 1 or full == parts:
            break
        # the range was cut unevenly: with fewer parts none is narrower than a window
        discard(made)
        parts = max(1, parts // 4)

    def seam(kind: int, tag: str) -> DataFrame:
        return made.where(F.col("kind") == kind).select("part", *[F.col(c).alias(f"{c}_{tag}") for c in ("pool", "source", "bits", "door", "at")])

    c = F.col
    both = seam(2, "x").join(seam(1, "y"), "part").where((c("at_x") + c("at_y") <= window) & (c("source_x") != c("source_y")))
    if share > 0:
        common = F.bit_count(c("bits_x").bitwiseAND(c("bits_y"))) >= share * F.least(F.bit_count("bits_x"), F.bit_count("bits_y"))
        both = both.where(((c("door_x") == c("door_y")) & (c("door_x") != 0)) | (common & (c("bits_x") != 0) & (c("bits_y") != 0)))
    if not other_doors:
        both = both.where((c("door_x") == 0) | (c("door_y") == 0) | (c("door_x").bitwiseXOR(c("door_y")).bitwiseAND(F.lit(_NUMBER)) == 0))
    first = c("source_x") == 0
    both = both.select(F.when(first, c("pool_x")).otherwise(c("pool_y")).alias("reference"), F.when(first, c("pool_y")).otherwise(c("pool_x")).alias("pool"))
    out = materialize(made.where("kind = 0").select("reference", "pool").unionByName(both).distinct(), "pairs")
    discard(made)
    return out


def equal_readings(readings: DataFrame) -> DataFrame:
    """(reference, pool) rows with equal words at one place, or with equal words, first name and line of which one has no place."""
    some = readings.where(F.size("words") > 0).select("source", "row", "country", F.array_join(F.array_sort("words"), " ").alias("words"), "first", "line", "town", "street", "direction", "number")

    def side(source: int, name: str, placed: bool | None) -> DataFrame:
        rows = some.where(F.col("source") == source).withColumnRenamed("row", name).drop("source")
        return rows if placed is None else rows.where((F.col("number") != "") == F.lit(placed))

    def meet(a: bool | None, b: bool | None, on: list[str]) -> DataFrame:
        return side(0, "reference", a).join(side(1, "pool", b), ["country", "words", *on]).select("reference", "pool")

    named = ["first", "line"]
    return meet(True, True, ["town", "street", "direction", "number"]).unionByName(meet(False, None, named)).unionByName(meet(True, False, named))


def most_at_other_doors(weights: tuple[float, ...]) -> float:
    """The highest confidence that records can have whose house numbers are known and differ: all else alike."""
    w = dict(zip(NAMES, weights[1:], strict=True))
    total = weights[0] + max(w["name"], 0) + max(w["line_same"], w["line_open"], w["line_other"]) + max(w["first_other"], 0) + w["place_other"]
    return 1 / (1 + math.exp(min(-total, 700)))


def scored_readings(readings: DataFrame, window: int, weights: tuple[float, ...], share: float = SHARE, least: float = 0.0) -> DataFrame:
    """Compared pairs of readings: (reference, pool, least_id, copies, confidence, NAMES...); id and number of the reference's records.

    Pairs that can't reach the confidence ``least``, whatever their names, may be left out before they are compared.
    """
    other_doors = most_at_other_doors(weights) >= least - 1e-6
    near = neighbours(sort_keys(readings), window, share, other_doors=other_doors, total=key_count(readings))
    pairs = near.unionByName(equal_readings(readings)).distinct()
    words = F.col("words")
    sides = readings.select("source", "row", "id", "copies", "country", "line", "first", "number", "town", "street", "direction", "type", F.array_join(F.array_sort(words), "").alias("sorted"), F.array_join(words, "").alias("run"), F.array_join(F.reverse(words), "").alias("back"))
    cols = [c for c in sides.columns if c not in ("source", "row")]
    a = sides.where("source = 0").select(F.col("row").alias("reference"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = sides.where("source = 1").select(F.col("row").alias("pool"), *[F.col(c).alias(f"b_{c}") for c in cols if c not in ("id", "copies")])
    # what the first join shuffles is gone before the second one begins
    half = materialize(pairs.join(a, "reference"), "half-pairs")
    discard(near)
    wide = half.join(b, "pool").where("a_country = b_country")
    wide = wide.select("reference", "pool", F.col("a_id").alias("least_id"), F.col("a_copies").alias("copies"), *[v.alias(k) for k, v in similarities().items()])
    total = sum((F.col(n) * w for n, w in zip(NAMES, weights[1:], strict=True)), F.lit(weights[0]))
    return wide.withColumn("confidence", 1 / (1 + F.exp(-total)))


def scored_pairs(reference: DataFrame, pool: DataFrame, key: str, name: str, address: str, country: str, window: int = 10, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Compared pairs: (reference, pool, confidence, NAMES...)."""
    r = records(reference, pool, key, name, address, country)
    readings = distinct_readings(r)
    pairs = scored_readings(readings, window, weights, share)
    for source, side in enumerate(("reference", "pool")):
        pairs = pairs.join(members(r, readings, source, side), side).drop(side).withColumnRenamed("id", side)
    return pairs.select("reference", "pool", *NAMES, "confidence")


def match(reference: DataFrame, pool: DataFrame, key: str, name: str, address: str, country: str, window: int = 10, weights: tuple[float, ...] = WEIGHTS, least: float = 0.35, share: float = SHARE) -> DataFrame:
    """(reference, pool, confidence): each pool record with its reference record, if any is confident enough.

    Keys count once however often they were delivered; null keys are left out. Null, empty and placeholder
    addresses leave the place open; null and empty names match nothing. Of reference records with equal
    confidence the smaller key is taken, with the confidence divided by their number; ``least`` holds for the
    confidence before that.
    """
    r = records(reference, pool, key, name, address, country)
    readings = distinct_readings(r)
    pairs = scored_readings(readings, window, weights, share, least).select("pool", "least_id", "copies", F.round("confidence", 9).alias("confidence"))
    w = Window.partitionBy("pool")
    best = pairs.withColumn("top", F.max("confidence").over(w)).where("confidence = top").groupBy("pool").agg(F.min("least_id").alias("reference"), (F.max("confidence") / F.sum("copies")).alias("confidence"), F.max("confidence").alias("undivided"))
    # what the comparison shuffled is gone before the records are looked up
    best = materialize(best.where(F.col("undivided") >= least).drop("undivided"), "best")
    return best.join(members(r, readings, 1, "pool"), "pool").select("reference", F.col("id").alias("pool"), "confidence")


def assign_one_to_one(pairs: DataFrame, step: float = 0.01, least: float = 0.0, rounds: int = 1000) -> DataFrame:
    """(reference, pool, confidence): each record of either side at most once, with the greatest total confidence.

    For sources that hold each entity once. An auction: every pool record without a partner bids for the
    reference record that is worth most to it, the highest bid wins and sets the price, until nobody wants to
    bid. The total is at most ``step`` a pool record below the greatest one. Each round is a few aggregations;
    an auction that isn't over after ``rounds`` raises. Null confidences and those below ``least`` are no pairs;
    of repeated pairs the highest counts.
    """
    pairs = materialize(pairs.where(F.col("confidence") >= least).groupBy("reference", "pool").agg(F.max("confidence").alias("confidence")), "auction-pairs")
    spark = pairs.sparkSession
    owned = spark.createDataFrame([], pairs.select("reference", "pool").schema).withColumn("price", F.lit(0.0))
    for _ in range(rounds):
        idle = pairs.join(owned.select("pool"), "pool", "left_anti").join(owned.select("reference", "price"), "reference", "left")
        worth = idle.select("reference", "pool", (F.col("confidence") - F.coalesce("price", F.lit(0.0))).alias("worth"), F.coalesce("price", F.lit(0.0)).alias("price")).where("worth > 0")
        w = Window.partitionBy("pool").orderBy(F.desc("worth"), "reference")
        best = worth.withColumn("next", F.lead("worth", 1, 0.0).over(w)).withColumn("place", F.row_number().over(w)).where("place = 1")
        bids = best.select("reference", "pool", (F.col("price") + F.col("worth") - F.greatest("next", F.lit(0.0)) + step).alias("price"))
        won = bids.groupBy("reference").agg(F.max(F.struct("price", "pool")).alias("x")).select("reference", "x.pool", "x.price")
        won = materialize(won, "auction-bids")
        if won.isEmpty():
            return pairs.join(owned.select("reference", "pool"), ["reference", "pool"])
        before, owned = owned, materialize(owned.join(won, "reference", "left_anti").unionByName(won), "auction")
        discard(won, *([before] if hasattr(before, "_ligature_path") else []))
    raise RuntimeError(f"the auction isn't over after {rounds} rounds")
