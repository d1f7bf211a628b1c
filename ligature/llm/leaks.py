"""Problem 8: evaluation texts that stand in a training corpus.

Method: winnowing. Both sides are reduced to their letters and digits, so that typesetting, accents, case,
punctuation, hyphenation and line ends make no difference. Of every window of ``w`` consecutive k-gram hashes
the smallest is kept; then any two texts that share a span of ``w + k - 1`` characters share a kept hash. That
span is set to the shortest run of ``words`` words in the evaluation items, so no shared run can be missed.
Fingerprints of corpus and items are joined, and each hit is extended to both sides and accepted if it covers
``words`` whole words of the item.

Corpus fingerprints that no item can have are dropped in the task that makes them, by a bitmap of fixed size
over the items' fingerprints; documents without a hit leave the job there, and texts are read once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ligature.workspace import materialize

# Commands whose argument is no text, and letters that commands stand for.
_NO_TEXT = "cite[a-zA-Z]*|nocite|ref|eqref|autoref|cref|Cref|pageref|label|tag|index|input|include|includegraphics|bibitem|bibliography|bibliographystyle|url|hspace|vspace|textcolor|color|fontsize|href|begin|end|foreignlanguage|selectlanguage|hyperref|hypertarget|setlength"
_LETTERS = {"ss": "ss", "ae": "ae", "oe": "oe", "AE": "AE", "OE": "OE", "aa": "a", "AA": "A", "o": "o", "O": "O", "l": "l", "L": "L", "i": "i", "j": "j"}
_MARKUP = re.compile(
    r"\\(?:" + _NO_TEXT + r")\*?[ \t]*(?:\[[^\]\n]*\])*(?:\{[^{}]*\})?"  # 0
    r"""|\\(?:["'`^~=.][ \t]*|[cvukHrbdt](?=\{|[ \t]+[A-Za-z]\b|[ \t]*\\[ij]\b)[ \t]*)(?:\{[ \t]*\\?([A-Za-z]?)[ \t]*\}|\\([ij])(?![A-Za-z])[ \t]?|([A-Za-z]))"""  # 1 2 3
    r"|\\(ss|ae|oe|AE|OE|aa|AA|o|O|l|L|i|j)(?![A-Za-z])(?:\{\}|[ \t]+)?"  # 4
    r"|(\\-|\\/)"  # 5
    r"|\\[A-Za-z]+\*?"
)


def _letters(m: re.Match) -> str:
    accent = m[1] or m[2] or m[3]
    if accent:
        return accent
    if m[4]:
        return _LETTERS[m[4]]
    return "" if m[5] else " "


def plain(text: str) -> str:
    """Text without commands and accents, in lower case; comments stay."""
    if "\\" in text:
        text = _MARKUP.sub(_letters, text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    return text.lower()


_COMMENT = re.compile(r"(?<!\\)%[^\n]*")


def readings(text: str) -> list[str]:
    """A text with its comments' words and, if it has comments, once more without them.

    A passage may stand in a comment, and a comment may stand in a passage.
    """
    whole = plain(text)
    if "%" not in text:
        return [whole]
    bare = _COMMENT.sub(" ", text)
    return [whole] if len(bare) == len(text) else [whole, plain(bare)]


_DROP, _WORD, _GAP = 0, 1, 2


@lru_cache(1)
def _classes() -> np.ndarray:
    """Of every code point: nothing (marks, soft hyphen, zero width), letter or digit, or a break."""
    out = np.full(0x110000, _GAP, np.uint8)
    for o in range(0x110000):
        c = unicodedata.category(chr(o))
        if c[0] in "LN":
            out[o] = _WORD
        elif c in ("Mn", "Mc", "Me", "Cf"):
            out[o] = _DROP
    return out


def reduce(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits of all texts in a row, where words may start, and each text's start (and the end)."""
    points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[points]
    at = np.flatnonzero(kind != _DROP)
    word = kind[at] == _WORD
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    kept = at[word]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    return points[kept], begins[word], np.searchsorted(kept, bounds)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters from every position on, built by doubling."""
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, size = 0x100000001B3, 1
    power = points.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(1)  # hash of the ``size`` characters from here
    have, done = None, 0  # hash of the ``done`` characters from here
    while True:
        if k & size:
            have = power[:n] if have is None else have * np.uint64(pow(base, size, 1 << 64)) + power[done : done + n]
            done += size
        if size * 2 > k:
            return _mix(have)
        power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every w consecutive values."""
    size, y = 1, x
    while size * 2 <= w:
        y = pick(y[: len(y) - size], y[size:])
        size *= 2
    rest = w - size
    return pick(y[: len(y) - rest], y[rest:]) if rest else y


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the hashes that are the smallest of a window of w; fewer than w hashes are one window."""
    if not len(h):
        return np.empty(0, np.int64)
    w = min(w, len(h))
    least = _sliding(h, w, np.minimum)
    end = np.zeros(w - 1, h.dtype)
    # h[i] is kept if it is the minimum of one of the windows that hold it, and these minima never exceed it
    return np.flatnonzero(_sliding(np.concatenate([end, least, end]), w, np.maximum) == h)


def item_words(text: str) -> list[str]:
    """Words of an item as white space separates them, reduced to letters and digits; others are no words."""
    out = []
    for word in plain(text).split():
        kept = "".join(c for c in word if _classes()[ord(c)] == _WORD)
        if kept:
            out.append(kept)
    return out


def _items(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, streams, starts, least = [], [], [], []
        for key, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            w = item_words(text or "")
            if len(w) >= words:
                at = np.concatenate([[0], np.cumsum([len(x) for x in w])])
                keys.append(key.as_py())
                streams.append("".join(w))
                starts.append(at.tolist())
                least.append(int((at[words:] - at[:-words]).min()))
        yield pa.record_batch([pa.array(keys, b.column(0).type), pa.array(streams, pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(least, pa.int64())], ["item", "stream", "starts", "least"])


def _item_prints(k: int, w: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, prints, places = [], [], []
        for key, stream in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            h = hashes(np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32), k)
            at = winnow(h, w)
            keys += [key] * len(at)
            prints.append(h[at].view(np.int64))
            places.append(at)
        yield pa.record_batch([pa.array(keys, b.column(0).type), pa.array(np.concatenate(prints) if prints else [], pa.int64()), pa.array(np.concatenate(places) if places else [], pa.int64())], ["item", "print", "at"])


def _corpus_prints(k: int, w: int, bits: int, bitmap, block_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = np.frombuffer(bitmap.value, np.uint8)
    names = ["doc", "stream", "breaks", "prints", "places"]

    def work(keys: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
        points, begins, bounds = reduce(texts)
        h = hashes(points, k)
        # each text for itself: a window across a seam would mix two texts
        at = np.concatenate([winnow(h[bounds[i] : max(bounds[i], bounds[i + 1] - k + 1)], w) + bounds[i] for i in range(len(texts))])
        slot = (h[at] >> np.uint64(64 - bits)).astype(np.int64)
        at = at[(marks[slot >> 3] >> (slot & 7)) & 1 == 1]
        doc = np.searchsorted(bounds, at, "right") - 1
        rows = [[], [], [], [], []]
        for d in np.unique(doc):
            own = at[doc == d]
            lo, hi = bounds[d], bounds[d + 1]
            rows[0].append(keys[d])
            rows[1].append(points[lo:hi].tobytes().decode("utf-32-le", "surrogatepass"))
            rows[2].append(np.packbits(begins[lo:hi]).tobytes())
            rows[3].append(h[own].view(np.int64))
            rows[4].append(own - lo)
        return pa.record_batch([pa.array(rows[0], kind), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.list_(pa.int64()))], names)

    for b in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            if text:
                for reading in readings(text):
                    keys.append(key)
                    texts.append(reading)
                    size += len(reading)
            if size >= block_chars:
                yield work(keys, texts, b.column(0).type)
                keys, texts, size = [], [], 0
        if keys:
            yield work(keys, texts, b.column(0).type)


def _common(a: str, i: int, b: str, j: int, step: int) -> int:
    """How many characters agree from a[i], b[j] on, forwards (step 1) or backwards (-1)."""
    n = 0
    limit = min(len(a) - i, len(b) - j) if step > 0 else min(i, j) + 1
    while n < limit and a[i + step * n] == b[j + step * n]:
        n += 1
    return n


def shares_run(stream: str, breaks: np.ndarray, item: str, starts: np.ndarray, at: int, item_at: int, words: int) -> bool:
    """Whether the hit at stream[at], item[item_at] lies in ``words`` whole words of the item."""
    left = _common(stream, at - 1, item, item_at - 1, -1) if at and item_at else 0
    right = _common(stream, at, item, item_at, 1)
    lo, hi = item_at - left, item_at + right
    first, last = int(np.searchsorted(starts, lo)), int(np.searchsorted(starts, hi, "right")) - 1
    shift = at - item_at
    ends = lambda x: x == len(stream) or bool(breaks[x])
    # the run must begin where a word of the document begins and end where one ends
    good = [x for x in range(first, last + 1) if ends(int(starts[x]) + shift)]
    return bool(good) and good[-1] - good[0] >= words


def _extend(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, items = [], []
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        for r in range(b.num_rows):
            stream = c["stream"][r].as_py()
            breaks = np.unpackbits(np.frombuffer(c["breaks"][r].as_py(), np.uint8))[: len(stream)]
            found = set()
            for hit in c["hits"][r].as_py():
                if hit["item"] not in found and shares_run(stream, breaks, hit["item_stream"], np.asarray(hit["starts"]), hit["at"], hit["item_at"], words):
                    found.add(hit["item"])
            docs += [c["doc"][r].as_py()] * len(found)
            items += sorted(found)
        yield pa.record_batch([pa.array(items, pa.int64()), pa.array(docs, pa.int64())], ["item", "doc"])


def leaked(corpus: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, words: int = 12, bits: int = 26, block_chars: int = 1_000_000) -> DataFrame:
    """Which items stand, with ``words`` consecutive words or more, in which documents: (item, doc) columns.

    Null and empty texts hold nothing; items of fewer words are found nowhere. Repeated rows change nothing.
    The keys must be integers. Other columns are not read.
    """
    spark = corpus.sparkSession
    long = LongType()
    queries = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null").distinct()
    queries = queries.mapInArrow(lambda b: _items(words, b), StructType([StructField("item", long), StructField("stream", StringType()), StructField("starts", ArrayType(long)), StructField("least", long)]))
    queries = materialize(queries, "eval-items")
    span = queries.agg(F.min("least")).first()[0]
    if span is None:
        return spark.createDataFrame([], StructType([StructField(item, long), StructField(doc, long)]))
    k = max(1, min(32, 2 * span // 3))
    w = span - k + 1
    prints = materialize(queries.select("item", "stream").mapInArrow(lambda b: _item_prints(k, w, b), "item long, print long, at long"), "eval-prints")
    slots = prints.select(F.shiftrightunsigned("print", 64 - bits).alias("slot")).distinct()
    marks = np.zeros((1 << bits) // 8, np.uint8)  # at most 2**bits slots, whatever the number of items
    for part in slots.toLocalIterator():
        marks[part.slot >> 3] |= 1 << (part.slot & 7)
    bitmap = spark.sparkContext.broadcast(marks.tobytes())
    docs = corpus.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("t")).where("doc is not null and t is not null")
    schema = StructType([StructField("doc", long), StructField("stream", StringType()), StructField("breaks", BinaryType()), StructField("prints", ArrayType(long)), StructField("places", ArrayType(long))])
    hit_docs = materialize(docs.mapInArrow(lambda b: _corpus_prints(k, w, bits, bitmap, block_chars, b), schema).withColumn("row", F.expr("uuid()")), "hit-documents")
    places = hit_docs.select("row", F.explode(F.arrays_zip("prints", "places")).alias("x")).select("row", F.col("x.prints").alias("print"), F.col("x.places").alias("at"))
    hits = places.join(prints.select("print", "item", F.col("at").alias("item_at")), "print")
    hits = hits.join(queries.select("item", F.col("stream").alias("item_stream"), "starts"), "item")
    per_doc = hits.groupBy("row").agg(F.collect_list(F.struct("item", "at", "item_at", "item_stream", "starts")).alias("hits"))
    whole = hit_docs.select("row", "doc", "stream", "breaks").join(per_doc, "row").select("doc", "stream", "breaks", "hits")
    found = whole.mapInArrow(lambda b: _extend(words, b), "item long, doc long")
    return found.distinct().select(F.col("item").alias(item), F.col("doc").alias(doc))

