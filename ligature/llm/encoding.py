"""Problem 7: encoding of a corpus with a public byte-level BPE tokenizer.

Method: a table of distinct words. Texts are cut into the words of the tokenizer's own splitting rule, each
distinct word is encoded once, and its ids are joined back by position. Merging is by far the dearest part of
BPE, and the number of distinct words grows much slower than the corpus.

To join back without one row per occurrence, documents are read in blocks of about ``block_chars``
characters. A block is one row of a written table: its documents' keys and word counts, its distinct words,
and the sequence of words as positions in that list. Only (block, word) pairs take part in the join with the
encoded words; a block's ids come back in the order of its list and are spread over the sequence by
vectorised gathers. No block depends on another, so nothing larger than a block is ever in one task.

Decoding is a join of ids with the vocabulary's pieces, whose size the vocabulary file bounds.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from ligature.workspace import materialize

VOCABULARY = os.environ.get("LIGATURE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
# Code points with the property White_Space.
_BLANKS = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of every code point: letter, number, white space or other."""
    out = np.zeros(0x110000, np.uint8)
    for o in range(0x110000):
        c = unicodedata.category(chr(o))[0]
        if c == "L":
            out[o] = _LETTER
        elif c == "N":
            out[o] = _NUMBER
    out[_BLANKS] = _SPACE
    return out


def split_words(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start positions of all words in the code points of concatenated documents.

    The rule, tried in this order at every position: an apostrophe with s, t, re, ve, m, ll or d; a run of
    letters, of numbers or of other characters, each with one blank before it; white space up to the one
    character before a following word; white space. It leaves no character out.
    """
    n = len(points)
    kind = _kinds()[points]
    doc = np.zeros(n + 1, bool)
    doc[doc_starts] = True
    doc[n] = True
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = kind[1:] != kind[:-1]
    run |= doc[:n]
    starts = run.copy()
    space = kind == _SPACE
    # the last blank of a run before a word: a plain blank belongs to the word, another one stands alone
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~doc[1:n])
    starts[last] = True
    plain = last[points[last] == 32]
    starts[plain + 1] = False
    # contractions: a lone apostrophe that starts a word, and the letters it takes along
    lone = np.flatnonzero((points == 39) & starts)
    lone = lone[(lone + 1 < n)]
    lone = lone[~doc[lone + 1] & (kind[lone + 1] == _LETTER)]
    if len(lone):
        a = points[lone + 1]
        b = np.where((lone + 2 < n) & ~doc[np.minimum(lone + 2, n)], points[np.minimum(lone + 2, n - 1)], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = np.zeros(len(lone), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        for hit, k in ((one, 1), (two & ~one, 2)):
            at = lone[hit]
            starts[at + 1] = False
            end = at + 1 + k
            end = end[end < n]
            starts[end] = True
    return np.flatnonzero(starts)


def _block(keys: pa.Array, texts: pa.Array, name: str) -> pa.RecordBatch:
    """One row: keys, words per document, distinct words and the sequence of their positions."""
    filled = texts.fill_null("") if texts.null_count else texts
    data = "".join(filled.to_pylist()).encode("utf-8", "surrogatepass")
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.asarray(pa.compute.utf8_length(filled).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(chars)
    if len(points):
        begins = np.unique((ends - chars)[chars > 0])
        starts = split_words(points, begins)
        width = np.ones(len(points), np.int64)
        width += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate([[0], np.cumsum(width)])
        offsets = np.append(byte_at[starts], byte_at[-1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).dictionary_encode()
        distinct, codes = words.dictionary, words.indices.to_numpy()
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    else:
        distinct, codes, counts = pa.array([], pa.string()), np.empty(0, np.int32), np.zeros(len(keys), np.int64)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.record_batch(
        [pa.array([name]), one(keys), one(pa.array(counts, pa.int32())), one(distinct), pa.array([codes.astype(np.int32).tobytes()], pa.binary())],
        ["block", "keys", "counts", "words", "codes"],
    )


def _blocks(block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(keys):
                before = size[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(size, before + block_chars, "right")))
                yield _block(keys.slice(at, end - at), texts.slice(at, end - at), uuid.uuid4().hex)
                at = end

    return run


def ranks(path: str) -> dict[bytes, int]:
    """Pieces and ids of a vocabulary file in rank form."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)._encode_single_piece
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([encode(w.encode("utf-8", "surrogatepass")) for w in words], pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            keys, counts = batch.column(0)[r].values, batch.column(1)[r].values.to_numpy(zero_copy_only=False)
            codes = np.frombuffer(batch.column(2)[r].as_py(), np.int32)
            table = batch.column(3)[r].values
            if table is None or not len(codes):
                flat, per_word = np.empty(0, np.int32), np.empty(0, np.int64)
            else:
                lists = table.field(1)
                offsets = lists.offsets.to_numpy()
                sizes = np.diff(offsets).astype(np.int64)
                values = lists.values.to_numpy()
                per_word = sizes[codes]
                to = np.cumsum(per_word)
                flat = values[np.repeat(offsets[:-1].astype(np.int64)[codes] - (to - per_word), per_word) + np.arange(to[-1])]
            ends = np.concatenate([[0], np.cumsum(per_word)])[np.concatenate([[0], np.cumsum(counts)])]
            yield pa.record_batch([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["key", "ids"])


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, block_chars: int = 4_000_000) -> DataFrame:
    """Token ids of every row's text, without special tokens: (key, ids).

    One row for every row of ``df``, also for repeated keys. The list is empty for null and for empty texts.
    Strings that look like special tokens are ordinary text. A text longer than ``block_chars`` is a block of
    its own. Other columns are not read.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = StructType([
        StructField("block", StringType()), StructField("keys", ArrayType(rows.schema["key"].dataType)), StructField("counts", ArrayType(IntegerType())),
        StructField("words", ArrayType(StringType())), StructField("codes", BinaryType()),
    ])
    blocks = materialize(rows.mapInArrow(_blocks(block_chars), schema), "word-blocks")
    distinct = blocks.select(F.explode("words").alias("word")).distinct()
    encoded = distinct.mapInArrow(_encode_words(vocabulary), "word string, ids array<int>")
    positions = blocks.select("block", F.posexplode("words").alias("at", "word"))
    found = positions.join(encoded, "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("entries"))
    whole = blocks.select("block", "keys", "counts", "codes").join(found, "block", "left").select("keys", "counts", "codes", "entries")
    out = whole.mapInArrow(_expand, StructType([StructField("key", rows.schema["key"].dataType), StructField("ids", ArrayType(IntegerType()))]))
    return out.select(F.col("key").alias(key), F.col("ids").alias("ids"))


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of id lists: (key, text); keys must be unique. Empty and null lists give "".

    Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary are left out.
    """
    spark = df.sparkSession
    pieces = spark.createDataFrame([(i, bytearray(p)) for p, i in ranks(vocabulary).items()], "id int, piece binary")
    places = df.select(F.col(key).alias("key"), F.posexplode_outer(ids).alias("at", "id"))
    # one row for each piece of the vocabulary, whatever the corpus
    joined = places.join(F.broadcast(pieces), "id", "left")
    whole = joined.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8")
    return whole.select(F.col("key").alias(key), F.coalesce(text, F.lit("")).alias("text"))
