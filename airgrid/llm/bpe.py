"""Byte-level BPE encoding by overlapping chunks, and decoding.

Texts longer than a chunk are cut into chunks that overlap, which are pre-tokenised in parallel,
each from its own start, wherever that lies in a word.  The pattern never looks back: what follows
a boundary depends on the text after it alone.  So where two neighbours have a boundary in common
in their overlap, both go on alike, and the text is cut there.  The pieces between cuts are then
encoded in parallel, as are shorter texts, and put together in order.

Where neighbours have no boundary in common (a word longer than the overlap), nothing proves that
the later chunks are in step: the rest of that text, from the last proven cut on, is one piece.

Boundaries near a chunk's end are not used, as the pattern looks a few characters ahead.  Letters and
digits are told by the encoding library's own tables, so that both see the same words.

Decoding joins the raw bytes of the ids' tokens; they need not be valid UTF-8 in between.

Defined cases: a null or empty text has no ids and decodes to no bytes; names of special tokens are
ordinary text; repeated rows give repeated results; null ids are kept; ids without a token are an
error; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import fresh, stored
from .tokencount import vocabulary

#: Characters of a chunk, without the overlap.
CHUNK = 16_384
#: Characters that a chunk has in common with the next.
OVERLAP = 1_024
#: More characters than the pattern looks ahead.
AHEAD = 8


_IDS = pa.list_(pa.int32())


@lru_cache(maxsize=1)
def _tokens(path: str) -> list[bytes | None]:
    """The bytes of each id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


@lru_cache(maxsize=1)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(_tokens(path)) if t is not None}, special_tokens={})


class Classes(dict):
    """What stands for a character when words are told apart: ASCII and blanks for themselves, one letter and one digit for all others, and a sign for the rest.

    The classes are those of the encoding library: a pattern of one class encodes a character of it, and drops any other.
    """

    LETTER, DIGIT, SIGN = "é", "²", "§"

    def __init__(self):
        import tiktoken

        one = {bytes([i]): i for i in range(256)}
        self.of = [(tiktoken.Encoding(p, pat_str=p, mergeable_ranks=one, special_tokens={}), c) for p, c in ((r"\p{L}", self.LETTER), (r"\p{N}", self.DIGIT), (r"\s", None))]

    def __missing__(self, code: int):
        char = chr(code)
        if code < 128:
            found: str | None = char
        else:
            found = next(((c or char) for e, c in self.of if e.encode_ordinary(char)), self.SIGN)
        self[code] = found
        return found


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN), Classes()


def boundaries(text: str) -> np.ndarray:
    """Where the pre-tokens of ``text`` end, in characters."""
    pattern, classes = _pattern()
    return np.array([m.end() for m in pattern.finditer(text if text.isascii() else text.translate(classes))], np.int64)


def cut_texts(docs: DataFrame, row: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """row, doc_id, k, n (chunks of the text), text: chunks with their overlaps."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("k", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())])

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                parts = [text[a : a + chunk + overlap] for a in range(0, len(text), chunk)]
                n = len(parts)
                for a in range(0, n, 64):
                    some = parts[a : a + 64]
                    at = pa.array(np.full(len(some), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.arange(a, a + len(some), dtype=np.int32)), pa.array(np.full(len(some), n, np.int32)), pa.array(some, pa.string())], names=schema.names)

    return docs.select(row, "doc_id", "text").mapInArrow(work, schema)


def pretokenised(chunks: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Chunks with head and tail: the boundaries in what they share with the chunk before and after, counted from where that starts."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("head", T.ArrayType(T.IntegerType())), T.StructField("tail", T.ArrayType(T.IntegerType()))])

    def work(batches):
        for batch in batches:
            head, tail = [], []
            for k, n, text in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "text")), strict=True):
                ends = boundaries(text)
                ends = ends[ends <= (len(text) if k == n - 1 else len(text) - AHEAD)]
                head.append(np.concatenate([[0], ends[ends <= overlap]]).astype(np.int32))
                tail.append((ends[ends >= chunk] - chunk).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, _IDS), pa.array(tail, _IDS)], names=schema.names)

    return chunks.mapInArrow(work, schema)


def stitched(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, k, text: the pieces of stored ``chunks``, each of which starts and ends at a boundary of the whole text."""
    of_row = Window.partitionBy("row").orderBy("k")
    cuts = chunks.select("row", "k", "n", "head", "tail").withColumn("cut", F.array_min(F.array_intersect("tail", F.lead("head").over(of_row)))).drop("head", "tail")
    lost = F.min(F.when(F.col("cut").isNull(), F.col("k"))).over(Window.partitionBy("row"))  # the last chunk at the latest
    spans = cuts.withColumn("lost", lost).select(
        "row",
        "k",
        "lost",
        F.when(F.col("k") <= F.col("lost"), F.coalesce(F.lag("cut").over(of_row), F.lit(0))).otherwise(0).alias("from"),
        F.when(F.col("k") < F.col("lost"), chunk + F.col("cut")).when(F.col("k") < F.col("n") - 1, chunk).alias("to"),
    )
    text = F.expr("substring(text, from + 1, coalesce(to, length(text)) - from)")
    parts = chunks.select("row", "doc_id", "k", "text").join(spans, ["row", "k"]).select("row", "doc_id", "k", "lost", text.alias("text"))
    rest = parts.where("k >= lost").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.min("k").alias("k"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("all"))
    return parts.where("k < lost").drop("lost").unionByName(rest.select("row", "doc_id", "k", F.array_join(F.transform("all", lambda x: x["text"]), "").alias("text")))


def _encoded(pieces: DataFrame, path: str, ids: str) -> DataFrame:
    """``pieces`` with their last column, a text, replaced by the ids of it."""
    schema = T.StructType([*pieces.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def work(batches) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for a, b in W.row_slices(text):
                found = [one.encode_to_numpy(t or "", disallowed_special=()) for t in text.slice(a, b - a).to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = pa.array(np.concatenate(found).view(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.ListArray.from_arrays(pa.array(off), flat)], names=schema.names)

    return pieces.mapInArrow(work, schema)


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""
    if not AHEAD < overlap <= chunk:
        raise ValueError("an overlap is longer than the pattern looks ahead, and no longer than a chunk")
    path = path or vocabulary()
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = _encoded(docs.where(~long).select("doc_id", "text"), path, "ids")
    row = fresh(docs.columns, "row")
    chunks = cut_texts(docs.where(long).withColumn(row, F.monotonically_increasing_id()), row, chunk, overlap)
    # chunks of one long text go to many tasks
    ready = stored(pretokenised(chunks.repartition("row", "k"), chunk, overlap), "pretokens")
    pieces = _encoded(stitched(ready, chunk), path, "ids")
    whole = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("all"))
    return short.unionByName(whole.select("doc_id", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids")))


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", column: str = "bytes") -> DataFrame:
    """``encoded`` with a binary column more: the bytes of its ids."""
    path = path or vocabulary()
    schema = T.StructType([*encoded.schema.fields, T.StructField(column, T.BinaryType())])

    def work(batches):
        token = _tokens(path).__getitem__
        for batch in batches:
            lists = batch.column(schema.names.index(ids))
            for a in range(0, batch.num_rows, 1_000):
                part = lists.slice(a, 1_000)
                ids_, ends = part.flatten().to_numpy().tolist(), np.cumsum(part.value_lengths().fill_null(0).to_numpy()).tolist()
                found = pa.array([b"".join(map(token, ids_[x:y])) for x, y in zip([0, *ends], ends, strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 1_000) for c in batch.columns), found], names=schema.names)

    return encoded.mapInArrow(work, schema)


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by a blank), decoded_sha256."""
    both = decode(encode(docs, **options), options.get("path"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))
