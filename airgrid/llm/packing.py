"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most one sequence; pieces are then dealt
evenly into groups of at most about ``GROUP_ROWS`` rows (their lengths only, not
their tokens), and each group fills its sequences one by one: the longest piece
left is taken, and a bitset subset-sum over the lengths left finds the fullest
combination beside it, which is then removed.  Full pieces are sequences by
themselves.  Each group leaves at most a few sequences with slack, so the groups
cost next to nothing against one large group, and any number of them run at once.

Defined cases: a null or empty text is one piece that holds the end token only;
a very long text is cut into as many pieces as it needs; pieces of equal length are
taken in the order in which they came to the task; repeated rows are packed as often as
they stand there; null ids are kept; other columns are not read; an empty table gives no
sequences.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import stored

SEQUENCE_TOKENS = 4096
END_TOKEN = 1
#: Pieces that one task packs.
GROUP_ROWS = 100_000
#: Chunks of text whose ids a Python worker keeps.
CACHE_CHUNKS = 250_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkIds(dict):
    """Ids (little-endian, unsigned, 32 bits) of chunks without ASCII white space, in lower case, where the machine's own order of bytes is little-endian.

    The tokenizer drops white space and lower-cases, so a text's ids are those of its chunks in
    order.  A chunk that ends with a full stop or comma after a letter is the two parts' ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        # a Latin letter (but for the dotted capital I) stays one letter in lower case and in any normal form
        if text[-1] in ".," and text[-2:-1].isalpha() and text[-2] < "\u0250" and text[-2] != "\u0130":
            return self[text[:-1].encode()] + self[text[-1].encode()]
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) < CACHE_CHUNKS and len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def text(self, data: bytes) -> bytes:
        if b"<|" in data:  # a special token's name is told by its exact letters
            return array("I", self.tokenizer.encode(data.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, data.lower().split()))

    def column(self, text: pa.Array):
        """Ids of each text in turn.  A stop or comma between an ASCII letter and white space is set apart first, which leaves the ids as they are."""
        for a, b in W.row_slices(text):
            part = text.slice(a, b - a)
            data, off = W.column_bytes(part)
            mark = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1 if len(data) > 2 else np.zeros(0, np.int64)
            mark = mark[(_LETTER[data[mark - 1]]) & (_SPACE[data[mark + 1]])]
            whole = np.insert(data, mark, 32).tobytes()
            off = (off + np.searchsorted(mark, off)).tolist()
            for x, y in zip(off[:-1], off[1:], strict=True):
                yield self.text(whole[x:y])


_LETTER, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_kept: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One cache for each Python worker; later tasks find it filled."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = ChunkIds(path)
    return _kept[path]


def pieces(docs: DataFrame, path: str, tokens: int = SEQUENCE_TOKENS, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, 32 bits each)."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), *([("ids", T.BinaryType())] if keep_ids else [])))])
    end = np.array([END_TOKEN], "<u4").tobytes()

    def work(batches):
        ids_of = chunk_ids(path)
        step = 4 * tokens
        for batch in batches:
            row: list[int] = []
            out: list[list] = [[] for _ in range(5 if keep_ids else 4)]
            for i, ids in enumerate(ids_of.column(batch.column(1))):
                ids += end
                for k, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    row.append(i)
                    for column, value in zip(out, (k, a >> 2, len(part) >> 2, zlib.crc32(part), part), strict=False):
                        column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 if keep_ids else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, k) for x, k in zip(out, kinds, strict=False))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def minimum_slack(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each of the lengths (1 to ``room`` each)."""
    bin_of, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    heads = np.searchsorted(lengths[order], np.arange(room + 2))
    left = np.diff(heads).tolist()  # pieces left of each length
    avail = sum(1 << n for n in range(1, room + 1) if left[n])
    n_bins = 0
    while avail:
        longest = avail.bit_length() - 1
        left[longest] -= 1
        chosen = [(longest, left[longest])]
        if not left[longest]:
            avail ^= 1 << longest
        want = room - longest
        reach, steps = 1, []
        mask = (1 << (want + 1)) - 1
        rest = avail & mask
        while rest and not reach >> want & 1:
            n = rest.bit_length() - 1
            rest ^= 1 << n
            for _ in range(min(left[n], want // n)):
                more = (reach | reach << n) & mask
                if more == reach:
                    break
                steps.append((n, reach))
                reach = more
                if reach >> want & 1:
                    break
        target = reach.bit_length() - 1
        for n, before in reversed(steps):
            if not before >> target & 1:
                target -= n
                left[n] -= 1
                chosen.append((n, left[n]))
                if not left[n]:
                    avail ^= 1 << n
        place = 0
        for n, k in chosen:
            i = order[heads[n] + k]
            bin_of[i], at[i] = n_bins, place
            place += n
        n_bins += 1
    return bin_of, at


def pack(found: DataFrame, tokens: int = SEQUENCE_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``found`` (with a column length) with sequence_id and offset added."""
    groups = max(1, math.ceil(found.count() / group_rows))
    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def work(batches):
        group = TaskContext.get().partitionId()
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        whole = pa.Table.from_batches(got)
        bin_of, at = minimum_slack(whole.column("length").to_numpy(), tokens)
        whole = whole.append_column("sequence_id", pa.array((group << 32) + bin_of)).append_column("offset", pa.array(at))
        yield from whole.to_batches()

    return found.repartition(groups).mapInArrow(work, schema)


def pack_documents(docs: DataFrame, path: str | None = None, tokens: int = SEQUENCE_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(stored(pieces(docs, path or vocabulary(), tokens), "pieces"), tokens, group_rows)


def sequences(docs: DataFrame, path: str | None = None, tokens: int = SEQUENCE_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary) and the documents in them; a row has at most ``tokens`` ids."""
    packed = pack(stored(pieces(docs, path or vocabulary(), tokens, keep_ids=True), "pieces"), tokens, group_rows)

    def join(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [b"".join(rows.ids)], "doc_ids": [rows.doc_id.tolist()]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return packed.groupBy("sequence_id").applyInPandas(join, f"sequence_id long, ids binary, doc_ids array<{kind}>")
