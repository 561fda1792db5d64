"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole; a byte-level vocabulary's tokens tile its bytes, so the
running sum of their lengths is where each token starts and ends.  Sections are spans of the
text (its lines); tokens are joined with them by
interval.  A token that crosses a boundary counts, by the rule given,

* ``start``: for the section its first byte is in,
* ``most``: for the section with most of its bytes, the first of equals.

Line breaks are a section's tail: they belong to the section before
them, or to the first one.  So the sections' counts sum to the document's.

Defined cases: a null or empty text has one section without tokens; of sections with equally much
of a token the first gets it (``most``); a very long text is encoded whole; repeated rows give
repeated results; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as W

RULES = ("start", "most")
#: Between sections: a line break, and all white space after it.
BREAK = rb"\n[ \t\r\n]*"


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def encoding(path: str):
    """The encoder, and each token's length in bytes."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        length[i] = len(token)
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def section_bounds(data: bytes) -> np.ndarray:
    """Starts of the sections, the first at 0, and the end of the text."""
    cut = [m.end() for m in re.finditer(BREAK, data) if 0 < m.start() and m.end() < len(data)]
    return np.array([0, *cut, len(data)], np.int64)


def attributed(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; ``ends``: where each token ends, in bytes."""
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    inner = bounds[1:-1]
    first = np.searchsorted(inner, starts, "right")
    if rule == "start":
        at = first
    else:
        last = np.searchsorted(inner, ends, "left")
        at = first.copy()
        for i in np.flatnonzero(last > first):  # the few that cross
            share = [min(ends[i], bounds[k + 1]) - max(starts[i], bounds[k]) for k in range(first[i], last[i] + 1)]
            at[i] = first[i] + int(np.argmax(share))
    return np.bincount(at, minlength=len(bounds) - 1)


def section_tokens(docs: DataFrame, path: str | None = None, rule: str = "start") -> DataFrame:
    """One row per section: doc_id, section, start_byte, end_byte, n_tokens, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or vocabulary()
    longs = ("start_byte", "end_byte", "n_tokens", "doc_tokens")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("section", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in longs)])

    def work(batches):
        encoder, length = encoding(path)
        for batch in batches:
            for a, b in W.row_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, off = W.column_bytes(part.column(1))
                whole, off = data.tobytes(), off.tolist()
                row, section, found = [], [], [[], [], [], []]
                for i, (x, y) in enumerate(zip(off[:-1], off[1:], strict=True)):
                    text = whole[x:y]
                    ends = np.cumsum(length[np.array(encoder.encode_ordinary(text.decode()), np.int64)])
                    bounds = section_bounds(text)
                    n = attributed(ends, bounds, rule)
                    row += [i] * len(n)
                    section += range(len(n))
                    for column, values in zip(found, (bounds[:-1], bounds[1:], n, np.full(len(n), len(ends))), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(section, pa.int32()), *(pa.array(np.concatenate(c).astype(np.int64)) for c in found)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)
