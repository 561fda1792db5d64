"""Language prediction by partial matching over bytes.

From labelled texts, counts of byte runs of up to ``ORDER + 1`` bytes give one context tree
for each language, all over one set of contexts.  The trees are frozen into a table: for each
context, byte and language the exact code length in bits, with escape probabilities (method
C) and exclusion, so that each context's probabilities sum to one.  A text's code length under
a language is the sum over all of its bytes; the shortest code wins.

Following the longest known context is an automaton whose state after a byte depends on the
last bytes only, so states come order by order from table look-ups over whole columns.

The learning sample is bounded: at most about ``SAMPLE_DOCS`` labelled texts a language, chosen
by a hash of their id, of the ``LANGUAGES`` languages with most of them.  All runs of bytes in the
sample are counted.  Contexts are kept up to a table of ``TABLE_CELLS`` numbers (or
``LEAST_CONTEXTS`` contexts, if many languages leave less): every language in turn adds its
commonest one that is not in yet, so a rare language has as many contexts as a common one.

Defined cases: a null text or one without a letter is ``und`` with score 0; a null or
empty table of labels makes all texts ``und``; ties go to the first language by name; very long
texts are read whole; repeated rows get equal results; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import stored

ORDER = 4
SAMPLE_DOCS = 1500
#: Numbers in the frozen table (contexts x 256 bytes x languages).
TABLE_CELLS = 6_000_000
#: Contexts that are kept however many languages there are.
LEAST_CONTEXTS = 1_000
#: Languages that are learned.
LANGUAGES = 400
UND = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, docs_per_language: int = SAMPLE_DOCS, languages: int = LANGUAGES) -> DataFrame:
    """text, lang: about so many rows a language, by a hash of the id; of fewer, all."""
    has = labelled.where("text is not null and lang is not null")
    total = stored(has.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(languages), "languages")
    share = F.least(F.lit(docs_per_language) / F.col("_n"), F.lit(1.0))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)
    return has.select("doc_id", "text", "lang").join(F.broadcast(total), "lang").where(drawn).select("text", "lang")  # at most ``languages`` rows


def run_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, size, run (bytes as a big-endian number), n over ``texts`` (text, lang)."""

    def count(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b in W.row_slices(batch.column(0)):
                data, off = W.column_bytes(batch.column(0).slice(a, b - a))
                row = np.repeat(np.arange(a, b), np.diff(off))
                names = sorted(set(langs[a:b]))
                lang = np.repeat(np.array([names.index(x) for x in langs[a:b]], np.int64), np.diff(off))
                run = np.zeros(len(data), np.int64)
                for k in range(1, order + 2):
                    m = len(data) - k + 1
                    if m <= 0:
                        break
                    run = (run[:m] << 8) | data[k - 1 : k - 1 + m]
                    inside = row[:m] == row[k - 1 :]
                    got, n = np.unique((lang[:m] << 40 | run)[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[i] for i in (got >> 40)], pa.string()), pa.array(np.full(len(got), k, np.int32)), pa.array(got & ((1 << 40) - 1)), pa.array(n)], names=["lang", "size", "run", "n"]
                    )

    return texts.select("text", "lang").mapInArrow(count, "lang string, size int, run long, n long").groupBy("lang", "size", "run").agg(F.sum("n").alias("n"))


def chosen_contexts(counts: DataFrame, order: int, limit: int) -> DataFrame:
    """size, run of the contexts to keep: every language's commonest in turn, ``limit`` in all.

    A context's own suffix and beginning are as common or commoner in each language, and shorter, so they come before it.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "size", "run"))
    ranked = counts.where(F.col("size") <= order).withColumn("rank", rank).where(F.col("rank") <= limit)
    return ranked.groupBy("size", "run").agg(F.min("rank").alias("rank")).orderBy("rank", "size", "run").limit(limit).select("size", "run")


class Model:
    """Frozen trees: ``step[k]`` gives the state of order k + 1 from that of order k before and the byte; ``cost[state, byte, language]`` the bits.

    ``counts``: lang, size, run, n of all runs of one byte more than a context; ``contexts``: size, run.
    """

    def __init__(self, langs: list[str], counts: pd.DataFrame, contexts: pd.DataFrame, order: int = ORDER):
        self.langs, self.order = langs, order
        n = len(langs)
        at = {x: i for i, x in enumerate(langs)}
        tables: list[dict[int, np.ndarray]] = [{} for _ in range(order + 1)]
        lang = counts.lang.map(at).to_numpy()
        size, run, num = counts["size"].to_numpy(), counts.run.to_numpy(), counts.n.to_numpy()
        known = [set()] + [set(contexts.run[contexts["size"] == k].tolist()) for k in range(1, order + 1)]
        for k in range(2, order + 1):
            known[k] = {x for x in known[k] if (x >> 8) in known[k - 1] and (x & ((1 << (8 * (k - 1))) - 1)) in known[k - 1]}
        for k in range(order + 1):
            hit = size == k + 1
            for g, r, c in zip(lang[hit], run[hit], num[hit], strict=True):
                ctx = int(r) >> 8
                if k == 0 or ctx in known[k]:
                    tables[k].setdefault(ctx, np.zeros((n, 256)))[g, int(r) & 255] += c
        ids = [{0: 0}]
        count = 1
        for k in range(1, order + 1):
            ids.append({x: count + i for i, x in enumerate(sorted(known[k]))})
            count += len(known[k])
        prob = np.zeros((count, n, 256))
        for k in range(order + 1):
            for ctx, state in ids[k].items():
                below = np.full((n, 256), 1 / 256) if k == 0 else prob[ids[k - 1][ctx & ((1 << (8 * (k - 1))) - 1)]]
                seen = tables[k].get(ctx, np.zeros((n, 256)))
                kinds = (seen > 0).sum(1, keepdims=True)
                whole = seen.sum(1, keepdims=True) + kinds
                rest = np.where(seen > 0, 0.0, below)
                left = rest.sum(1, keepdims=True)
                escape = np.divide(kinds, whole, out=np.ones_like(left), where=whole > 0)
                own = np.divide(seen, whole, out=np.zeros_like(seen), where=whole > 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    prob[state] = np.where(left > 0, own + escape * rest / left, seen / np.maximum(seen.sum(1, keepdims=True), 1))
        self.cost = np.ascontiguousarray((-np.log2(np.maximum(prob, 1e-12))).transpose(0, 2, 1)).astype(np.float32)
        # state of order k after a byte: the longest known suffix of (state of order k - 1 before, byte)
        self.step = []
        name = {s: (k, x) for k in range(order + 1) for x, s in ids[k].items()}
        size_before = 1
        for k in range(1, order + 1):
            table = np.zeros((size_before, 256), np.int32)
            for s in range(size_before):
                length, ctx = name[s]
                for byte in range(256):
                    j, x = length + 1, (ctx << 8 | byte) if length else byte
                    while j and x not in ids[j]:
                        j -= 1
                        x &= (1 << (8 * j)) - 1
                    table[s, byte] = ids[j][x] if j else 0
            self.step.append(table)
            size_before += len(ids[k])

    def bits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code lengths, rows by languages."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(data):
            return out
        first = off[:-1][off[:-1] < off[1:]]
        byte = data.astype(np.int64)
        state = np.zeros(len(data), np.int64)  # order 0
        for table in self.step:
            before = np.empty(len(data), np.int64)
            before[1:] = state[:-1]
            before[first] = 0
            state = table.reshape(-1)[before * 256 + byte].astype(np.int64)
        before = np.empty(len(data), np.int64)
        before[1:] = state[:-1]
        before[first] = 0
        cost = self.cost.reshape(-1, len(self.langs))[before * 256 + byte]
        some = off[:-1] < off[1:]
        out[some] = np.add.reduceat(cost, first, axis=0, dtype=np.float64)
        return out


def learn(labelled: DataFrame, order: int = ORDER, cells: int = TABLE_CELLS, docs_per_language: int = SAMPLE_DOCS) -> Model:
    """A model of ``labelled`` (doc_id, text, lang).  At most 256 rows a context and language reach the driver."""
    counts = stored(run_counts(sample(labelled, docs_per_language), order), "runs")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # at most LANGUAGES rows
    contexts = stored(chosen_contexts(counts, order, max(cells // (256 * max(1, len(langs))), LEAST_CONTEXTS)), "contexts")
    ends = F.when(F.col("size") == 1, F.lit(0)).otherwise(F.shiftright("run", 8))
    known = contexts.unionByName(contexts.sparkSession.createDataFrame([(0, 0)], contexts.schema))
    own = counts.withColumns({"_size": F.col("size") - 1, "_run": ends}).join(known.select(F.col("size").alias("_size"), F.col("run").alias("_run")), ["_size", "_run"], "left_semi")
    got = own.select("lang", "size", "run", "n").toArrow().to_pandas().sort_values(["size", "run", "lang"])
    return Model(langs, got, contexts.toArrow().to_pandas(), order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as doc_id, held_out, lang_pred, score: the share of the winner if all languages are equally likely before."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"

    def work(batches):
        m = sent.value
        names = np.array([*m.langs, UND], dtype=object)
        for batch in batches:
            for a, b in W.row_slices(batch.column(1)):
                part = batch.slice(a, b - a)
                data, off = W.column_bytes(part.column(1))
                letter = np.array(part.column(3).to_pylist(), bool)
                if m.langs:
                    bits = m.bits(data, off)
                    best = bits.argmin(1)
                    score = 1 / np.exp2(-(bits - bits.min(1, keepdims=True))).sum(1)
                else:
                    best, score = np.zeros(b - a, np.int64), np.zeros(b - a)
                best = np.where(letter & (len(m.langs) > 0), best, len(m.langs))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(names[best], pa.string()), pa.array(np.where(letter, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(work, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that are not held out."""
    model = learn(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), **options)
    return predict(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
