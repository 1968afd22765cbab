r"""Source divergence audit: how far the term distributions of the sources of a language lie apart, and which terms part them.

Terms are the runs `[^\x00-\x40\x5B-\x60\x7B-\x7F]+` of a text, A-Z lower-cased. A language keeps the V terms that at
least `min_docs` of its rows hold. A group (lang, source), and the language itself, gives a kept term with c occurrences
p = 1 + floor(10**9 * (c + 5) / (N + 5 * V)), N being the sum of c over the kept terms: integers, so all sums are exact.

Each kept term becomes one wide vector: an array of its occurrences, indexed by the language's sources in order.
Higher-order functions turn it into p and into the contribution |p_i - p_j| of every pair of sources; the contributions
are summed before and after one shuffle by (lang, i, j), so no task holds the terms of a source or of a pair.

Terms are counted into such vectors by the tasks that read the texts, for at most CELLS cells at a time, and the vectors
of a term are summed by one shuffle; a hot source's rows are thereby summed where they are read. Languages of more than
WIDTH sources have vectors in parts of that width. The pairs of sources are the result's size, so a language's list of
sources must fit a row, and a document's distinct terms a task; a source's or a language's terms needn't.

Defined results: null text, lang and source are ''; a row is a document, so repeated ids and rows count each; a group
without terms has a row for each other source of its language, of value 0 where the language keeps no term; a language
of one source has none; ties in value go by the item's UTF-8 bytes; an empty table gives no rows; further columns aren't
read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side, text_batches

MIN_DOCS = 30
TOP = 50
SCALE = 10**9
#: What a count is raised by, for each kept term.
PRIOR = 5
#: Sources of a part of a vector: the columns of the sum.
WIDTH = 32
#: Cells (terms by sources) that a task sums before it hands them on, and words it holds until then.
CELLS, WORDS = 8_000_000, 4_000_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 22

_LETTER = [97 <= b <= 122 or b >= 128 for b in range(256)]
_SPLIT = bytes(b if keep else 32 for b, keep in enumerate(_LETTER))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of data, a piece at a time; a term is never cut."""
    data, at = data.lower().translate(_SPLIT), 0
    while len(data) - at > PIECE:
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def _keys(docs: DataFrame, *names: str) -> DataFrame:
    """docs of these columns, null as ''."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names))


def source_lists(docs: DataFrame) -> DataFrame:
    """(lang, sources): each language's sources in order, those without terms too."""
    return _keys(docs, "lang", "source").distinct().groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))


class Counts:
    """Vectors of terms by language: occurrences by source, and documents."""

    def __init__(self, sources: int, width: int) -> None:
        self.width, self.parts = width, -(-sources // width)
        self.across = self.width * self.parts
        self.most = max(10_000, CELLS // self.across)
        self.clear()

    def clear(self) -> None:
        number = count()
        self.known: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__))
        self.ids, self.sources, self.held, self.words, self.size = [], [], [], 0, 0

    def add(self, lang: str, source: int, text: str) -> None:
        place = self.known[lang].__getitem__
        ids = np.concatenate([np.fromiter(map(place, terms), np.int64, len(terms)) for terms in _pieces(text.encode("utf-8", "surrogatepass"))])
        self.ids.append(ids)
        self.sources.append(source)
        self.held.append(np.unique(ids))
        self.words += len(ids)
        self.size = max(self.size, int(self.held[-1][-1]) + 1 if len(ids) else 0)

    def full(self) -> bool:
        return self.words >= WORDS or self.size >= self.most

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The vectors so far: (lang, term, part, docs, c0, c1, ...)."""
        if self.size:
            cells = np.concatenate(self.ids) * self.across + np.repeat(self.sources, [len(x) for x in self.ids])
            table = np.bincount(cells, minlength=self.size * self.across).reshape(self.size, self.parts, self.width)
            docs = np.bincount(np.concatenate(self.held), minlength=self.size)
            for lang, terms in self.known.items():
                ids = np.fromiter(terms.values(), np.int64, len(terms))
                names = pa.array(list(terms), pa.binary()).cast(pa.string())
                for part in range(self.parts):
                    rows = np.flatnonzero(table[ids, part].any(axis=1)) if part else np.arange(len(ids))
                    for a in range(0, len(rows), 20_000):
                        at = rows[a : a + 20_000]
                        yield self._batch(lang, names.take(pa.array(at)), part, docs[ids[at]] if part == 0 else np.zeros(len(at), np.int64), table[ids[at], part])
        self.clear()

    def _batch(self, lang: str, names: pa.Array, part: int, docs: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(names), pa.string()), names, pa.array(np.full(len(names), part, np.int32)), pa.array(docs), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(self.width))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "part", "docs", *(f"c{k}" for k in range(self.width))])


def kept_terms(docs: DataFrame, sources: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, wide) of docs (text, lang, source): the kept terms' occurrences by source, in the order of `sources`."""
    text_batches(docs.sparkSession)
    most = sources.agg(F.max(F.size("sources"))).first()[0] or 1
    width = min(WIDTH, most)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(most, width)
        for part in parts:
            for row in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                counts.add(*row)
                if counts.full():
                    yield from counts.batches()
        yield from counts.batches()

    places = cut(sources.select("lang", F.posexplode("sources").alias("at", "source")))
    places = small_side(places, 32 + F.octet_length("lang") + F.octet_length("source"))[0]
    rows = _keys(docs, "lang", "source", "text").join(places, ["lang", "source"]).select("lang", "at", "text")
    cells = [f"c{k}" for k in range(width)]
    found = rows.mapInArrow(run, "lang string, term string, part int, docs long, " + ", ".join(f"{c} long" for c in cells))
    wide = F.array(*(F.sum(c) for c in cells))
    if most <= width:
        terms = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), wide.alias("wide")).where(F.col("docs") >= min_docs)
        wide = F.slice("wide", 1, F.size("sources"))
    else:
        terms = found.groupBy("lang", "term", "part").agg(F.sum("docs").alias("docs"), wide.alias("wide"))
        terms = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("part", "wide"))).alias("by")).where(F.col("docs") >= min_docs)
        wide = F.transform("sources", lambda s, i: F.coalesce(F.col("by")[F.floor(i / width).cast("int")][i % width], F.lit(0).cast("long")))
    return _beside(terms, sources).select("lang", "term", wide.alias("wide"))


def _beside(df: DataFrame, by_lang: DataFrame) -> DataFrame:
    """df with the columns of by_lang: a row for each language, broadcast if these are small."""
    width = F.lit(64)
    for name, kind in by_lang.dtypes:
        if kind.startswith("array"):
            width = width + (F.aggregate(name, F.lit(0), lambda a, x: a + F.octet_length(x) + 16) if "string" in kind else 8 * F.size(name))
    return df.join(small_side(by_lang, width)[0], "lang")


def totals(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, sources, n, n_lang, v) of every language: n by source, over its kept terms."""
    cells = kept.select("lang", F.posexplode("wide").alias("i", "c")).groupBy("lang", "i").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    by_lang = cells.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("n"), F.max("v").alias("v"))
    n = F.coalesce("n", F.transform("sources", lambda s: F.lit(0).cast("long")))
    both = sources.join(by_lang, "lang", "left").select("lang", "sources", n.alias("n"), F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    return both.withColumn("n_lang", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))


def share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * v)), exact for counts of up to 20 digits."""
    wide = lambda x: x.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR), wide(total + PRIOR * v)) + 1


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` by other source, part `term` by term that is commoner here than in the language."""
    sources = cut(source_lists(docs))
    kept = cut(kept_terms(docs, sources, min_docs))
    known = cut(totals(kept, sources))
    here = F.transform("wide", lambda c, i: F.struct(c.alias("c"), share(c, F.col("n")[i], F.col("v")).alias("p")))
    whole = share(F.aggregate("wide", F.lit(0).cast("long"), lambda a, x: a + x), F.col("n_lang"), F.col("v"))
    vectors = _beside(kept, known.select("lang", "n", "n_lang", "v")).select("lang", "term", here.alias("at"), whole.alias("q"))

    terms = vectors.select("lang", "term", "q", F.posexplode("at").alias("i", "x")).where((F.col("x.c") > 0) & (F.col("x.p") > F.col("q")))
    terms = terms.select("lang", "i", F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value"))
    terms = _ranked(terms).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # A vector of zeros for each language: its pairs are there if it keeps no term.
    zeros = known.select("lang", F.transform("sources", lambda s: F.lit(0).cast("long")).alias("p"))
    shares = vectors.select("lang", F.transform("at", lambda x: x["p"]).alias("p")).unionByName(zeros)
    each = F.transform("p", lambda a, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda b, k: F.struct(i.alias("i"), (i + k + 1).alias("j"), F.abs(a - b).alias("f"))))
    pairs = shares.select("lang", F.inline(F.flatten(each))).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    pairs = pairs.select("lang", "value", F.inline(F.array(F.struct(F.col("i").alias("i"), F.col("j").alias("j")), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    names = known.select("lang", "sources")
    pairs = _beside(pairs, names).select("lang", "i", F.col("sources")[F.col("j")].alias("item"), "value")
    pairs = _ranked(pairs).withColumn("part", F.lit("pair"))

    rows = _beside(pairs.unionByName(terms), names)
    return rows.select("lang", F.col("sources")[F.col("i")].alias("source"), "part", "item", "value", "rank")
