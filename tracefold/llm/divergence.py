"""Divergence of sources within a language, by an inverted index of corrections to a baseline.

Each language keeps the terms that at least `least_docs` of its documents hold, V of them. A source gives a kept term with
`count` occurrences the share p = 1 + floor(1e9 (count + 1) / (N + V)), N being its occurrences of kept terms; so does the language
as a whole. Two shares differ by f(p, q) = floor((p - q)^2 / q), and two sources by the sum of f over all kept terms.

Nearly all terms are rare, so that sum isn't taken over V terms for each pair. With p0 the share of a count of zero, a pair of sources
a, b starts at V f(a.p0, b.p0), and postings correct it:

* a term of a adds f(a.p, b.p0) - f(a.p0, b.p0), whatever the term is; so terms of a with one share are counted first, and each
  distinct share of a meets each other source once. Terms of b likewise;
* a term of both adds f(a.p, b.p) - f(a.p, b.p0) - f(a.p0, b.p) + f(a.p0, b.p0), from a join of the postings on the term.
  Corrections of zero are dropped before they are summed.

Terms are counted within tasks, of which a row per group and term leaves. The join of shares with sources is salted, as languages are few;
the terms of a group are ranked by windows whose first `most_terms` leave each task. All numbers are exact: products are taken
in decimals or stay below 2^63.

Null texts, languages and sources are ''. A language without kept terms has V = 0: its pairs have value 0 and it has no term rows. Texts
of any length are counted piece by piece. Rows count as documents, repeated ones and those of one id too; ids play no part. Ties go
to the lesser item in UTF-8. Other columns, also of names used here, play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.llm.common import bound_batches, scratch

LEAST_DOCS, MOST_TERMS = 3, 200
HELD = 1 << 19  # (group, term) counts that a task holds before it passes them on
PIECE = 1 << 20  # bytes of a text that are split at once
SALTS = 32
# A-Z become a-z, other ASCII but letters a space: what is left between spaces are the terms, also in UTF-8.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, count long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE and (end := text.find(b" ", at + PIECE)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


def _rows(held: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    text = lambda x: pa.array(x, pa.binary()).view(pa.string())
    for (lang, source), (counts, docs) in held.items():
        terms = [*counts, None]  # the last row tells that the group occurs
        n = len(terms)
        numbers = [pa.array([*(x[t] for t in terms[:-1]), 0], pa.int64()) for x in (counts, docs)]
        yield pa.RecordBatch.from_arrays([text([lang] * n), text([source] * n), text(terms), *numbers], ["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, count, docs: occurrences of each term in each group and documents with it; a row with a null term for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(x.cast(pa.binary()).to_pylist() for x in batch.columns), strict=True):
                counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(counts), set()
                for piece in _pieces(text.translate(_LETTERS)):
                    words = piece.split()
                    counts.update(words)
                    own.update(words)
                seen.update(own)
                size += len(counts) - before
                if size > HELD:
                    yield from _rows(held)
                    held, size = {}, 0
        yield from _rows(held)

    bound_batches(docs)
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    partial = docs.select(*columns).mapInArrow(count, _COUNTS)
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(1e9 (count + 1) / (total + terms)); without terms the divisor counts as 1."""
    return F.expr(f"1 + cast((cast({count} + 1 as decimal(19, 0)) * 1000000000BD) div cast(greatest({total} + {terms}, 1) as decimal(20, 0)) as long)")


def unlike(p: str, q: str) -> Column:
    """floor((p - q)^2 / q) of shares, which are at most 1e9 + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(groups, postings), both written.

    groups: lang, source, terms (V), p0. postings: lang, term, source, p, p0, whole (the language's p) of kept terms that a source has.
    """
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs, **columns).withColumns({"in_docs": F.sum("docs").over(of_term), "in_lang": F.sum("count").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    kept = scratch(counted.where(F.col("term").isNull() | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "count", "in_lang", "first"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count_if(F.col("first") & F.col("term").isNotNull()).alias("terms"), F.sum("count").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total")).join(langs, "lang")
    groups = scratch(totals.withColumn("p0", share("0", "total", "terms")), "groups")
    shares = kept.where("term is not null").join(groups, ["lang", "source"]).select("lang", "term", "source", share("count", "total", "terms").alias("p"), "p0", share("in_lang", "lang_total", "terms").alias("whole"))
    return groups, scratch(shares, "postings")


def pair_values(groups: DataFrame, posted: DataFrame) -> DataFrame:
    """lang, source, item, value: the divergence of each source from each other one of its language."""
    alone = posted.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    base = groups.select("lang", "source", F.lit(None).cast("long").alias("p"), "p0", F.col("terms").alias("n"))  # no share: the baseline
    mine = alone.unionByName(base).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = mine.join(other, ["lang", "salt"]).where("source <> item")
    forth = F.when(F.col("p").isNull(), unlike("p0", "q0")).otherwise(unlike("p", "q0") - unlike("p0", "q0"))
    back = F.when(F.col("p").isNull(), F.lit(0)).otherwise(unlike("q0", "p") - unlike("q0", "p0"))
    sums = met.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * forth).alias("forth"), F.sum(F.col("n") * back).alias("back"))
    both = F.explode(F.array(F.struct("source", "item", F.col("forth").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))))
    single = sums.select("lang", both.alias("x")).select("lang", "x.*")

    theirs = posted.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = posted.join(theirs, ["lang", "term"]).where("source <> item")
    correction = unlike("p", "q") - unlike("p", "q0") - unlike("p0", "q") + unlike("p0", "q0")
    joint = shared.select("lang", "source", "item", correction.alias("value")).where("value <> 0").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return single.unionByName(joint).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: of each source all others by divergence (`pair`), and the terms it uses more than its language does (`term`)."""
    groups, posted = postings(docs, least_docs, **columns)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(groups, posted).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = posted.where("p > whole").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), unlike("p", "whole").alias("value"))
    return pairs.unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= most_terms))
