"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is a row of tokens: runs of up to RUN characters other than space and ideographs, and single ideographs, so scripts without
spaces have tokens too. Its elements are the k-mers of `k` tokens, each with its occurrence number: the second place of a k-mer is an
element of its own. Each element has a hash, and `signatures` evenly turned copies of the circle of hashes are as many permutations: the
i-th ranks elements by their way from the i-th mark on. A signature takes the `length` least elements of its permutation, puts them back into the order
of the text and hashes that tuple. Two texts share a signature if they share those elements and have them in the same order, so moved passages count
as well as changed ones, as in edit distance. The likeness of two fingerprints is the share of equal signatures.

All of it happens inside a text's own row: k-mers are packed into longs (33 bits of hash, 30 of position), sorted, numbered within runs of equal
hashes, hashed again with their number and sorted once more; for each of the marks only the first `length` elements beyond it matter. Nothing is
exploded and nothing shuffled; costs grow with the text's length and its logarithm. Two k-mers of one text that share 33 bits count as occurrences of one.

Texts with fewer tokens than k are one element; with fewer elements than `length` a tuple has what there is; texts without tokens (null, empty,
blank) have the fingerprint of zeros and are alike. Equal texts have equal fingerprints. Texts of any length are taken whole, as arrays of a few longs a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import fresh, scratch
from tracefold.operators.split import numbered_in_order

K, LENGTH, SIGNATURES, RUN = 2, 2, 64, 12
_PLACE_BITS = 30  # a text has fewer tokens than 2^30
_PLACE = (1 << _PLACE_BITS) - 1
_HASH = (1 << 33) - 1
_WIDE = r"\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"  # ideographs, kana and syllables
TOKENS = rf"[{_WIDE}]|[^{_WIDE}\x09-\x0D\x20]{{1,{RUN}}}"


def _packed(h: Column, place: Column) -> Column:
    """33 bits of a hash above a place: a long that isn't negative."""
    return F.shiftleft(F.shiftrightunsigned(h, 31), _PLACE_BITS).bitwiseOR(place.cast("long"))


def _top(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, length: int = LENGTH, signatures: int = SIGNATURES) -> DataFrame:
    """df with a column of `signatures` ints, the fingerprint of the text. Each step is a column of its own, so none is computed twice."""
    names = [fresh(df, f"{out}_{x}") for x in ("tokens", "kmers", "starts", "elements", "least", "marks")]
    tokens, kmers, starts, elements, least, marks = names
    keep = [F.col(f"`{c}`") for c in df.columns]
    step = lambda d, name, c, *also: d.select(*keep, *also, c.alias(name))

    d = step(df, tokens, F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(TOKENS), F.lit(0)))
    n = F.size(tokens)
    places = F.sequence(F.lit(0), n - k)
    gram = F.transform(places, lambda i: _packed(F.xxhash64(*(F.get(tokens, i + j) for j in range(k))), i))
    few = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(_packed(F.xxhash64(tokens), F.lit(0))))
    d = step(d, kmers, F.sort_array(F.when(n >= k, gram).otherwise(few)))

    # runs of equal k-mers: where each starts, hence how long it is, hence the number of each place within it
    new = F.filter(F.transform(kmers, lambda x, j: F.when((j == 0) | (_top(x) != _top(F.get(kmers, j - 1))), j)), lambda j: j.isNotNull())
    d = step(d, starts, new, F.col(kmers))
    ends = lambda j, t: F.coalesce(F.get(starts, t + 1), F.size(kmers)) - j
    runs = F.flatten(F.transform(starts, lambda j, t: F.sequence(F.lit(1), ends(j, t))))
    number = F.when(F.size(starts) == F.size(kmers), F.transform(starts, lambda j: F.lit(1))).otherwise(runs)
    element = F.zip_with(kmers, number, lambda x, o: _packed(F.xxhash64(_top(x), o), x.bitwiseAND(F.lit(_PLACE))))
    d = step(d, elements, F.sort_array(element))

    # of each stretch between two marks its first elements suffice
    span = (_HASH + 1) // signatures
    mark = lambda x: F.floor(_top(x) / F.lit(span))
    d = step(d, least, F.filter(elements, lambda x, j: (j < length) | (mark(F.get(elements, j - length)) != mark(x))))
    ends_of = F.transform(F.sequence(F.lit(0), F.lit(signatures - 1)), lambda i: F.shiftleft(i.cast("long") * span, 1))  # even: a mark stands before elements of its hash
    d = step(d, marks, F.sort_array(F.concat(ends_of, F.transform(least, lambda x: F.shiftleft(_top(x), 1).bitwiseOR(F.lit(1))))), F.col(least))
    before = F.filter(F.transform(marks, lambda x, j: F.when(x % 2 == 0, j)), lambda j: j.isNotNull())  # the i-th mark has i marks before it
    circle = F.concat(least, least)
    take = F.least(F.size(least), F.lit(length))
    swapped = lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 33).bitwiseOR(_top(x))

    def tuple_hash(j: Column, i: Column) -> Column:
        members = F.array_sort(F.transform(F.slice(circle, j - i + 1, take), swapped))
        return F.xxhash64(F.transform(members, lambda x: x.bitwiseAND(F.lit(_HASH)))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    return step(d, out, F.when(F.size(least) == 0, F.array_repeat(F.lit(0), signatures)).otherwise(F.transform(before, tuple_hash)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal signatures of two fingerprints."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def hexadecimal(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, doc_id, text, n_chars, edited, next_key: each row beside its text with the last third replaced by the start of the next document.

    The next is that of the next lesser id (after the least the greatest; null ids come last, ties by a hash of the text); rows of one id and text
    are one document, and a lone document is its own next. Ids are numbered in sorted ranges; of the texts only the part that is lent travels twice.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash")).alias("key"), text.alias("text"))
    each = rows.select("key", (F.length("text") / 3).cast("long").alias("third")).distinct()
    placed = numbered_in_order(each, [F.col("key.id").desc_nulls_last(), F.col("key.hash")], "at", "all")
    follows = placed.select(F.col("key").alias("next_key"), F.col("at").alias("next_at"))
    links = scratch(placed.withColumn("next_at", F.col("at") % F.col("all") + 1).join(follows, "next_at").select("key", "third", "next_key"), "next-documents")
    lent = rows.withColumnRenamed("key", "next_key").join(links, "next_key").select("key", "next_key", F.expr("substring(text, 1, cast(third as int))").alias("lent")).dropDuplicates(["key"])
    joined = rows.join(lent, "key").withColumn("n_chars", F.length("text").cast("long"))
    kept = F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))")
    return joined.select("key", F.col("key.id").alias("doc_id"), "text", "n_chars", F.concat(kept, "lent").alias("edited"), "next_key")


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next of every row."""
    both = fingerprint(fingerprint(with_edits(docs, id_col, text_col), "text", "own", **parameters), "edited", "other", **parameters)
    marked = scratch(both.select("key", "next_key", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other"), "fingerprints")
    follows = marked.select(F.col("key").alias("next_key"), F.col("own").alias("following")).dropDuplicates(["next_key"])
    return marked.join(follows, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", hexadecimal(F.col("own")).alias("fingerprint"), hexadecimal(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
