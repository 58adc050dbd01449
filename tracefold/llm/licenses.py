"""License scans by diagonal voting, in DataFrame functions only.

Each text's words (A-Z lower-cased; runs of digits, letters and all beyond ASCII) give a hash for every two neighbours.
All of them are joined to the positions of the templates' pairs, and each match votes for the diagonal (position in the
text less position in the template) of its template. A place of a whole phrase is a diagonal with a vote for every
pair of the template; votes on diagonals at most SLACK apart are merged into a span, so a license with a word more or less still
adds up. A span is verified in order: walked from its first word to its last, a vote counts only if it lies
further in the template than all before it, so words of the template in another order don't add up. Templates are names of
licenses, which must stand whole, and passages of their texts, several for each, accepted if at least `coverage` of their pairs
count. A vote counts only if both words are the template's, so equal hashes of other words do no harm.

The templates are a fixed table of some hundred rows and are broadcast. After the join only matches are shuffled, by
text, beside one row per text that keeps texts without matches.

Null texts are empty: no words, places null, labels empty, score 0. Texts of any length are scanned whole, each in the rows of
its own words. Repeated rows, rows of one id and null ids keep a row each; of places that tie, the first and last are given. Other
columns, also of names used here, play no part. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 2
COVERAGE = 0.6
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Names by which licenses are referred to; they must stand whole.
NAMES = {
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "under the mit license": "mit",
    "under the isc license": "isc",
    "under the apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license as published by the free software foundation": "gnu-gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license v 2 0": "mpl-2.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "cc0 1 0 universal": "cc0-1.0",
    "the artistic license 2 0": "artistic-2.0",
}
# Passages of the licenses' own texts; most of a passage is enough.
PASSAGES = {
    "licensed under a creative commons attribution license": "creative-commons",
    "share copy and redistribute the material in any medium or format": "creative-commons",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-license-text",
    "is free and unencumbered software released into the public domain": "unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary": "unlicense",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2.0",
    "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "cc0-1.0",
    "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed": "artistic-2.0",
}


def template_rows(coverage: float = COVERAGE) -> list[tuple[int, str, bool, int, int, int, str, str]]:
    """(template, label, base, pairs of the template, how many of them it takes, position, word, next word)."""
    out = []
    kinds = [*((p, x, True, 1.0) for p, x in BASE.items()), *((p, x, False, 1.0) for p, x in NAMES.items()), *((p, x, False, coverage) for p, x in PASSAGES.items())]
    for number, (phrase, label, base, share) in enumerate(kinds):
        words = phrase.split()
        pairs = len(words) - 1
        least = max(1, math.ceil(share * pairs - 1e-9))
        out += [(number, label, base, pairs, least, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return out


def _in_order(votes: Column) -> Column:
    """Of (position in the text, less the position in the template) in ascending order: how many lie further in the template than all before, and the first and last of them."""
    start = F.struct(F.lit(-1).alias("top"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))

    def walked(state: Column, vote: Column) -> Column:
        at = (-vote["less"]).cast("int")
        further = F.struct(at.alias("top"), (state["n"] + 1).alias("n"), F.coalesce(state["first"], vote["i"]).alias("first"), vote["i"].alias("last"))
        return F.when(at > state["top"], further).otherwise(state)

    return F.aggregate(F.sort_array(votes), start, walked)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row.

    score: the share of its template's pairs that the best accepted span has, 0 if there is none. spans: label:first word-last word
    of each accepted span of a name or passage, in order of place and label, comma-joined.
    """
    spark = docs.sparkSession
    templates = spark.createDataFrame(template_rows(coverage), "template int, label string, base boolean, pairs int, least int, at int, word string, next string")
    templates = F.broadcast(templates.withColumn("hash", F.xxhash64("word", "next")))
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.array_remove(F.split(text, BREAKS), "").alias("words"))
    following = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    hashes = F.slice(F.zip_with("words", following, lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size("words") - 1, F.lit(0)))
    grams = words.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit(None).cast("long")), hashes).alias("hashes"))
    each = grams.select("row", "doc_id", "n_words", "words", F.posexplode("hashes").alias("i", "hash"))  # i is 0 for the text's own row, else the position + 1
    same = (F.get("words", F.col("i") - 1) == F.col("word")) & (F.get("words", F.col("i")) == F.col("next"))
    votes = each.join(templates, "hash", "left").where(F.col("hash").isNull() | (F.col("template").isNotNull() & same))
    votes = votes.select("row", "doc_id", "n_words", "template", "label", "base", "pairs", "least", "at", (F.col("i") - 1 - F.col("at")).cast("long").alias("diagonal"))

    text_key = ["row", "doc_id", "n_words"]
    template_key = [*text_key, "template", "label", "base", "pairs", "least"]
    diagonals = votes.repartition("row").groupBy(*template_key, "diagonal").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("at"))  # a bit for each position
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > SLACK).cast("int"), F.lit(0))
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
    whole = F.col("base") & (F.bit_count("at") == F.col("pairs"))
    spans = merged.groupBy(*template_key, "span").agg(
        F.count_if(whole).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
        F.bit_or("at").alias("all"),
        F.collect_list(F.struct("diagonal", "at")).alias("lists"),
    )
    places_of = F.sequence(F.lit(0), F.col("pairs") - 1)
    voted = lambda x: F.filter(places_of, lambda a: F.call_function("shiftright", x["at"], a).bitwiseAND(1) == 1)
    pairs_of = lambda x: F.transform(voted(x), lambda a: F.struct((x["diagonal"] + a).alias("i"), (-a).alias("less")))
    enough = F.bit_count("all") >= F.col("least")
    spans = spans.withColumn("span", F.when(enough, _in_order(F.flatten(F.transform("lists", pairs_of))))).drop("lists", "all")
    found = F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("span.n") >= F.col("least"))
    covered = F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("span.n") / F.col("pairs"))
    place = F.when(found & ~F.col("base"), F.struct(F.col("span.first").alias("first"), F.col("label"), (F.col("span.last") + 1).alias("last")))
    labels = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    shown = lambda x: F.concat(x["label"], F.lit(":"), x["first"].cast("string"), F.lit("-"), x["last"].cast("string"))
    return (
        spans.groupBy(*text_key)
        .agg(
            F.coalesce(F.sum("places"), F.lit(0)).alias("n_base"),
            F.min("first").alias("first_word"),
            F.max("last").alias("last_word"),
            labels(F.when(F.col("places") > 0, F.col("label"))).alias("base_labels"),
            labels(F.when(found, F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(found, covered)), F.lit(0.0)).alias("score"),
            F.array_join(F.transform(F.array_sort(F.collect_set(place)), shown), ",").alias("spans"),
        )
        .drop("row")
    )


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {pairs}, {least}, {at}, '{a}', '{b}')" for t, label, base, pairs, least, at, a, b in template_rows())
    return rf"""
WITH t(template, label, base, pairs, least, tpos, word, next) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(list_append(list_slice(w, 2, len(w)), NULL)) AS next, unnest(range(0, len(w))) AS i FROM d),
votes AS (SELECT DISTINCT doc_id, template, label, base, pairs, least, tpos, i, i - tpos AS diagonal FROM p JOIN t USING (word, next)),
spans AS (
  SELECT *, sum(CASE WHEN gap > {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal, tpos) AS span
  FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, tpos) AS gap FROM votes)
),
places AS (SELECT doc_id, template, label, diagonal FROM votes WHERE base GROUP BY doc_id, template, label, diagonal, pairs HAVING count(*) = pairs),
base AS (SELECT doc_id, count(*) AS n, min(diagonal) AS first, max(diagonal) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
walked AS (
  SELECT *, tpos > coalesce(max(tpos) OVER (PARTITION BY doc_id, template, span ORDER BY i, tpos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS further
  FROM spans WHERE NOT base
),
covered AS (
  SELECT doc_id, label, count(*) / CAST(pairs AS DOUBLE) AS covered, min(i) AS first, max(i) + 1 AS last
  FROM walked WHERE further GROUP BY doc_id, template, label, pairs, least, span HAVING count(*) >= least
),
found AS (SELECT doc_id, label, covered FROM covered UNION SELECT doc_id, label, 1.0 FROM places),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM found GROUP BY doc_id),
shown AS (SELECT doc_id, string_agg(label || ':' || first || '-' || last, ',' ORDER BY first, label, last) AS spans FROM (SELECT DISTINCT doc_id, label, first, last FROM covered) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.first AS BIGINT) AS first_word, CAST(base.last AS BIGINT) AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, CAST(coalesce(named.score, 0) AS DOUBLE) AS score, coalesce(shown.spans, '') AS spans
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN shown USING (doc_id)
"""
