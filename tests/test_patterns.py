"""Patterns behind their literals give what they give alone, also for letters that fold to ASCII."""

import random

from pyspark.sql import functions as F

from tracefold.functions import text as T


def test_literals_lose_no_match(spark):
    random.seed(4)
    parts = ["../", "..\\", "%2E%2e", "/ETC/passwd", "<SCRIPT", "scrİpt", "ſcript", "<ſvg", "javaſcript:", "java script :", "oNerror =", "alert (", "confırm(", "jnDİ:ldap:", "${ jndi :", "K", "union all select", "UNİON ſelect", "drop table", "ſet", "or 1=1", "oR 'a'='b'", "/*", "--", "\n", "\\n", "exec (", "; id", "plain", "ß", "word", " "]
    texts = [None, "", *parts, *("".join(random.choices(parts, k=random.randint(1, 6))) for _ in range(1500))]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for p in T.PATTERNS.values():
        alone = F.coalesce(F.regexp_count("x", F.lit(T.java(p))), F.lit(0))
        row = df.agg(F.count_if(T.contains(F.col("x"), p) != (alone > 0).cast("int")), F.count_if(T.occurrences(F.col("x"), p) != alone), F.count_if(alone > 0)).collect()[0]
        assert row[0] == row[1] == 0 and row[2] > 10, p
