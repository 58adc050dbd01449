"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing names."""

import random


def documents(spark, n=120, seed=1):
    random.seed(seed)
    words = [f"w{i}" for i in range(200)]
    text = lambda k: " ".join(random.choice(words) for _ in range(k))
    rows = [(i, text(random.randint(1, 80))) for i in range(n)]
    rows += [(1000 + i, rows[i][1]) for i in range(10)]  # copies
    for i in range(10):  # near copies
        parts = text(120).split()
        rows += [(2000 + 3 * i + j, " ".join([*parts[: 100 + j], "odd"[: j + 1]])) for j in range(3)]
    passage = text(30)
    rows += [(3000 + i, f"{text(15)} {passage} {text(12)}") for i in range(8)]
    rows += [(4000, None), (4001, ""), (4002, "   "), (4003, "one"), (4004, "one two"), (4005, "One TWO"), (4006, text(3000)), (4007, "x" * 5000), (4008, "same same same " * 40)]
    rows += [(None, "null id text with some words"), (None, None), (4009, "repeated row"), (4009, "repeated row"), (4010, "shared id first"), (4010, "shared id second one")]
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", "clash", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, row string, n long").repartition(5)


def empty(spark):
    return documents(spark).limit(0)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
