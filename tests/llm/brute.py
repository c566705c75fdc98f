"""Plain versions of what the operators compute, and tables with awkward rows."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), vocabulary)}" if rng.random() < 0.7 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(n=60, seed=5):
    """Documents with copies, near copies, shared passages, repeated lines and odd rows."""
    rng = random.Random(seed)
    texts = ["\n".join(prose(rng, rng.randrange(5, 25)) for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    passage = prose(rng, 60)
    for k in range(0, n, 7):
        texts[k] = f"{texts[k]}\n{passage}\n{prose(rng, 8)}"
    for k in range(3, n, 10):
        texts[k] = texts[k - 1]
    for k in range(6, n, 10):
        own = texts[k - 2].split(" ")
        own[len(own) // 2] = "changed"
        texts[k] = " ".join(own)
    texts[1] = None
    texts[2] = ""
    texts[5] = " \n\t "
    texts[8] = "one"
    texts[11] = "the same " * 3000
    texts[12] = "É ü naïve x \x1c y\x0bz"
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None]), len(t) if t else None) for k, t in enumerate(texts)]
    return rows + [rows[4]]


def odd(spark, rows=None):
    """The rows as a table with extra columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(corpus() if rows is None else rows, DOCUMENTS)
    return df.selectExpr("*", "1 AS h", "2 AS node", "'x' AS label", "3 AS n", "array(1) AS bands", "4 AS uid", "5 AS size", "6 AS words")


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
