"""Documents with the awkward cases: nulls, empty and very long texts, ties, repeated rows, odd columns."""

import random
from functools import cache

SCHEMA = "doc_id long, text string, lang string, fingerprint string, component_id long, __cell int"


def words(n, seed=0, size=400):
    r = random.Random(seed)
    return r.choices(vocabulary(size), k=n)


@cache
def vocabulary(size):
    return ["".join(random.Random(i).choices("abcdefgéß", k=2 + i % 7)) for i in range(size)]


def texts():
    base = " ".join(words(80, 1))
    long = " ".join(words(3000, 2))
    out = ["", None, "   ", "one", "One  two\n\nthree \t x", base, base, base.upper(), base + " tail", long, long, "a" * 3000]
    out += [" ".join(words(60, 10 + i)) for i in range(20)]
    out += [" ".join(words(50, 50 + i) + words(50, 7) + words(20, 90 + i)) for i in range(5)]
    out += ["la " * 100, "it's 'tis we'll x 　 y"]
    return out


def documents(spark, rows=None):
    rows = rows if rows is not None else [*enumerate(texts()), (None, "no id"), (3, "one")]
    return spark.createDataFrame([(i, t, "en", "f", 7, 1) for i, t in rows], SCHEMA)
