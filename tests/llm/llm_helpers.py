"""Fixtures shared by the tests of the training text operators."""

from __future__ import annotations

import random

FOLDER = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


#: Nulls, empty and blank texts, repeated rows, a null id, equal texts and a long one; the further
#: columns have names that the operators use inside.
DDL = "doc_id long, text string, mark string, key string, rank int, _cls int, token string, n_chars long, row string"
LONG = prose(1, 30_000)
EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (5, "One two"), (None, prose(2, 40)), (6, prose(2, 40)),
    (7, prose(2, 39) + " changed"), (8, LONG), (9, prose(3, 60)), (10, prose(3, 60)), (11, "é ü 漢字 \u00a0 x"),
]


def edge_docs(spark, rows=EDGE):
    return spark.createDataFrame([(i, t, "m", "k", 1, 2, "t", 7, "r") for i, t in rows], DDL)


def empty_docs(spark):
    return spark.createDataFrame([], DDL)
