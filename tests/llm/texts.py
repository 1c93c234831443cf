"""Small tables with every kind of awkward row."""

from __future__ import annotations

import numpy as np

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: doc_id, text, lang, source, n_chars and columns whose names an operator might use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, shard string, fp string, length int, __row long, component string, batch string, n int, y string, out string, part int"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def rows() -> list[tuple]:
    texts = [
        (1, prose(1, 40)), (2, prose(1, 40)), (3, prose(1, 40) + " tail"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "ONE"), (9, "two words"), (10, prose(2, 30_000)), (11, "x" * 60_000),
        (None, "no id at all"), (None, None), (12, "repeated row"), (12, "repeated row"), (13, "Größe naïve 日本語 テスト 😀     é"), (14, "don't <|endoftext|> <|end|> 3.14 a\x00b"), (15, prose(3, 200)),
        *((20 + k, "the same text in many rows, all alike") for k in range(30)),
    ]
    return [(i, t, None if i == 4 else "en", None if i == 5 else "hot", None if i == 6 else len(t or ""), 1, "s", "f", 2, 3, "c", "b", 4, "y", "o", 5) for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(tmp_path, **tables) -> str:
    """A folder of tables as the queries read it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
