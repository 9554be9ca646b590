"""Small tables and plain re-computations for the operators' tests."""

import random
import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, rid string, key string, part string, fp string, x string, score string"
SPACES = "[^\x20\x09-\x0D]+"


def docs(spark, rows):
    """A documents table with clashing extra columns."""
    full = [(i, t, "en", "s", len(t or ""), *("?" * 7)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def prose(n, seed=0, words=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}x" for _ in range(n))


def odd_rows():
    """Nulls in both columns, empty, white, very long and repeated texts, a repeated id."""
    base, shared = prose(300, 1), prose(90, 2)
    return [
        (1, base), (2, base), (2, base), (3, shared + " " + prose(40, 3)), (4, prose(60, 4) + " " + shared), (4, "other é text"), (None, base), (None, None),
        (5, None), (6, ""), (7, " \n\t "), (8, "ab " * 4000), (9, prose(30000, 5) + " " + shared), (10, "日本語 " * 50), (11, base[:-1] + "!"), (12, "z" * 1000),
    ]
