"""Small tables of awkward documents, and plain models of what operators must give."""

from __future__ import annotations

import random
import re

UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 1000) -> list[str]:
    return [WORDS[rng.randrange(min(vocabulary, len(WORDS)))] for _ in range(n)]


_r = random.Random(1)
WORDS = sorted({"".join(_r.choice("abcdeghilmnorstué") for _ in range(_r.randrange(2, 9))) for _ in range(1500)})[:1000]


def documents(seed: int = 3) -> list[tuple]:
    """Prose with exact and near copies, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\n ", "One", "Two words", "ÀÉ éà", "x" * 5000]
    base = [" ".join(prose(rng, 120, 1000)) for _ in range(12)]
    texts += base
    for b in base[:6]:
        words = b.split()
        for share in (0, 1, 4, 12, 30):
            own = list(words)
            for k in rng.sample(range(len(own)), share):
                own[k] = rng.choice(WORDS)
            texts.append(" ".join(own))
    texts += [base[0].upper(), "\n".join(base[:3]), " ".join(prose(rng, 20_000, 1000))]
    rows = [(k, t, None if k % 7 == 0 else ("en", "de", "fr")[k % 3], None if k % 11 == 0 else f"src{k % 5}", len(t or "")) for k, t in enumerate(texts)]
    return rows + [rows[8], (None, base[1], "en", "src1", 1), (None, None, None, None, None)]


def spark_docs(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOC_SCHEMA)


def clashing(df):
    """The same with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("text_key", "vertex", "at", "n", "w", "keys", "template", "epoch", "score", "kept", "items", "_id", "_key", "_gone")})
