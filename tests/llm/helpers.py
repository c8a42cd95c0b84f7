"""Documents with every awkward case, and small brute-force forms."""

import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("score", T.StringType()), T.StructField("block", T.StringType()), T.StructField("fp", T.StringType()),  # names that operators use inside
])
PROSE = {
    "en": "the house of the river and the people that live with it are not far from the old road to the sea",
    "de": "das haus an dem fluss und die leute die mit ihm leben sind nicht weit von der alten strasse zum meer",
    "fr": "la maison de la riviere et les gens qui vivent avec elle ne sont pas loin de la vieille route de la mer",
}


def prose(lang: str, k: int, n: int = 120) -> str:
    words = PROSE[lang].split()
    return " ".join(words[(k * 7 + i * (k % 5 + 1)) % len(words)] + ("" if i % 9 else f"q{k}x{i}") for i in range(n))


def documents(spark, rows=None):
    """Rows (doc_id, text, lang, source); by default prose in three languages and the awkward cases."""
    if rows is None:
        rows = [(i, prose(lang, i), lang, "abc"[i % 3]) for i, lang in enumerate(["en", "de", "fr"] * 14)]
        rows += [
            (100, None, "en", "a"), (101, "", "en", None), (102, "   \n\t ", None, "a"), (103, "12 34 !!", "en", "b"), (None, "no id at all here", None, None),
            (104, "long " * 20_000 + "tail", "en", "c"), (105, "x" * 30_000, "de", "c"), (106, prose("en", 0), None, "a"), (106, prose("en", 0), None, "a"),
            (107, "Caf\u00e9 \u4f60\u597d \U0001F600 \u2581 mark", "fr", "zz"),
        ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", "b", "f") for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
