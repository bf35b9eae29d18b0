"""Small tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(30)) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 120).split()
    near = [*base[:60], "changed", *base[61:]]
    texts = {
        0: " ".join(base), 1: " ".join(near), 2: " ".join(base).upper(), 3: prose(3, 90), 4: None, 5: "", 6: "   \n\t ", 7: "word", 8: "word", 9: "two words",
        10: prose(4, 4000), 11: prose(4, 4000) + " end", 12: "naïve café 🙂 ＡＢ K", 13: prose(5, 60) + "\n" + prose(5, 60), 14: "a b c", 15: "a b c d",
    }
    out = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", len(t or "")) for i, t in texts.items()]
    out += [(0, texts[0], "en", "src0", len(texts[0]))]  # a repeated row
    out += [(None, texts[3], None, None, None)]  # no id
    return out


def documents(spark: SparkSession, extra: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    if extra:  # names that operators use themselves
        for c in ("score", "mark", "kept", "ids", "spans", "bands", "rep", "key", "grp", "hash", "words", "label", "distance"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def collected(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
