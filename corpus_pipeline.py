"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of ``documents``, and keep columns beyond those too.

Edge cases, the same in every stage:

* null texts are kept by every filter, for nothing can be held against them, and become
  no tokens; empty texts likewise;
* rows without doc_id are judged by their text;
* of rows that repeat a doc_id and its text one stays; rows of one doc_id with different
  texts are judged each by its own;
* ties: of a group of copies the smallest doc_id stays; a toxicity of exactly 0.5 goes;
* very long texts are read whole, a batch of bounded bytes at a time;
* an empty table passes through as an empty one, also through the model's training;
* columns whose names the stages use inside don't clash with theirs.

Near-duplicates are texts whose sets of five-word shingles have a similarity of 0.8 or
more; copies with more changes than that are other texts to it, and stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontaminate, minhash, secrets, toxicity
from marginalia.llm.common import Stage, small_batches, table


def _own(name: str) -> str:
    """A column name that no input has."""
    return f"_{name}_{uuid.uuid4().hex}"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5; fitted on the labels' training fold."""
    model = toxicity.train(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return docs.where(toxicity.scorer(model)("text") < 0.5)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five words, similarity 0.8): the one of the smallest doc_id.

    Rows are judged by doc_id and text.  Rows without doc_id, and further texts of a
    doc_id, come after all others of their group, by a hash; of rows equal in doc_id and
    text one stays.  Rows without doc_id and without words all stay.
    """
    key, mark, first = _own("id"), _own("mark"), _own("first")
    few = lambda df: F.broadcast(df) if df.count() <= minhash.BROADCAST_IDS else df
    stage = Stage(spark, "copies")
    rows = docs.withColumn(mark, F.xxhash64("text"))
    texts = rows.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(key)).agg(F.min(mark).alias(first), F.max(mark).alias("last"))
    several = stage.put(texts.where(F.col(first) < F.col("last")).drop("last"), "several")
    # one bit less than a long, above the ids in use; a row that meets an id there is still told apart by its text
    later = F.shiftrightunsigned(F.xxhash64("doc_id", mark), 2) + (1 << 62)
    rows = rows.withColumn(key, F.col("doc_id").cast("long")).join(few(several), key, "left")
    rows = rows.withColumn(key, F.when(F.col(key).isNull() | (F.col(mark) != F.col(first)), later).otherwise(F.col(key))).drop(first)
    found = minhash.near_duplicates(rows.select(key, "text"), id_col=key, marked=True)
    found = found.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), "kept")
    bare = rows.where(F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(key, mark).distinct()
    ids = found.groupBy(key, mark).agg(F.count("*").alias("n"), F.max("kept").alias("stays")).where("n > 1 or not stays").join(bare, [key, mark], "left_anti")
    ids = stage.put(ids, "ids")
    gone, repeated = ids.where("not stays").select(key, mark), ids.where("stays").select(key, mark)
    left = rows.join(few(gone), [key, mark], "left_anti")
    if repeated.isEmpty():
        return left.select(docs.columns)
    repeated = few(repeated)
    once = left.join(repeated, [key, mark], "left_semi").dropDuplicates([key, "text"])
    return left.join(repeated, [key, mark], "left_anti").select(docs.columns).union(once.select(docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget, each judged by its own text, whatever its doc_id."""
    mark, hashed = _own("mark"), F.xxhash64("text")
    leaks = decontaminate.find_leaks(docs.select(hashed.alias("mark"), "text"), table(spark, sf_dir, "benchmark"), id_col="mark")
    leaks = Stage(spark, "leaks").put(leaks.select(F.col("doc_id").alias(mark)).distinct(), "marks")
    leaks = F.broadcast(leaks) if leaks.count() <= minhash.BROADCAST_IDS else leaks
    marked = docs.withColumn(mark, F.when(F.col("text").isNotNull(), hashed))
    return marked.join(leaks, mark, "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of secrets replaced by ``[secret]`` and n_chars counted anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: the training shards' rows."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokenized),
]

#: SQL can't express the fitted classifier or the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder."""
    small_batches(spark)
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = stage.put(out, name)
    raise ValueError("no stages")
