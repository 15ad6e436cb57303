"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all but
the last keep the columns of documents. `run` writes every stage's rows to the shared
checkpoint folder and reads them again for the next one, so a lost executor costs a
stage's tasks and never the stages before. What a stage staged on its way, and the rows of the
stage before, are deleted then.

1. language_id: documents stay whose language is identified: one of the learned
   languages, with an expected share of at least `LEAST_SHARE` of their words, so that
   short and code-switched texts with a leading language stay too. The model is learned
   from the rows that the stage is given.
2. near_duplicates: of rows that near-duplicate links connect, the one with the smallest
   id stays (a null id after all others; of equal ids, the first text). Rows are told
   apart by their texts, so ids may repeat or be null.
3. substring_dedup: passages of 50 words or more that also stand in a document with a
   smaller id are cut; a text that loses words becomes its kept words joined by a
   space, and a document that loses all of them goes.
4. decontaminate: documents that hold a window of a benchmark item go.
5. pack: what is left, packed into sequences of 4096 tokens.

The first stage sets the session's Arrow batches to about 1.5 MB, for those after it too:
executors keep what the largest batches took, in the JVM and in Python workers.

Rows with a null id have no identity that stage 3 could cite: it neither cuts them nor
cuts others by them. Every stage takes an empty table and returns one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.decontaminate import decontaminate
from quarry.llm.frames import delete, free_name, new_path, read, scratch, small_batches, staged
from quarry.llm.jaccard_join import members
from quarry.llm.language_id import identify, learn
from quarry.llm.packing import pack, tokenizer_path
from quarry.llm.substring_dedup import substring_dedup
from quarry.operators import prefilter

LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = learn(docs, "doc_id", "text", "lang")
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    return identify(docs, model).filter((F.col(pred) != "und") & (F.col(score) >= LEAST_SHARE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which rows stay is settled on (id, text hash, component); texts move only of rows that
    have a partner. All others are told apart in their scan, by a broadcast filter of the
    partners' text hashes (8 MB at most), and never shuffled; the few that pass it by chance
    are kept by the exact join."""
    key, id_, hash_, component, place = (free_name(docs, n) for n in ("key", "partner_id", "partner_key", "component", "place"))
    tagged = docs.withColumn(key, F.xxhash64("text"))
    known, named = members(tagged.select(F.struct(F.col("doc_id").alias("id"), F.col(key).alias("key")).alias("doc"), "text"), "doc")
    sizes = named.groupBy("component").agg(F.sum("copies").alias("rows")).filter("rows > 1")
    classes = named.join(sizes, "component").select("class", F.col("component").alias(component))
    partners = known.join(classes, "class").select(F.col("doc.id").alias(id_), F.col("doc.key").alias(hash_), component)
    partners = staged(partners.distinct())
    least = partners.groupBy(component).agg(F.min(id_).alias("least"))  # null only if no row has an id
    firsts = staged(partners.join(least, component).filter(F.col(id_).eqNullSafe(F.col("least"))).drop("least"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(hash_))

    near = prefilter.may_match(tagged, key, partners, hash_)
    # no anti join: the optimizer moves one below the filter's join, and all texts are shuffled
    passed = near.join(partners, same, "left").filter(F.col(hash_).isNull()).select(*tagged.columns)
    alone = prefilter.cannot_match(tagged, key, partners, hash_).unionByName(passed)
    # rows of one component with its smallest id, most often one: the first by its text
    held = prefilter.may_match(tagged, key, firsts, hash_).join(firsts, same)
    order = Window.partitionBy(component).orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    first = held.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return alone.select(*docs.columns).unionByName(first.select(*docs.columns))


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]  # as one column, whatever their names
    out = substring_dedup(docs.select("doc_id", "text", F.struct(*rest).alias("row")))
    out = out.filter("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), remove="documents")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, "doc_id", "text", tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", cut_substrings),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]
#: Learned labels, set similarity and tokenizer ids can't be said in SQL: tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        with scratch(spark):  # what the stage staged goes once its rows are written
            docs = staged(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
