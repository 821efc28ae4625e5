"""The corpus pipeline: STAGES applied one after another to documents.

Every stage but the last returns the columns of documents. Stages carry whole rows through their
operators, so null or repeated ids lose nothing.

Nulls and edge cases: a null text is scored as an empty one, is a duplicate of no other text by five-word
shingles (but of other texts without words by fingerprint), becomes empty in ``repeats`` and is its end id
alone in ``packing``; rows with equal ids and texts are near duplicates, of which one stays; a null source
is a source of its own; texts of any length are read whole; documents may have further columns with any
names; an empty table gives empty tables, and no stage fails on it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from tesserine.llm import mixing, packing, quality, repeats, similar, simhash
from tesserine.llm.common import drop_scratch, scratch, table
from tesserine.llm.textnum import remainder
from tesserine.sources.scratch import listed

#: Not SQL: the stages score, fingerprint, encode and pack with trained or hashed models.
ORACLE_SQL = None


#: Rows of an Arrow batch: texts may be long, and executors hold a batch twice for each task.
ROWS_OF_BATCH = "1000"
#: Scratch tables of the stage before.
_left: list = []


def pipeline_stage(stage):
    """``stage`` with small batches between Spark and its Python workers. The result of a stage has to be
    written before the next one is called, as the scratch tables that it reads are dropped then."""

    @wraps(stage)
    def run_stage(spark, docs, sf_dir):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_OF_BATCH)
        drop_scratch(*_left)
        _left.clear()
        with listed(_left):
            return stage(spark, docs, sf_dir)

    return run_stage


@pipeline_stage
def good_quality(spark, docs, sf_dir):
    """Documents that the quality classifier scores 0.5 or more. It learns from the labels that
    the operator's own query learns from."""
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    return quality.score(docs, model, keep=tuple(docs.columns)).filter("score >= 0.5").select("row.*")


def one_of_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates, that with the least doc_id."""
    return simhash.one_of_each(docs)


@pipeline_stage
def one_of_similar(spark, docs, sf_dir):
    """One document of each group of near duplicates, as above, and of these one of each group whose
    five-word shingles have similarity 0.8 or more."""
    return similar.one_of_similar(one_of_near_duplicates(spark, docs, sf_dir))


@pipeline_stage
def without_repeats(spark, docs, sf_dir):
    """All documents, without the bytes of strings that a document with a smaller doc_id
    holds; a null text becomes empty."""
    rest = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = repeats.remove_repeats(docs, keep=rest, whole_characters=True)
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cut.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


@pipeline_stage
def mixed_sources(spark, docs, sf_dir):
    """As many copies of each document as the mix takes."""
    mix = mixing.mix(docs, keep=tuple(docs.columns))
    return mix.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


@pipeline_stage
def packed(spark, docs, sf_dir):
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_similar),
    ("repeats", without_repeats),
    ("mixing", mixed_sources),
    ("packing", packed),
]


def run(spark, sf_dir):
    """Apply every stage to documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, scratch(stage(spark, docs, sf_dir), name)
        if k:
            drop_scratch(before)
    drop_scratch(*_left)
    _left.clear()
    return docs
