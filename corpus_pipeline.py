"""From raw documents to packed sequences: each stage is one operator of ``axonspark.llm``.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps with
their own columns, but for the last, which returns the pieces of the sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonspark.llm import jaccard, mixing, packing, pii, quality
from axonspark.llm.names import apart, unused
from axonspark.llm.scratch import Scratch

#: The classifier, the draw of copies and the packer can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, by ``labels``.

    Null and empty texts weigh nothing, so they stay; rows with the same id and
    text share their fate; without labels all stay; an empty table stays empty.
    """
    own, back = apart(docs, ["log_weight", "keep"])
    return back(quality.classify(own, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id, null ids last.

    Rows count by id and text: different texts of one id are different
    documents, and rows without an id take part like all others. Texts without
    words are copies of nothing; only repeats under the same id go.
    """
    key = unused([*docs.columns, "n_shingles", "component_id"], "key")
    absent = F.col("doc_id").isNull()
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    keyed = docs.withColumn(key, F.struct(absent.alias("absent"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), digest.alias("digest")))
    found = jaccard.ngram_jaccard(keyed, id=key)
    gone = found.where(f"{key} <> component_id").select(key).distinct()
    left = keyed.join(gone, key, "left_anti")
    again = found.where(f"{key} = component_id and (n_shingles > 0 or not {key}.absent)").groupBy(key).count().where("count > 1").select(key)
    if not again.isEmpty():
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.select(*[f"`{c}`" for c in docs.columns])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, and n_chars of the new texts.

    A null text becomes the empty one; repeated rows each stay; an empty table
    stays empty; columns called like the operator's keep their values.
    """
    own, back = apart(docs, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return back(pii.find(own, clean=True)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most.

    Documents without words add nothing and come as the fit takes them; null
    sources are one source, the last; repeated rows are documents of their own;
    an empty table stays empty.
    """
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is the end token alone; repeated rows are documents of
    their own; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("personal data", redact_personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
