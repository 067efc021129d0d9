"""Documents to packed training sequences, stage by stage.

Language ID drops texts without a language; of near copies one stays;
documents that hold a window of a benchmark item, or all of a shorter item, go;
personal data is replaced by its kind; the rest is packed. Every stage is
written to the shared folder as Parquet and read again. Null texts have no language and go at the first stage. Rows are
judged by keys of their own, so those without a doc_id stay like any others.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.decontaminate import found_in, keyed
from strata.llm.language import held_out, learn, predict
from strata.llm.near_dedup import near_dedup
from strata.llm.packing import pack
from strata.llm.pii import redact
from strata.llm.registry import table, tokenizer
from strata.llm.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a key of each row, stored so that it stays."""
    return stored(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def _by_row(own: DataFrame) -> DataFrame:
    return own.select(F.col("row").alias("doc_id"), "text")


def _keep(own: DataFrame, rows: DataFrame) -> DataFrame:
    return own.join(rows.select(F.col("doc_id").alias("row")), "row", "left_semi").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return predict(docs.select(*COLUMNS), learn(docs, ~held_out())).filter("lang_pred <> 'und'").select(*COLUMNS)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Keys rise with doc_id, rows without one last: of a group the smallest doc_id stays.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    own = _numbered(docs.repartitionByRange(*order).sortWithinPartitions(*order))
    return _keep(own, near_dedup(_by_row(own)).filter("kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = keyed(docs.select(*COLUMNS))
    hit = found_in(own.select("k1", "k2", "text"), table(spark, sf_dir, "benchmark"))
    return own.join(hit.select("k1", "k2"), ["k1", "k2"], "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("near_dedup", dedup), ("decontamination", decontamination), ("pii", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
