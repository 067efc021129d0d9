from pyspark.sql import functions as F

from strata.llm import decontaminate as decontamination
from strata.llm.decontaminate import decontaminate
from strata.llm.html_text import main_text
from strata.llm.language import language_id
from strata.llm.licenses import licenses
from strata.llm.near_dedup import near_dedup
from strata.llm.neighbours import nearest
from strata.llm.packing import pack
from strata.llm.pii import pii
from strata.llm.quality import quality
from strata.llm.token_files import token_files


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {
    "op1_main_text": lambda s, d: main_text(table(s, d, "pages")),
    "op2_token_files": lambda s, d: token_files(table(s, d, "documents"), tokenizer("word_bpe_49k.json")),
    "op3_language_id": lambda s, d: language_id(table(s, d, "documents")),
    "op4_near_dedup": lambda s, d: near_dedup(table(s, d, "documents"), 3, 85),
    "op5_decontaminate": lambda s, d: decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
    "op6_best_fit_packing": lambda s, d: pack(table(s, d, "documents"), tokenizer("byte_bpe_50k.json")),
    "op7_pii": lambda s, d: pii(table(s, d, "documents")),
    "op8_licenses": lambda s, d: licenses(table(s, d, "documents")),
    "op9_nearest": lambda s, d: nearest(table(s, d, "embeddings"), F.col("vec_id") % 50 == 0),
    "op10_quality": lambda s, d: quality(table(s, d, "documents"), table(s, d, "labels")),
}
SQL = {"op5_decontaminate": decontamination.SQL}
