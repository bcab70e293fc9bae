"""Query of the packing operator."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import table
from newsloom.llm.packing import pack


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_nnls_packing": op7_nnls_packing}
SQLS = {}
