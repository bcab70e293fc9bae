"""Query of the language identification."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table
from newsloom.llm.langid import predict_language, train_prototypes


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict_language(docs, train_prototypes(docs.where(~held_out)))
    return found.select("doc_id", held_out, "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
SQLS = {}
