"""Query of the quality classifier."""

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import table
from newsloom.llm.kneser_ney import classify


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return classify(table(spark, sf_dir, "documents"), trusted)


QUERIES = {"op3_kneser_ney": op3_kneser_ney}
SQLS = {}
