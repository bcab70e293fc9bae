"""Query of the near-duplicates."""

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import table
from newsloom.llm.minhash import near_duplicates


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_prob_minhash": op1_prob_minhash}
SQLS = {}
