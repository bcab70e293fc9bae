"""Query of the benchmark decontamination."""

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import table
from newsloom.llm.decontam import find_overlaps


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_spaced_seeds": op8_spaced_seeds}
SQLS = {}
