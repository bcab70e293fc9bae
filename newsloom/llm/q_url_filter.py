"""Query of the URL filter."""

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import table
from newsloom.llm.url_filter import Rule, judge_urls

RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


QUERIES = {"op6_url_filter": op6_url_filter}
SQLS = {}
