"""op10_kd_sharding over all documents. No SQL: DuckDB has no crc32."""

from pyspark.sql import functions as F

from recollect.llm.kd_sharding import shard_by_kd_tree
from recollect.llm.shared import table


def op10_kd_sharding(spark, sf_dir):
    shards = shard_by_kd_tree(table(spark, sf_dir, "documents"), n_shards=16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_kd_sharding": op10_kd_sharding}
ORACLE_SQL: dict = {}
