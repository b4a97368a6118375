import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables to a data folder: folder(documents=[(doc_id, text), ...]) -> its path."""

    def write(documents=(), labels=(), pages=()):
        docs = [(*r, *[None, None, None][len(r) - 2 :]) if len(r) < 5 else r for r in documents]
        spark.createDataFrame(docs, DOCS).withColumnRenamed("n_chars", "n_chars").selectExpr(
            "*", "1 AS fp", "2 AS shard", "3 AS n_words"
        ).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(pages), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        return str(tmp_path)

    return write
