"""The toxicity threshold means the same whether or not the sample of a label is capped."""

from pyspark.sql import functions as F
from quern.llm import toxicity


def test_capped_sample_keeps_the_prior(spark):
    rows = [(k, f"plain words {k}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    admitted = labels.where(toxicity.crc_mod("doc_id", 4) != 2)
    prior = admitted.agg(F.avg("toxic")).first()[0]
    for rows in (2000, 60):
        p = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, rows)).agg(F.avg("_score")).first()[0]
        assert abs(p - prior) < 0.03, (rows, p, prior)
