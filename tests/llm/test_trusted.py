"""op3 learns from every trusted document, however many there are."""

import math
import statistics

from pyspark.sql import functions as F

from labelscope.llm import quality_rules as q


def test_every_trusted_document_counts(spark):
    n = 25_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[
        F.concat(F.lit("w"), (F.xxhash64("id", F.lit(j)) % 7).cast("string")) for j in range(4)]).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 11 == 0).cast("int").alias("toxic"))
    assert q.trusted_ids(labels).count() == sum(i % 11 != 0 for i in range(n))
    rows = q.judge(docs, labels, max_threshold=10.0).select("doc.doc_id", "score", "threshold").collect()
    trusted = [r.score for r in rows if r.doc_id % 11]
    want = statistics.fmean(trusted) - 6.0 * statistics.pstdev(trusted)
    assert len(rows) == n and len(trusted) > 20_000
    assert all(math.isclose(r.threshold, want, abs_tol=2e-9) for r in rows)
