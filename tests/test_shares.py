"""Mail is dealt out evenly before it is routed, however it is stored."""
from pyspark.sql import functions as F

from countersign import schemas
from countersign.plans.ingest import tagged_mail
from countersign.session import checkpointed


def test_mail_of_one_file_is_routed_by_many_tasks(spark):
    raw = F.lit("From: a@b.example\r\nSubject: x\r\n\r\nbody").cast("binary")
    ids = F.when(F.col("id") % 5 > 0, F.lit("m").cast("string"))  # repeated and null ids share no task
    given = {"mail_id": ids, "raw": raw, "received_at": F.lit("2024-01-01").cast("timestamp")}
    mail = spark.range(800).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.MAIL.fields])
    tagged = tagged_mail(checkpointed(mail.coalesce(1)))
    shares = [r["count"] for r in tagged.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(shares) == 800
    assert len(shares) >= spark.sparkContext.defaultParallelism
    assert max(shares) <= 4 * 800 / len(shares)
