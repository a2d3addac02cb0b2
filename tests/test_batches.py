"""What Python workers are given at once."""

import pyarrow as pa
from pyspark.sql import functions as F


def test_batches_for_python_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    rows = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 1_000_000).alias("text"))
    found = [row["size"] for row in rows.mapInArrow(sizes, "size long").collect()]
    assert sum(found) >= 40_000_000 and max(found) < 16_000_000
