"""Arrow batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

BYTES, KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS, ROWS_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df``, whose session now sends Python at most about 4 MB at once, or less if it was set so, or ``rows`` rows.

    A batch always holds whole rows, so one longer text makes a batch of its own.
    """
    conf = df.sparkSession.conf
    now = int(str(conf.get(KEY)).removesuffix("b").removesuffix("B"))
    if now <= 0 or now > BYTES:
        conf.set(KEY, str(BYTES))
    conf.set(ROWS_KEY, str(rows))
    return df
