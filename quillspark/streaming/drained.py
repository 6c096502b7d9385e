"""Running a stream over what there is, to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from quillspark.operators.lineage import shared_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(rows: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the streaming ``operator`` makes of ``rows`` by the time all of them have come and its timers have fired.

    Rows, state and result are tables in the shared folder; a run that is cut off leaves a result that nobody reads.
    """
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/live-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set(STATE_STORE, ROCKS_DB)
    found = operator(session.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    query = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/out")
