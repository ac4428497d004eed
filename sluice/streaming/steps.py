"""A streaming flow fed step by step, as the batch stepper feeds a machine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from sluice.operators.flow import Flow
from sluice.operators.weights import weighted
from sluice.sources.folders import shared_folder
from sluice.streaming.processors import use_rocksdb


def stream_deltas(frames: Sequence[DataFrame], build: Callable[[Flow], Flow], partitions: int | None = None) -> DataFrame:
    """The signed rows that a flow gives for each of the frames, a micro-batch each, with the column ``step`` from 0.

    partitions: of the keyed state, where it isn't to be the session's number of shuffle partitions.  A frame is written by as
    many tasks as it has partitions, and each run of the stream takes the files that are new, so a
    frame is one micro-batch; the next run goes on from the checkpoint.  Deltas are written to the shared folder batch by batch; a repeated micro-batch
    overwrites its own.
    """
    spark = frames[0].sparkSession
    use_rocksdb(spark)
    base = shared_folder(spark, "steps")
    schema = frames[0].schema
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def run(step: int) -> None:
        def keep(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out/step={step}/batch={batch}")

        flow = weighted(build(Flow(spark.readStream.schema(schema).parquet(f"{base}/in"))).df)
        flow.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()

    try:
        if partitions:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for step, frame in enumerate(frames):
            frame.write.mode("append").parquet(f"{base}/in")
            run(step)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/step=*").drop("batch")
