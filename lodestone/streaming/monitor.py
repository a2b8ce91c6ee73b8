"""The same checks on a stream: each micro-batch is one dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.checker import DataQualityChecker
from lodestone.plans.config import Config
from lodestone.plans.results import QualityReport


def monitor(stream: DataFrame, config: Config, handle: Callable[[QualityReport, int], None], checkpoint: str, *, references: dict | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Check every micro-batch and hand its report and number to ``handle``, which should overwrite by number: after a
    failure the last batch is checked again."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # several passes over one batch; the source is read once
        try:
            handle(DataQualityChecker(batch, config, references=references).run(), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
