"""An update run: stages with their share of the progress, and failures that end it. What a stage writes it publishes (``streaming.keyed``)."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# The stages of a run and the percentage at which each begins.
STAGES = (("info", 0.0), ("publication", 33.3), ("project", 66.6), ("merge", 95.0))


def run_update(steps: dict[str, Callable[[], DataFrame | None]], emit: Callable[[float, str], None], timeout: float | None = None) -> dict[str, object]:
    """Runs the given steps in the order of STAGES; emits each one's start and the end. The first failure ends the run.

    timeout: seconds that a step may take; one that takes longer has failed, and its Spark jobs are interrupted."""
    done: dict[str, object] = {}
    for name, start in STAGES:
        if name in steps:
            emit(start, name)
            try:
                done[name] = _limited(steps[name], timeout)
            except Exception as error:
                return {"status": "failed", "stage": name, "error": str(error)[:180], "results": done}
    emit(100.0, "completed")
    return {"status": "completed", "stage": None, "error": None, "results": done}


def _limited(step: Callable[[], DataFrame | None], timeout: float | None) -> DataFrame | None:
    if timeout is None:
        return step()
    told: dict[str, object] = {}
    spark, tag = SparkSession.getActiveSession(), f"step-{uuid.uuid4().hex}"

    def run() -> None:
        try:
            if spark is not None:
                spark.addTag(tag)
            told["result"] = step()
        except Exception as error:  # handed to the caller's thread
            told["error"] = error

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(timeout)
    if thread.is_alive():
        if spark is not None:
            spark.interruptTag(tag)
        raise TimeoutError(f"no result after {timeout} s")
    if "error" in told:
        raise told["error"]  # type: ignore[misc]
    return told["result"]  # type: ignore[return-value]
