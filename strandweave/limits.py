"""A limit on the time that a part of a run may take."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two looks for jobs to cancel once a limit has passed.
AGAIN = 0.2


class TimeLimitError(Exception):
    """The part took longer than its limit."""


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancels all jobs that the part starts, once it has taken that long, and raises TimeLimitError.

    Jobs bear a tag of the part's own, so others of the session go on.  As a part is many jobs, the timer cancels again
    and again until the part ends.  A part that ends without an error stands, however long it took.
    """
    sc, tag = spark.sparkContext, f"limit-{uuid.uuid4().hex}"
    over, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            over.set()
            while not done.wait(AGAIN):
                sc.cancelJobsWithTag(tag)

    timer = threading.Thread(target=watch, name=tag, daemon=True)
    sc.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as error:
        if over.is_set():
            raise TimeLimitError(f"more than {seconds:g} seconds") from error
        raise
    finally:
        done.set()
        timer.join()
        sc.removeJobTag(tag)
