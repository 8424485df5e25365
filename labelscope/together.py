"""Spark jobs of one kind, started side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import TypeVar
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

A = TypeVar("A")
B = TypeVar("B")


def together(spark: SparkSession, run: Callable[[A], B], items: Iterable[A], at_once: int) -> list[B]:
    """``run`` of every item, ``at_once`` of them at a time, in the order of the items.

    All jobs belong to one group. When one item fails, those not yet started are
    dropped, the jobs of the others are cancelled, and the failure is raised.
    """
    context = spark.sparkContext
    group = f"together-{uuid4().hex}"

    @inheritable_thread_target(spark)
    def grouped(item: A) -> B:
        context.setJobGroup(group, getattr(run, "__name__", "run"), interruptOnCancel=True)
        return run(item)

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        started = [pool.submit(grouped, item) for item in items]
        done, waiting = wait(started, return_when=FIRST_EXCEPTION)
        failed = [f for f in done if f.exception()]
        if failed:
            for f in waiting:
                f.cancel()
            context.cancelJobGroup(group)
            raise failed[0].exception()
    return [f.result() for f in started]
