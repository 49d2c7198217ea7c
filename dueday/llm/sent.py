"""Objects of this subpackage that tasks read."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


class Sent:
    """An object whose arguments are broadcast; each task builds the object again.

    Broadcast values name their classes, and executors need no copy of this subpackage, so only dicts,
    lists, numbers and arrays are broadcast. The class itself travels with the task, by value. What the
    object derives from its arguments is not sent.
    """

    def __init__(self, spark: SparkSession, kind: type, **arguments: Any):
        self.kind, self.arguments, self.built = kind, spark.sparkContext.broadcast(arguments), None

    @property
    def value(self) -> Any:
        if self.built is None:
            self.built = self.kind(**self.arguments.value)
        return self.built

    def destroy(self) -> None:
        self.arguments.destroy()
