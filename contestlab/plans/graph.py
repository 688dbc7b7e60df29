"""The derived views as a declarative pipeline: materialized views whose order follows from what they read.

define_views() declares the views with Spark's own `pyspark.pipelines` decorators, so any graph registry can take them. ViewGraph
is a registry that runs them from any session: dry_run() analyses every flow without a job and finds what it
reads; run() writes each view as soon as those that it reads are stored, several at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import pipelines
from pyspark.pipelines.flow import Flow
from pyspark.pipelines.graph_element_registry import GraphElementRegistry, graph_element_registration_context
from pyspark.pipelines.output import MaterializedView, Output
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from contestlab.model import ContestData

from .views import BY_UNIT, ORDER, Views, store


_reader: ContextVar[Callable[[str], DataFrame] | None] = ContextVar("reader", default=None)


def read(name: str) -> DataFrame:
    """Another view of the graph, for flows: as it is stored, or in a dry run an empty table of its schema."""
    reader = _reader.get()
    if reader is None:
        raise GraphError(f"{name} is read outside of a run")
    return reader(name)


class GraphError(ValueError):
    """The graph can't be run; the message says why."""


@dataclass
class Node:
    """What a dry run finds out about a view."""

    reads: list[str] = field(default_factory=list)
    schema: StructType | None = None


class ViewGraph(GraphElementRegistry):
    """Materialized views by name, and the flow that fills each. Those that are clustered by columns come in so many partitions by them, and are stored as buckets."""

    def __init__(self, spark: SparkSession, buckets: int = 0):
        self.spark, self.buckets, self.outputs, self.flows = spark, buckets, {}, {}

    def register_output(self, output: Output) -> None:
        if not isinstance(output, MaterializedView):
            raise GraphError(f"{output.name} is no materialized view")
        if output.name in self.outputs:
            raise GraphError(f"{output.name} is defined twice")
        self.outputs[output.name] = output

    def register_flow(self, flow: Flow) -> None:
        if flow.target in self.flows:
            raise GraphError(f"{flow.target} has two flows")
        self.flows[flow.target] = flow

    def register_sql(self, sql_text: str, file_path: Path) -> None:
        raise GraphError("views are defined in Python here")

    @contextmanager
    def defining(self):
        """Decorators of pyspark.pipelines that run inside add to this graph."""
        with graph_element_registration_context(self):
            yield self

    def _build(self, name: str, reader: Callable[[str], DataFrame]) -> DataFrame:
        """One flow's frame; what it reads of the graph comes from reader."""
        token = _reader.set(reader)
        try:
            return self.flows[name].func()
        finally:
            _reader.reset(token)

    def dry_run(self) -> dict[str, Node]:
        """Analyse all flows, without running any: what each view reads, and its schema. Views come after those that they read."""
        for name in self.outputs:
            if name not in self.flows:
                raise GraphError(f"{name} has no flow")
        done: dict[str, Node] = {}
        path: list[str] = []

        def visit(name: str) -> Node:
            if name in path:
                raise GraphError(f"views read each other in a ring: {' -> '.join([*path[path.index(name) :], name])}")
            if name not in self.flows:
                raise GraphError(f"{path[-1]} reads {name}, which isn't defined")
            if name not in done:
                path.append(name)
                node = Node()

                def read(other: str) -> DataFrame:
                    if other not in node.reads:
                        node.reads.append(other)
                    return self.spark.createDataFrame([], visit(other).schema)

                node.schema = self._build(name, read).schema
                path.pop()
                done[name] = node
            return done[name]

        for name in self.flows:
            visit(name)
        return done

    def run(self, path: str, names: Sequence[str] | None = None, at_once: int = 4) -> dict[str, float]:
        """Write the views (or those named, and all that these read) under path; returns seconds by view.

        A view starts when all that it reads is stored; one that fails keeps those that read it from running, and its error is raised
        when the others are done.
        """
        plan = self.dry_run()
        needed: set[str] = set()

        def need(name: str) -> None:
            if name not in needed:
                needed.add(name)
                for other in plan[name].reads:
                    need(other)

        for name in names or plan:
            if name not in plan:
                raise GraphError(f"{name} isn't defined")
            need(name)
        took: dict[str, float] = {}
        stored: dict[str, DataFrame] = {}

        def write(name: str) -> str:
            began = time.monotonic()
            output = self.outputs[name]
            stored[name] = store(self._build(name, stored.__getitem__), f"{path}/{name}", self.buckets if output.cluster_by else 0, output.cluster_by or (), output.format or "parquet", output.partition_cols or ())
            took[name] = time.monotonic() - began
            return name

        waiting, running, error = [n for n in plan if n in needed], {}, None
        with ThreadPoolExecutor(at_once) as pool:
            while waiting or running:
                for name in [n for n in waiting if all(r in took for r in plan[n].reads)]:
                    waiting.remove(name)
                    running[pool.submit(write, name)] = name
                if not running:
                    break
                ended, _ = wait(running, return_when=FIRST_COMPLETED)
                for future in ended:
                    del running[future]
                    error = error or future.exception()
        if error:
            raise error
        return took


class _Linked(Views):
    """Views of which each reads the others from the graph."""

    lie_by_unit = property(lambda self: self.data.unit_tasks > 0)


def _linked(name: str) -> property:
    return property(lambda self: read(name))


for _name in ORDER:
    setattr(_Linked, _name, _linked(_name))


def define_views(spark: SparkSession, data: ContestData, **options) -> ViewGraph:
    """All derived views of data as a graph."""
    graph = ViewGraph(spark, data.unit_tasks)
    with graph.defining():
        for name in ORDER:
            view = vars(Views)[name]
            pipelines.materialized_view(name=name, comment=view.__doc__, cluster_by=["unit_id"] if name in BY_UNIT else None)(_flow(view.func, data, options))
    return graph


def _flow(view: Callable[[Views], DataFrame], data: ContestData, options: dict) -> Callable[[], DataFrame]:
    return lambda: view(_Linked(data, **options))
