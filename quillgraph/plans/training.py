"""What has to be trained before what: metrics with the metrics they are made of, in an order that holds for all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame


@dataclass
class Metric:
    """A metric by name: ``needs`` are metrics it is trained on, ``fit`` takes the gold rows and these, trained, by name."""

    name: str
    fit: Callable[[DataFrame, dict], object]
    needs: tuple[str, ...] = field(default=())


def order(metrics: dict[str, Metric], wanted: list[str]) -> list[str]:
    """The wanted metrics and all they need, each after what it needs; equal in rank by name."""
    graph, todo = {}, list(wanted)
    while todo:
        name = todo.pop()
        if name not in graph:
            graph[name] = metrics[name].needs
            todo.extend(metrics[name].needs)
    sorter, out = TopologicalSorter(graph), []
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"metrics need one another: {' '.join(e.args[1])}") from e
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def build(metrics: dict[str, Metric], wanted: list[str], gold: DataFrame, have: dict | None = None) -> dict:
    """Trained metrics by name; what is in ``have`` is taken as it is and not trained again."""
    trained = dict(have or {})
    for name in order(metrics, wanted):
        if name not in trained:
            trained[name] = metrics[name].fit(gold, {n: trained[n] for n in metrics[name].needs})
    return trained
