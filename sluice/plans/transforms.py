"""Runner of portable pipelines: a list of primitive transforms over named collections, as one lazy plan.

A step is (transform, inputs, outputs, arguments). There are six transforms, and any other is an error:

* ``read``: no input; ``source``, a frame or a function that gives one;
* ``flatten``: the bag union of all inputs;
* ``par_do``: ``fn(frame) -> frame`` over Arrow batches with ``schema``; with several outputs the frame has a column ``tag``
  that names each row's output; ``sides`` are views, passed to ``fn`` as rows by name;
* ``assign_windows``: ``ts``, ``length`` and, if sliding, ``slide``; adds ``window_end``;
* ``group_by_key``: ``keys`` and ``value``, to one row per key (and window, where there is one) with its values as an array;
* ``view``: a side input of at most ``limit`` rows, checked before it is taken to the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregate, compute, movement, windows


def run(spark: SparkSession, steps: list[tuple]) -> dict[str, DataFrame]:
    """The collections by name. Outputs of one ``par_do`` share a cached pass; see ``compute.release``."""
    made: dict = {}
    for transform, inputs, outputs, arguments in steps:
        if transform not in TRANSFORMS:
            raise NotImplementedError(f"no transform {transform}")
        missing = [i for i in inputs if i not in made]
        if missing:
            raise ValueError(f"{transform} needs {missing}, which no step before it gives")
        made |= TRANSFORMS[transform](made, [made[i] for i in inputs], outputs, **arguments)
    return {name: frame for name, frame in made.items() if isinstance(frame, DataFrame)}


def _read(_made, _frames, outputs, source):
    return {outputs[0]: source() if callable(source) else source}


def _flatten(_made, frames, outputs):
    return {outputs[0]: movement.union(*frames)}


def _par_do(made, frames, outputs, fn, schema, sides=()):
    views = {name: made[name].rows for name in sides}
    call = (lambda frame: fn(frame, **views)) if views else fn
    if len(outputs) == 1:
        return {outputs[0]: compute.map_pandas(frames[0], call, schema)}
    return compute.multi_output(frames[0], call, f"{schema}, tag string", outputs)


def _assign_windows(_made, frames, outputs, ts, length, slide=None):
    return {outputs[0]: windows.event_time(frames[0], ts, length, slide)}


def _group_by_key(_made, frames, outputs, keys, value, order=None):
    keys = [*keys, *(["window_end"] if "window_end" in frames[0].columns else [])]
    return {outputs[0]: aggregate.keyed_gather(frames[0], keys, value, order)}


def _view(_made, frames, outputs, limit=100_000):
    rows = frames[0].limit(limit + 1).toPandas()
    if len(rows) > limit:
        raise ValueError(f"a side input has at most {limit} rows")
    return {outputs[0]: View(rows)}


class View:
    """The rows of a side input."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows


TRANSFORMS = {"read": _read, "flatten": _flatten, "par_do": _par_do, "assign_windows": _assign_windows, "group_by_key": _group_by_key, "view": _view}
