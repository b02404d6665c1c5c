"""Saving and loading fitted objects: a JSON tree, with tables and Spark models beside it.

Handlers, preprocessors and models are dataclasses of settings and small states. Tables they hold are written as
Parquet, Spark models in their own format, and functions over arrays as bytes. Nothing that belongs to a session is
stored, so what was saved on one cluster loads on another. A folder is trusted like code: load only your own.
"""

from __future__ import annotations

import base64
import dataclasses
import importlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0].rstrip("\n")


def save(obj: Any, path: str, spark: SparkSession) -> str:
    """Write an object under a path that does not exist yet; gives the path."""
    from pyspark import cloudpickle
    from pyspark.ml.base import Transformer

    from lodewright.operators.models import Fitted

    count = 0

    def place() -> str:
        nonlocal count
        count += 1
        return f"{count:04d}"

    def tree(x: Any) -> Any:
        if x is None or isinstance(x, bool | int | float | str):
            return x
        if isinstance(x, DataFrame):
            name = place()
            x.write.parquet(f"{path}/{name}")
            return {"$": "table", "at": name}
        if isinstance(x, Transformer):
            name = place()
            x.write().save(f"{path}/{name}")
            return {"$": "model", "at": name, "class": f"{type(x).__module__}:{type(x).__name__}"}
        if isinstance(x, Fitted):
            if x.kind == "own":
                raise TypeError(f"model {x.name} was registered by the user and cannot be saved")
            return {"$": "fitted", "name": x.name, "cols": list(x.cols), "classification": x.classification, "kind": x.kind, "state": tree(x.state)}
        if dataclasses.is_dataclass(x) and not isinstance(x, type):
            return {"$": "object", "class": f"{type(x).__module__}:{type(x).__name__}", "fields": {f.name: tree(getattr(x, f.name)) for f in dataclasses.fields(x)}}
        if isinstance(x, tuple):
            return {"$": "tuple", "items": [tree(v) for v in x]}
        if isinstance(x, list):
            return [tree(v) for v in x]
        if isinstance(x, dict):
            return {"$": "dict", "items": [[tree(k), tree(v)] for k, v in x.items()]}
        return {"$": "bytes", "data": base64.b64encode(cloudpickle.dumps(x)).decode()}

    _write_text(spark, f"{path}/state", json.dumps(tree(obj)))
    return path


def load(path: str, spark: SparkSession) -> Any:
    """What `save` wrote."""
    from pyspark import cloudpickle

    from lodewright.operators.models import REBUILD

    def named(text: str) -> type:
        module, name = text.split(":")
        return getattr(importlib.import_module(module), name)

    def made(x: Any) -> Any:
        if isinstance(x, list):
            return [made(v) for v in x]
        if not isinstance(x, dict):
            return x
        kind = x["$"]
        if kind == "table":
            return spark.read.parquet(f"{path}/{x['at']}")
        if kind == "model":
            return named(x["class"]).load(f"{path}/{x['at']}")
        if kind == "fitted":
            return REBUILD[x["kind"]](x["name"], x["cols"], x["classification"], made(x["state"]))
        if kind == "object":
            return named(x["class"])(**{k: made(v) for k, v in x["fields"].items()})
        if kind == "tuple":
            return tuple(made(v) for v in x["items"])
        if kind == "dict":
            return {made(k): made(v) for k, v in x["items"]}
        return cloudpickle.loads(base64.b64decode(x["data"]))

    return made(json.loads(_read_text(spark, f"{path}/state")))
