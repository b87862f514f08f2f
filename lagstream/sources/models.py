"""Models on storage: arrays and settings as one JSON row of a Parquet table, checked by version on load."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass
from importlib import import_module

import numpy as np
from pyspark.sql import SparkSession

VERSION = 1


def _pack(v):
    if isinstance(v, np.ndarray):
        if np.iscomplexobj(v):
            return {"__complex__": [v.real.tolist(), v.imag.tolist()]}
        return {"__array__": v.tolist(), "dtype": str(v.dtype)}
    if isinstance(v, np.generic):
        return v.item()
    if isinstance(v, (list, tuple)):
        return [_pack(x) for x in v]
    if isinstance(v, dict):
        return {str(k): _pack(x) for k, x in v.items()}
    if v is None or isinstance(v, (str, int, float, bool)):
        return v
    state = {f.name: getattr(v, f.name) for f in fields(v)} if is_dataclass(v) else dict(vars(v))
    return {"__class__": f"{type(v).__module__}:{type(v).__qualname__}", "state": {k: _pack(x) for k, x in state.items() if k != "_cached"}}


def _unpack(v):
    if isinstance(v, list):
        return [_unpack(x) for x in v]
    if not isinstance(v, dict):
        return v
    if "__array__" in v:
        return np.array(v["__array__"], dtype=v["dtype"])
    if "__complex__" in v:
        return np.array(v["__complex__"][0]) + 1j * np.array(v["__complex__"][1])
    if "__class__" in v:
        module, name = v["__class__"].split(":")
        if not module.startswith("lagstream."):
            raise ValueError(f"not a model of this library: {module}")
        kind = getattr(import_module(module), name)
        obj = kind.__new__(kind)
        obj.__dict__.update({k: _unpack(x) for k, x in v["state"].items()})
        return obj
    return {k: _unpack(x) for k, x in v.items()}


def save_model(spark: SparkSession, model, path: str) -> None:
    spark.createDataFrame([(VERSION, json.dumps(_pack(model)))], "version int, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str):
    row = spark.read.parquet(path).first()
    if row["version"] != VERSION:
        raise ValueError(f"model was saved by version {row['version']}, this is {VERSION}")
    return _unpack(json.loads(row["model"]))
