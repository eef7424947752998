"""Fitted objects on disk (S12): feature operators, classifiers, whole pipelines and ensembles.

An object of the library is its class and its attributes as JSON; the pyspark.ml models in it are
saved by their own writers and the tables (nearest neighbours' rows) as Parquet, next to it.
Loading makes only objects of the library's operators and of pyspark.ml.
"""

from __future__ import annotations

import importlib
import json

import numpy as np
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession

LIBRARY, ML = "tessera.operators.", "pyspark.ml."


def save_fitted(spark: SparkSession, path: str, fitted) -> None:
    """``fitted``: an operator or model, or lists, tuples and dicts of such and of plain values."""
    places = iter(range(1 << 30))

    def put(v):
        if v is None or isinstance(v, (bool, int, float, str)) and not isinstance(v, np.generic):
            return v
        if isinstance(v, np.generic):
            return v.item()
        if isinstance(v, list):
            return [put(x) for x in v]
        if isinstance(v, tuple):
            return {"tuple": [put(x) for x in v]}
        if isinstance(v, dict):
            return {"dict": [[put(k), put(x)] for k, x in v.items()]}
        if isinstance(v, np.ndarray):
            return {"array": v.tolist(), "dtype": str(v.dtype)}
        name = f"{type(v).__module__}:{type(v).__qualname__}"
        if isinstance(v, DataFrame):
            place = f"tables/{next(places)}"
            v.write.mode("overwrite").parquet(f"{path}/{place}")
            return {"table": place, "schema": v.schema.jsonValue()}
        if isinstance(v, MLWritable):
            place = f"ml/{next(places)}"
            v.write().overwrite().save(f"{path}/{place}")
            return {"ml": name, "at": place}
        if name.startswith(LIBRARY) and hasattr(v, "__dict__"):
            return {"object": name, "attributes": {k: put(x) for k, x in vars(v).items()}}
        raise TypeError(f"can't save {name}")

    text = json.dumps(put(fitted))
    spark.createDataFrame([(text,)], "fitted string").coalesce(1).write.mode("overwrite").json(f"{path}/fitted")


def load_fitted(spark: SparkSession, path: str):
    from pyspark.sql.types import StructType

    def kind(name: str, prefix: str):
        module, _, attribute = name.partition(":")
        if not module.startswith(prefix) or "." in attribute:
            raise ValueError(f"can't load {name}")
        found = getattr(importlib.import_module(module), attribute)
        if not isinstance(found, type):
            raise ValueError(f"can't load {name}")
        return found

    def get(v):
        if isinstance(v, list):
            return [get(x) for x in v]
        if not isinstance(v, dict):
            return v
        if "tuple" in v:
            return tuple(get(x) for x in v["tuple"])
        if "dict" in v:
            return {get(k): get(x) for k, x in v["dict"]}
        if "array" in v:
            return np.array(v["array"], dtype=v["dtype"])
        if "table" in v:
            return spark.read.schema(StructType.fromJson(v["schema"])).parquet(f"{path}/{v['table']}")
        if "ml" in v:
            found = kind(v["ml"], ML)
            if not issubclass(found, MLReadable):
                raise ValueError(f"can't load {v['ml']}")
            return found.load(f"{path}/{v['at']}")
        found = kind(v["object"], LIBRARY)
        out = found.__new__(found)
        out.__dict__.update({k: get(x) for k, x in v["attributes"].items()})
        return out

    return get(json.loads(spark.read.schema("fitted string").json(f"{path}/fitted").first()["fitted"]))
