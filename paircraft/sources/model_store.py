"""Fitted stages kept by the content that they were fitted on.

A stage's key is a digest of its class and params and of the training rows: an
order-free fingerprint, added up in one aggregation. ``load_or_fit`` reads the
stage of that key if it is there and whole, and fits and keeps it otherwise. A
stage is written beside its place and renamed when whole, so a reader never
meets a half-written one, and of two writers the first one's copy stands.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """Row count and sums of two hashes of all columns, whatever the order of
    rows: equal rows repeated count as often as they are there."""
    cols = sorted(df.columns)
    a = F.xxhash64(*cols).cast("decimal(38,0)")
    b = F.xxhash64(F.lit(1), *reversed(cols)).cast("decimal(38,0)")
    n, x, y = df.agg(F.count(F.lit(1)), F.sum(a), F.sum(b)).first()
    return f"{n}:{x}:{y}:{','.join(cols)}"


def key(estimator: Estimator, df: DataFrame) -> str:
    params = {p.name: v for p, v in estimator.extractParamMap().items()}
    text = json.dumps([type(estimator).__name__, params, fingerprint(df)], sort_keys=True, default=str)
    return f"{type(estimator).__name__}-{hashlib.sha1(text.encode()).hexdigest()[:16]}"


def load_or_fit(estimator: Estimator, df: DataFrame, model_class: type[Model], store: str, fit: Callable[[], Model] | None = None) -> Model:
    """The stage fitted on ``df``, from ``store`` where it is there. ``fit``
    fits it otherwise, on what ``df`` stands for by content keys."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(f"{store}/{key(estimator, df)}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        beside = path(f"{store}/_writing-{uuid.uuid4().hex}")
        (estimator.fit(df) if fit is None else fit()).write().save(beside.toString())
        if fs.exists(place) or not fs.rename(beside, place):
            fs.delete(beside, True)  # another writer was first
    return model_class.load(place.toString())
