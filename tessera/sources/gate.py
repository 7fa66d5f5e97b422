"""The best score so far, kept so that of two runs that beat it at the same time one has to beat the other."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def best(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(number, entry) of the last entry; (0, {}) if there is none."""
    fs, path = _files(spark, folder)
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()] if fs.exists(path) else []
    if not numbers:
        return 0, {}
    at = max(numbers)
    # an entry is named when it is whole: see ``beats``
    return at, json.loads(spark.read.text(f"{folder}/{at}", wholetext=True).first()[0])


def beats(spark: SparkSession, folder: str, score: float, more: dict | None = None) -> bool:
    """Makes ``score`` the best if it is above the best so far, and says whether it is.

    Entries are numbered files that are never replaced. A run that wants the next number claims it by creating its folder ``claim-N``,
    which one run alone can do, and renames its entry to N. Who finds the number claimed waits for the entry and compares again.
    """
    import time
    import uuid

    fs, path = _files(spark, folder)
    fs.mkdirs(path)
    name = lambda x: spark._jvm.org.apache.hadoop.fs.Path(path, x)
    for _ in range(600):
        at, entry = best(spark, folder)
        if entry and entry["score"] >= score:
            return False
        try:
            claimed = fs.create(name(f"claim-{at + 1}"), False)  # fails if it is there
        except Py4JJavaError:
            time.sleep(0.1)
            continue
        claimed.close()
        draft = name(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"score": score, **(more or {})}).encode()))
        out.close()
        return bool(fs.rename(draft, name(str(at + 1))))
    raise RuntimeError(f"{folder} holds a claim whose run has died: remove the claim with the highest number")
