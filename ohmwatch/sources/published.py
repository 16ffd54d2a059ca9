"""Sets of tables that are published as one: readers see a whole version or the one before.

Each version has a folder of its own.  Its line in the manifest names its tables with their row counts and schemas and
is written last, by a job that shows its one file only when it commits.  A version without a line does not exist; one
whose tables do not match its line is passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, types as T

#: What Spark raises for folders and files that are missing or damaged.
UNREADABLE = (PySparkException, Py4JJavaError)


@dataclass(frozen=True)
class Version:
    name: str
    tables: dict[str, DataFrame]
    facts: dict


def _lines(spark: SparkSession, path: str) -> list[dict]:
    """Manifest lines, latest first; one line for each version ever published."""
    try:
        rows = spark.read.text(f"{path}/manifest").collect()
    except UNREADABLE:
        return []
    return sorted((json.loads(r["value"]) for r in rows), key=lambda line: (line["number"], line["name"]), reverse=True)


def publish(tables: Mapping[str, DataFrame], path: str, facts: Mapping | None = None) -> str:
    """Write the tables as a new version and return its name.

    A job that breaks off leaves a folder that nobody reads.  Of two writers at once, both versions stay whole and the
    greater name of the later number is read.
    """
    spark = next(iter(tables.values())).sparkSession
    earlier = _lines(spark, path)
    number = 1 + (earlier[0]["number"] if earlier else 0)
    name = f"{number:08d}-{uuid.uuid4().hex}"
    described = {}
    for part, df in tables.items():
        target = f"{path}/versions/{name}/{part}"
        df.write.parquet(target)
        described[part] = {"schema": df.schema.jsonValue(), "rows": spark.read.schema(df.schema).parquet(target).count()}
    line = json.dumps({"number": number, "name": name, "tables": described, "facts": dict(facts or {})})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")
    return name


def latest(spark: SparkSession, path: str) -> Version | None:
    """The latest version whose tables are all there with the rows and columns of its line; none if there is no such."""
    for line in _lines(spark, path):
        try:
            tables = {}
            for part, found in line["tables"].items():
                schema = T.StructType.fromJson(found["schema"])
                tables[part] = spark.read.schema(schema).parquet(f"{path}/versions/{line['name']}/{part}")
                if tables[part].count() != found["rows"]:  # reads all footers: damaged files fail here
                    raise ValueError(part)
            return Version(line["name"], tables, line["facts"])
        except (*UNREADABLE, ValueError):
            continue
    return None
