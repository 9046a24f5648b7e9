"""User metric definitions from TOML and YAML files."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetlens.operators.metrics import MetricDefinition

SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("metrics_desc", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics_type", T.MapType(T.StringType(), T.StringType())),
    T.StructField("field_to_append", T.StringType()),
    T.StructField("request", T.StringType()),
    T.StructField("databases", T.ArrayType(T.StringType())),
    T.StructField("ignore_zero_result", T.BooleanType()),
    T.StructField("scrape_interval", T.StringType()),
    T.StructField("query_timeout", T.StringType()),
])


def parse_definitions(text: str, toml: bool) -> list[MetricDefinition]:
    """Definitions of one file, identifiers in lower case."""
    if toml:
        entries = tomllib.loads(text).get("metric", [])
    else:
        import yaml

        document = yaml.safe_load(text) or {}
        entries = document.get("metrics", document.get("metric", []))
    return [_definition({str(k).lower(): v for k, v in e.items()}).normalised() for e in entries]


def _definition(entry: dict) -> MetricDefinition:
    databases = entry.get("databases")
    return MetricDefinition(
        context=entry.get("context", ""),
        labels=tuple(entry.get("labels") or ()),
        metrics_desc={str(k): str(v) for k, v in (entry.get("metricsdesc") or {}).items()},
        metrics_type={str(k): str(v) for k, v in (entry.get("metricstype") or {}).items()},
        metrics_buckets={
            str(k): {str(f): str(b) for f, b in v.items()} for k, v in (entry.get("metricsbuckets") or {}).items()
        },
        field_to_append=entry.get("fieldtoappend") or "",
        request=entry.get("request") or "",
        databases=None if databases is None else tuple(databases),
        ignore_zero_result=bool(entry.get("ignorezeroresult", False)),
        scrape_interval=str(entry.get("scrapeinterval") or ""),
        query_timeout=str(entry.get("querytimeout") or ""),
    )


def load_definitions(paths: Iterable[str], last_good: dict[str, MetricDefinition] | None = None,
                     ) -> dict[str, MetricDefinition]:
    """Definitions by id.  Later files and entries override earlier ones of the same id;
    blank paths are skipped.  With ``last_good`` a file that does not load keeps that set."""
    definitions: dict[str, MetricDefinition] = {}
    try:
        for path in paths:
            path = path.strip()
            if not path:
                continue
            with open(path, encoding="utf-8") as f:
                for d in parse_definitions(f.read(), path.endswith("toml")):
                    definitions[d.id] = d
    except Exception:
        if last_good is None:
            raise
        return last_good
    return definitions


def definitions_frame(spark: SparkSession, definitions: dict[str, MetricDefinition]) -> DataFrame:
    """The definitions as a DataFrame."""
    rows = [
        (d.id, d.context, list(d.labels), d.metrics_desc, d.metrics_type, d.field_to_append, d.request,
         None if d.databases is None else list(d.databases), d.ignore_zero_result, d.scrape_interval,
         d.query_timeout)
        for d in definitions.values()
    ]
    return spark.createDataFrame(rows, SCHEMA)
