"""User-defined SQL metrics: a query result melted into labelled samples."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import scalars as S

_SAMPLE_TYPES = {"collected_at": "timestamp", "source_database": "string", "context": "string", "metric_name": "string",
                 "metric_help": "string", "metric_type": "string", "value": "double", "labels": "map<string,string>"}


@dataclass(frozen=True)
class MetricDefinition:
    context: str
    metrics_desc: dict[str, str]
    request: str = ""
    labels: tuple[str, ...] = ()
    metrics_type: dict[str, str] = field(default_factory=dict)
    metrics_buckets: dict[str, dict[str, str]] = field(default_factory=dict)
    field_to_append: str = ""
    databases: tuple[str, ...] | None = None
    ignore_zero_result: bool = False
    scrape_interval: str = ""
    query_timeout: str = ""

    def normalised(self) -> MetricDefinition:
        """Lower-case every identifier: result columns are read by lower-case name."""
        return replace(
            self,
            metrics_desc={k.lower(): v for k, v in self.metrics_desc.items()},
            metrics_type={k.lower(): v for k, v in self.metrics_type.items()},
            metrics_buckets={
                k.lower(): {f.lower(): b for f, b in v.items()} for k, v in self.metrics_buckets.items()
            },
            labels=tuple(label.lower() for label in self.labels),
            field_to_append=self.field_to_append.lower(),
        )

    @property
    def id(self) -> str:
        return "_".join([self.context, *sorted(k.lower() for k in self.metrics_desc)])

    @property
    def label_names(self) -> list[str]:
        """Declared labels without the one that is appended to the name."""
        return [label for label in self.labels if label != self.field_to_append]

    def enabled_for(self, database: str) -> bool:
        return self.databases is None or database in self.databases


def enabled_for(definitions: DataFrame, database: Column) -> DataFrame:
    """Definitions that run on ``database``: no list means all, an empty list none."""
    return definitions.where(F.col("databases").isNull() | F.array_contains("databases", database))


def label_names(labels: Column, field_to_append: Column) -> Column:
    return F.array_remove(labels, field_to_append)


def as_text_rows(df: DataFrame) -> DataFrame:
    """A query result as text: lower-case names, NULL written as its marker."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(S.NIL)).alias(c.lower()) for c in df.columns])


def text_result(df: DataFrame) -> DataFrame:
    """Like :func:`as_text_rows`, but the snapshot columns keep their types."""
    keep = ["source_database", "collected_at"]
    return df.select(*[
        F.col(c).alias(c.lower()) if c.lower() in keep
        else F.coalesce(F.col(c).cast("string"), F.lit(S.NIL)).alias(c.lower())
        for c in df.columns
    ])


def constant_labels(databases: DataFrame, label_name: str = "database") -> DataFrame:
    """Constant labels of every database.

    ``databases``: source_database and its configured ``labels`` (map or NULL).  Every
    label known anywhere in the fleet is present, empty unless the database sets it;
    the name label comes next and own labels override both.
    """
    names = databases.select(F.explode(F.map_keys("labels")).alias("name")).agg(
        F.sort_array(F.collect_set("name")).alias("_names")
    ).scalar()
    own = F.coalesce("labels", F.create_map().cast(T.MapType(T.StringType(), T.StringType())))
    named = F.create_map(F.lit(label_name), F.col("source_database"))
    everywhere = F.array_distinct(F.concat("_names", F.array(F.lit(label_name))))
    value = lambda n: F.struct(n.alias("key"), F.coalesce(own[n], named[n], F.lit("")).alias("value"))
    return databases.withColumn("_names", names).select(
        "source_database", F.map_from_entries(F.transform(everywhere, value)).alias("const_labels")
    )


def duplicate_labels(const_names: Column, labels: Column) -> Column:
    """True when a declared label repeats a constant one; such a metric yields nothing."""
    return F.coalesce(F.arrays_overlap(const_names, labels), F.lit(False))


def melt_metrics(rows: DataFrame, definition: MetricDefinition, const_labels: DataFrame | None = None) -> DataFrame:
    """Samples of one metric definition.

    ``rows`` is a text result with source_database and collected_at.  A declared value
    column the result lacks is skipped, a value that is no number drops that sample,
    and a declared label the result lacks is empty.
    """
    d = definition.normalised()
    declared = F.array(*[F.lit(n) for n in d.label_names]).cast("array<string>")
    if const_labels is not None:
        # The clash of label names is decided once per database, not per row.
        per_database = const_labels.withColumn("_clash", duplicate_labels(F.map_keys("const_labels"), declared))
        rows = rows.join(per_database, "source_database", "left").where(~F.coalesce("_clash", F.lit(False)))

    def text(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit("")

    labels = F.create_map(*[x for n in d.label_names for x in (F.lit(n), text(n))]).cast(
        T.MapType(T.StringType(), T.StringType()))
    if const_labels is not None:
        labels = F.when(F.col("const_labels").isNull(), labels).otherwise(F.map_concat("const_labels", labels))
    present = [m for m in d.metrics_desc if m in rows.columns]
    if not present:
        return rows.select(*[F.lit(None).cast(t).alias(n) for n, t in _SAMPLE_TYPES.items()]).limit(0)
    melted = [
        c for i, m in enumerate(present)
        for c in (F.lit(m), F.lit(d.metrics_desc[m]), F.lit(d.metrics_type.get(m, "").lower() or "gauge"),
                  F.col(f"_value_{i}"))
    ]
    # Values are parsed step by step below the generator, so that each cast is done once.
    rows = rows.withColumns({f"_text_{i}": S.trim_space(F.col(m)) for i, m in enumerate(present)})
    rows = rows.withColumns({f"_number_{i}": F.col(f"_text_{i}").try_cast("double") for i in range(len(present))})
    rows = rows.withColumns({
        f"_value_{i}": F.when(F.col(m) == S.NIL, F.lit(0.0)).otherwise(
            S.checked_float(F.col(f"_text_{i}"), F.col(f"_number_{i}")))
        for i, m in enumerate(present)
    })
    name = S.clean_name(text(d.field_to_append)) if d.field_to_append else F.lit(None)
    samples = rows.select(
        "collected_at", "source_database", name.alias("_name"), labels.alias("labels"),
        F.stack(F.lit(len(present)), *melted).alias("_metric", "metric_help", "metric_type", "value"),
    )
    return samples.select(
        "collected_at", "source_database", F.lit(d.context).alias("context"),
        (F.col("_name") if d.field_to_append else F.col("_metric")).alias("metric_name"), "metric_help", "metric_type",
        "value", "labels",
    ).where(F.col("value").isNotNull())


def rejected_values(rows: DataFrame, definition: MetricDefinition) -> DataFrame:
    """How many values of every metric were no number."""
    d = definition.normalised()
    present = [m for m in d.metrics_desc if m in rows.columns]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("text")) for m in present])
    return (
        rows.select("source_database", F.explode(pairs).alias("_m"))
        .where(S.parse_metric_value(F.col("_m.text")).isNull())
        .groupBy("source_database", F.col("_m.metric").alias("metric_name"))
        .agg(F.count(F.lit(1)).alias("rejected"))
    )


def zero_results(databases: DataFrame, samples: DataFrame, definition: MetricDefinition) -> DataFrame:
    """Databases for which a metric unexpectedly gave no sample."""
    if definition.ignore_zero_result:
        return databases.select("source_database").limit(0)
    seen = samples.select("source_database").distinct()
    return databases.select("source_database").distinct().join(seen, "source_database", "left_anti")


def run_metric(spark: SparkSession, definition: MetricDefinition, database: str | None = None,
               as_of: Column | None = None, const_labels: DataFrame | None = None) -> DataFrame:
    """Run the SQL of a metric over the registered raw views and melt its result.

    A result without source_database belongs to ``database``, or to the only database the
    metric is enabled for; without either the request must select source_database.
    """
    if not definition.request:
        raise ValueError(f"metric {definition.context} has no request")
    if not definition.metrics_desc:
        raise ValueError(f"metric {definition.context} declares no metrics")
    result = spark.sql(definition.request)
    names = [c.lower() for c in result.columns]
    if "source_database" not in names:
        if database is None and len(definition.databases or ()) == 1:
            database = definition.databases[0]
        if database is None:
            raise ValueError(f"metric {definition.context} names no database: select source_database or give one")
        result = result.withColumn("source_database", F.lit(database))
    if definition.databases is not None:
        result = result.where(F.col("source_database").isin(list(definition.databases)))
    if "collected_at" not in names:
        result = result.withColumn("collected_at", as_of)
    return melt_metrics(text_result(result), definition, const_labels)
