"""Knowledge tables: aliases, versions, state at a time, reply rules.

`knowledge` has columns id, kind, key, value, weight, active.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord import specs
from concord.functions.lookup import look_up_in
from concord.functions.values import normalise_label, party_norm

KNOWLEDGE_SCHEMA = "id long, kind string, key string, value string, weight double, active boolean"


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short fixed table as plan literals: unlike `createDataFrame` its size is known to the optimizer."""
    names = [part.split()[0] for part in schema.split(", ")]
    structs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    table = spark.range(1).select(F.inline(structs.cast(f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in schema.split(', '))}>>")))
    return table


def seed_knowledge(spark: SparkSession) -> DataFrame:
    """The entries every installation starts with."""
    return inline_table(spark, [(i + 1, kind, key, value, None, True) for i, (kind, key, value) in enumerate(specs.SEED_KNOWLEDGE)], KNOWLEDGE_SCHEMA)


def _normal(kind: str, text: Column, is_key: bool) -> Column:
    if kind == "party_alias":
        return party_norm(text)
    if kind == "label_alias":
        return normalise_label(text) if is_key else text
    if kind in ("port_alias", "carrier_prefix"):
        return F.upper(F.trim(text)) if is_key or kind == "port_alias" else text
    return text


def active_aliases(knowledge: DataFrame, kind: str) -> DataFrame:
    """B1: (key, value) of one kind, normalised like the data, one row per key: the last entry wins."""
    items = knowledge.where((F.col("kind") == kind) & F.coalesce("active", F.lit(True)))
    return (
        items.select(_normal(kind, F.col("key"), True).alias("key"), _normal(kind, F.col("value"), False).alias("value"), "id")
        .groupBy("key")
        .agg(F.max_by("value", "id").alias("value"))
    )


def resolve_alias(df: DataFrame, name: str, knowledge: DataFrame, kind: str, spread: str, out: str | None = None) -> DataFrame:
    """B1: replace a normalised column by its canonical value, one hop."""
    out = out or name
    found = look_up_in(df, F.col(name), active_aliases(knowledge, kind), "key", "value", "_alias", spread)
    return found.withColumn(out, F.coalesce("_alias", name)).drop("_alias")


def knowledge_version(knowledge: DataFrame) -> DataFrame:
    """B2: one digest of the active items, independent of their order.

    Two sums over per-item digests instead of one sorted list, so that no task has to hold the whole table.
    """
    item = F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in ("kind", "key", "value")]))

    def part(start: int) -> Column:
        return F.conv(F.substring(item, start, 8), 16, 10).cast("decimal(38,0)")

    return (
        knowledge.where(F.coalesce("active", F.lit(True)))
        .agg(F.count(F.lit(1)).alias("items"), F.sum(part(1)).alias("_a"), F.sum(part(9)).alias("_b"))
        .select("items", F.left(F.sha1(F.concat_ws(":", F.col("items"), F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))), F.lit(10)).alias("version"))
    )


def knowledge_as_of(history: DataFrame, at: Column) -> DataFrame:
    """The items as they stood at a time, from the change log (item_id, id, action, value, at)."""
    last = F.max_by(F.struct("action", "value", "at"), F.struct("at", "id")).alias("last")
    return (
        history.where(F.col("at") <= at)
        .groupBy("item_id")
        .agg(last)
        .where(F.col("last.action") != "remove")
        .select("item_id", F.col("last.value").alias("value"), F.col("last.at").alias("changed_at"))
    )


def reply_rules(knowledge: DataFrame) -> DataFrame:
    """(rule_id, status, line) of the active reply lines; status may be ALL."""
    return knowledge.where((F.col("kind") == "reply_rule") & F.coalesce("active", F.lit(True))).select(
        F.col("id").alias("rule_id"), F.upper("key").alias("status"), F.col("value").alias("line")
    )


def reply_rules_for(knowledge: DataFrame, status: str) -> DataFrame:
    return reply_rules(knowledge).where(F.col("status").isin(status, "ALL"))


def latest_examples(knowledge: DataFrame, n: int = 5) -> DataFrame:
    """The last n worked examples."""
    return knowledge.where((F.col("kind") == "example") & F.coalesce("active", F.lit(True))).orderBy(F.col("id").desc()).limit(n)
