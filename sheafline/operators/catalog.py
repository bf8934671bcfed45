"""Keyed matching of a catalog to its offers: canonical keys, winners, tiers, top-1, display order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import canonical_key, format_cost


def matched(catalog: DataFrame, offers: DataFrame, name: str, offer_name: str, keep: Column | None = None) -> DataFrame:
    """Catalog rows with the offers of the same canonical name (J1); ``keep`` filters offers before they move."""
    c = catalog.withColumn("match_key", canonical_key(F.col(name)))
    o = (offers if keep is None else offers.where(keep)).withColumn("match_key", canonical_key(F.col(offer_name)))
    clash = [x for x in o.columns if x in c.columns and x != "match_key"]
    for x in clash:
        o = o.withColumnRenamed(x, f"offer_{x}")
    return c.join(o, "match_key")


def winners(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in ``order``.

    One aggregate with a map-side combine: the minimum of a struct led by the order.
    """
    lead = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.struct("*").alias("row"))
    return rows.groupBy(*by).agg(F.min(lead).alias("w")).select("w.row.*")


def tier(first_party: Column, price: Column) -> Column:
    """First party before resellers, priced before free."""
    return F.when(first_party & (price > 0), 0).when(first_party, 1).when(price > 0, 2).otherwise(3)


def deduplicated(rows: DataFrame, name: str, first_party: str, price: str, size: str, order: str) -> DataFrame:
    """One row a canonical name: best tier, in priced tiers the cheaper, then the larger, then the earlier."""
    keyed = rows.withColumn("match_key", canonical_key(F.col(name)))
    t = tier(F.col(first_party), F.col(price))
    return winners(keyed, ["match_key"], [t, F.when(t.isin(0, 2), F.col(price)).otherwise(0.0), -F.col(size), F.col(order)])


def fitting(rows: DataFrame, needs: DataFrame, capacity: str, need: str) -> DataFrame:
    """Pairs of rows and needs that fit.

    Needs are few stated values: they are collected under a bound and tested against
    every row as an array, so neither side is shuffled.
    """
    stated = [r[0] for r in needs.select(need).distinct().limit(10_001).collect()]
    if len(stated) > 10_000:
        raise ValueError("more than 10000 needs")
    values = F.array(*(F.lit(v) for v in stated)) if stated else F.array().cast("array<bigint>")
    return rows.withColumn(need, F.explode(F.filter(values, lambda v: F.col(capacity) >= v)))


def cheapest(rows: DataFrame, by: Sequence[str], price: str, order: str) -> DataFrame:
    """The cheapest row of a group, the first of equals."""
    return winners(rows.where(F.col(price).isNotNull()), by, [F.col(price), F.col(order)])


def newest_first(rows: DataFrame, date: str, name: str) -> DataFrame:
    """Newest first, rows without a date last, names in dictionary order (O1)."""
    return rows.orderBy(F.col(date).desc_nulls_last(), F.collate(F.col(name), "UNICODE"), F.col(name))


def total_price(units_in: Column, units_out: Column | None, price_in: Column, price_out: Column, per: float = 1e6) -> Column:
    """Price of so many units in and out (C4); output defaults to a tenth of the input, rounded."""
    out = F.floor(units_in * 0.1 + 0.5) if units_out is None else F.coalesce(units_out, F.floor(units_in * 0.1 + 0.5))
    return units_in / per * price_in + out / per * price_out


def text_to_text(inputs: Column, outputs: Column) -> Column:
    """Whether a model reads and writes text."""
    return F.coalesce(F.array_contains(inputs, "text") & F.array_contains(outputs, "text"), F.lit(False))


def priced(*costs: Column) -> Column:
    """Whether any cost is above nothing."""
    out = F.lit(False)
    for c in costs:
        out = out | (F.coalesce(c, F.lit(0.0)) > 0)
    return out


def cost_table(models: DataFrame, tokens: int, output_ratio: float = 0.1) -> DataFrame:
    """``models`` with ``inputCost``, ``outputCost`` and ``totalCost`` of so many tokens in (C4)."""
    out = int(tokens * output_ratio + 0.5)
    a, b = F.lit(tokens / 1e6) * F.col("input_cost"), F.lit(out / 1e6) * F.col("output_cost")
    return models.withColumn("inputCost", a).withColumn("outputCost", b).withColumn("totalCost", a + b)


#: Keys a cost table can be sorted by, and their columns.
COST_KEYS = {"name": "name", "context": "context_limit", "inputCost": "inputCost", "outputCost": "outputCost", "totalCost": "totalCost"}


def by_cost(costs: DataFrame, key: str = "totalCost", descending: bool = False) -> DataFrame:
    """A cost table in order of one of its keys, equal rows by name (O3)."""
    c = F.collate(F.col("name"), "UNICODE") if key == "name" else F.col(COST_KEYS[key])
    return costs.orderBy(c.desc() if descending else c.asc(), "name")


def cost_lines(costs: DataFrame) -> DataFrame:
    """The columns of the exported cost table (K5): texts as the table shows them."""
    return costs.select(
        F.col("provider").alias("Provider"), F.col("name").alias("Model"), F.col("context_limit").alias("Context Limit"), format_cost(F.col("inputCost")).alias("Input Cost"),
        format_cost(F.col("outputCost")).alias("Output Cost"), format_cost(F.col("totalCost")).alias("Total Cost"),
    )


def write_costs(costs: DataFrame, path: str) -> None:
    """The cost table as CSV, fields quoted where they need it (K5); one file, as a catalog is small."""
    cost_lines(costs).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def default_pick(models: DataFrame, order: str, by: list[str] | None = None, wanted: str = "sonnet") -> DataFrame:
    """The first model whose name holds ``wanted``, or else the first."""
    return winners(models, by or [], [F.when(F.lower("name").contains(wanted), 0).otherwise(1), F.col(order)])


def explode_catalog(raw: DataFrame, providers: str = "providers") -> DataFrame:
    """Rows of a nested map of providers to maps of models."""
    one = raw.select(F.explode(providers).alias("provider_id", "provider"))
    return one.select("provider_id", F.col("provider.name").alias("provider_name"), F.explode("provider.models").alias("model_id", "model"))
