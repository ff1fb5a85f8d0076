"""Histories and ledgers as a caller, or many callers, may see them."""

from pyspark.sql import DataFrame, functions as F

from seriesforge.functions import policy
from seriesforge.model import PUBLISHED, REPORTER
from seriesforge.sources.staging import stage


def govern(history: DataFrame, groups) -> DataFrame:
    """Rows filtered, then values masked. Later filters see only what the caller sees."""
    visible = history.filter(policy.row_filter(groups))
    return visible.withColumn("OBS_VALUE", policy.masked_value(groups))


def govern_ledger(ledger: DataFrame, groups) -> DataFrame:
    return ledger.filter(policy.ledger_filter(groups))


def _profiles(memberships: DataFrame) -> DataFrame:
    """Each principal with the sorted set of its groups as one text. The set is bounded by the
    number of groups that exist."""
    groups = F.array_sort(F.collect_set(policy.known_group(F.col("group"))))
    return memberships.groupBy("principal").agg(F.array_join(groups, ",").alias("profile"))


def personas(memberships: DataFrame) -> DataFrame:
    """Label and quarantine entitlement per principal; `memberships` is (principal, group).

    A row with a NULL group stands for a principal without membership.
    """
    groups = F.split("profile", ",")
    submitter = F.array_min(F.filter(groups, lambda g: g.startswith(policy.SUBMITTER)))
    has = lambda g: F.array_contains(groups, g)
    label = (
        F.when(has(policy.ADMIN), policy.ADMIN)
        .when(submitter.isNotNull(), submitter)
        .when(has(policy.RESEARCHER), policy.RESEARCHER)
        .when(has(policy.PUBLIC), policy.PUBLIC)
        .otherwise("none")
    )
    return _profiles(memberships).select(
        "principal",
        label.alias("persona"),
        (has(policy.ADMIN) | submitter.isNotNull()).alias("may_see_quarantine"),
    )


def visible_counts(history: DataFrame, memberships: DataFrame) -> DataFrame:
    """Visible, current and masked rows per principal, for any number of principals.

    The history is first reduced to cells (country, published, flag, current), and principals
    to their distinct group sets. A cell lists the groups that open it, so cells and group sets
    meet in an equality join on the group name instead of comparing each with each.
    """
    country = F.lower(F.coalesce(F.col(REPORTER), F.lit("")))
    cells = history.groupBy(
        country.alias("country"),
        (F.upper(F.coalesce("BATCH_STATUS", F.lit(""))) == PUBLISHED).alias("published"),
        F.upper(F.coalesce("OBS_CONF", F.lit(""))).alias("conf"),
        F.coalesce(F.col("IS_CURRENT"), F.lit(False)).alias("current"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count("OBS_VALUE").alias("valued"))
    cells = stage(cells, "cells")

    principals = stage(_profiles(memberships), "profiles")
    grants = principals.select("profile").distinct().select(
        "profile", F.explode(F.split("profile", ",")).alias("group")
    )
    # A submitter group opens its own country in full and, like `public`, what is free elsewhere.
    tokens = F.array(
        F.struct(F.col("group").alias("token"), F.col("group").isin(policy.ADMIN).alias("unmasks")),
        F.struct(F.lit(policy.PUBLIC).alias("token"), F.lit(False).alias("unmasks")),
    )
    own = F.array(F.struct(F.col("group").alias("token"), F.lit(True).alias("unmasks")))
    is_submitter = F.col("group").startswith(policy.SUBMITTER)
    held = grants.select(
        "profile",
        F.inline(
            F.when(is_submitter, F.concat(own, F.slice(tokens, 2, 1))).otherwise(F.slice(tokens, 1, 1))
        ),
    )
    opened_by = F.array_compact(
        F.array(
            F.lit(policy.ADMIN),
            F.when(F.col("published"), F.lit(policy.RESEARCHER)),
            F.when(F.col("published") & (F.col("conf") == "F"), F.lit(policy.PUBLIC)),
            F.concat(F.lit(policy.SUBMITTER), F.col("country")),
        )
    )
    opened = cells.select("*", F.explode(opened_by).alias("token"))
    seen = held.join(opened, "token").groupBy(
        "profile", "country", "published", "conf", "current", "n", "valued"
    ).agg(F.bool_or("unmasks").alias("unmasks"))
    restricted = F.col("conf").isin("C", "N") & ~F.col("unmasks")
    totals = seen.groupBy("profile").agg(
        F.sum("n").alias("visible"),
        F.sum(F.when(F.col("current"), F.col("n")).otherwise(0)).alias("current"),
        F.sum(F.when(restricted, F.col("valued")).otherwise(0)).alias("masked"),
    )
    zero = F.lit(0).cast("bigint")
    return principals.join(totals, "profile", "left").select(
        "principal",
        *[F.coalesce(c, zero).alias(f"{c}_rows") for c in ("visible", "current", "masked")],
    )
