"""Counts, rates and costs over the three tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftdesk.constants import (
    FINISHED_STATUSES,
    OVERRIDABLE_FIELDS,
    SEVERITIES,
    STATUSES,
    URGENT_SEVERITIES,
)
from siftdesk.functions.numbers import guarded_ratio, round_float
from siftdesk.operators.relations import earliest_per
from siftdesk.sources.tables import inline_values

_RANKED = {"severity": SEVERITIES, "status": STATUSES}


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, as ``label`` and ``count``."""
    return df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("count"))


def rank_of(column: Column, domain: tuple[str, ...]) -> Column:
    """Place of a label in its domain; null for unknown labels."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in domain]), column), F.lit(0))


def order_by_rank(df: DataFrame, field: str, column: str = "label") -> DataFrame:
    """By the domain's order, unknown labels last."""
    return df.orderBy(rank_of(F.col(column), _RANKED[field]).asc_nulls_last(), F.col(column))


def order_by_count(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("count"), F.asc_nulls_last("label"))


def enrichments_by_severity(enrichments: DataFrame) -> DataFrame:
    return order_by_rank(count_by(enrichments, "severity"), "severity")


def enrichments_by_category(enrichments: DataFrame) -> DataFrame:
    return order_by_count(count_by(enrichments, "category"))


def tickets_by_status(tickets: DataFrame) -> DataFrame:
    return order_by_rank(count_by(tickets, "status"), "status")


def actions_by_type(actions: DataFrame) -> DataFrame:
    return order_by_count(count_by(actions, "action_type"))


def _is_override() -> Column:
    return F.col("action_type") == "override"


def _total_cost() -> Column:
    return F.coalesce(F.sum(F.col("estimated_cost").cast("decimal(28,6)")), F.lit(0))


def _mean(total: Column, rows: Column) -> Column:
    """An exact decimal mean; null without rows. 16 places leave no ties behind the sixth."""
    return total.cast("decimal(38,16)") / F.nullif(rows, F.lit(0)).cast("decimal(18,0)")


def dashboard_summary(
    tickets: DataFrame, enrichments: DataFrame, actions: DataFrame, accuracy: str = "actions"
) -> DataFrame:
    """The dashboard's figures in one row; each table is scanned once.

    ``accuracy='actions'`` takes every override row off the rate, so two on
    one ticket count twice and the rate can turn negative; ``'tickets'``
    counts overridden tickets.
    """
    if accuracy == "actions":
        overridden = F.count_if(_is_override())
    elif accuracy == "tickets":
        overridden = F.count_distinct(F.when(_is_override(), F.col("ticket_id")))
    else:
        raise ValueError("accuracy must be 'actions' or 'tickets'")

    enriched = enrichments.agg(
        F.struct(
            F.count("*").alias("n"),
            F.count_if(F.col("severity").isin(*URGENT_SEVERITIES)).alias("urgent"),
            _total_cost().alias("cost"),
        ).alias("e")
    ).scalar()
    overrides = actions.agg(overridden.alias("n")).scalar()

    counted = tickets.agg(
        F.count("*").alias("total_tickets"),
        F.count_if(~F.col("status").isin(*FINISHED_STATUSES)).alias("open_tickets"),
    ).select("*", enriched.alias("e"), overrides.alias("overridden"))
    return summary_row(counted)


def summary_row(counted: DataFrame) -> DataFrame:
    """The dashboard's figures from total_tickets, open_tickets, overridden and
    ``e`` (n, urgent and cost of the enrichments)."""
    n = F.col("e.n")
    rate = guarded_ratio((n - F.col("overridden")).cast("double"), n, F.lit(0.0))
    # Divided as decimals; only the result is a double, rounded like one.
    mean = F.coalesce(_mean(F.col("e.cost"), n).cast("double"), F.lit(0.0))
    return counted.select(
        "total_tickets",
        "open_tickets",
        F.col("e.urgent").alias("critical_high_tickets"),
        round_float(rate, 3).alias("ai_accuracy_rate"),
        round_float(mean, 6).alias("avg_enrichment_cost"),
        round_float(F.col("e.cost").cast("double"), 6).alias("total_enrichment_cost"),
        n.alias("total_enriched"),
    )


def overrides_by_field(actions: DataFrame) -> DataFrame:
    """Override rows per overridable field that has any."""
    mine = actions.where(_is_override() & F.col("override_field").isin(*OVERRIDABLE_FIELDS))
    return mine.groupBy(F.col("override_field").alias("field")).agg(
        F.count("*").alias("override_count")
    )


def override_breakdown(enrichments: DataFrame, actions: DataFrame) -> DataFrame:
    """Per overridable field: overrides, enrichments and the share left alone."""
    fields = inline_values(actions.sparkSession, "field", OVERRIDABLE_FIELDS)
    total = enrichments.agg(F.count("*").alias("n")).scalar()
    # At most one row per overridable field, so the broadcast side has three.
    joined = fields.join(F.broadcast(overrides_by_field(actions)), "field", "left").select(
        "field",
        F.coalesce("override_count", F.lit(0)).alias("override_count"),
        total.alias("total_enriched"),
    )
    share = F.col("override_count").cast("decimal(20,0)") / F.nullif(
        F.col("total_enriched"), F.lit(0)
    ).cast("decimal(20,0)")
    rate = F.when(F.col("total_enriched") == 0, F.lit(0.0)).otherwise(
        F.round(F.lit(1) - share, 3).cast("double")
    )
    return joined.select("*", rate.alias("accuracy_rate")).orderBy("field")


def dashboard_charts(
    tickets: DataFrame, enrichments: DataFrame, actions: DataFrame
) -> dict[str, DataFrame]:
    return {
        "by_severity": enrichments_by_severity(enrichments),
        "by_category": enrichments_by_category(enrichments),
        "by_status": tickets_by_status(tickets),
        "override_breakdown": override_breakdown(enrichments, actions),
    }


def cost_summary(enrichments: DataFrame) -> DataFrame:
    """Enrichments, their cost and mean cost to four places; null costs without rows."""
    cost = F.sum(F.col("estimated_cost").cast("decimal(28,6)"))
    sums = enrichments.agg(F.count("*").alias("total"), cost.alias("cost"))
    mean = _mean(F.col("cost"), F.col("total"))
    return sums.select(
        "total",
        F.round("cost", 4).cast("double").alias("total_cost"),
        F.round(mean, 4).cast("double").alias("avg_cost"),
    )


def run_report(attempts: DataFrame) -> DataFrame:
    """Outcome of a batch run; ``attempts`` has ``succeeded`` and ``estimated_cost``."""
    paid = F.when(F.col("succeeded"), F.col("estimated_cost").cast("decimal(28,6)"))
    sums = attempts.agg(
        F.count("*").alias("created"),
        F.count_if("succeeded").alias("enriched"),
        F.count_if(~F.col("succeeded")).alias("failed"),
        F.coalesce(F.sum(paid), F.lit(0)).cast("double").alias("cost"),
    )
    return sums.select(
        "created",
        "enriched",
        "failed",
        round_float(F.col("cost"), 4).alias("total_cost"),
        round_float(F.col("cost") / F.greatest("enriched", F.lit(1)), 4).alias("cost_per_ticket"),
    )


def evaluate(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected beside predicted labels, with a flag for each match.

    A ticket without a prediction stays, with ``predicted`` and both flags false.
    """
    found = predicted.select("ticket_id", "severity", "category", F.lit(True).alias("_found"))
    pairs = expected.select("ticket_id", "expected_severity", "expected_category").join(
        found, "ticket_id", "left"
    )
    flags = {
        "predicted": F.coalesce("_found", F.lit(False)),
        "severity_match": F.coalesce(F.col("severity") == F.col("expected_severity"), F.lit(False)),
        "category_match": F.coalesce(F.col("category") == F.col("expected_category"), F.lit(False)),
    }
    return pairs.withColumns(flags).drop("_found")


def match_rates(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(
        F.count("*").alias("evaluated"),
        F.count_if("predicted").alias("predicted"),
        F.avg(F.col("severity_match").cast("double")).alias("severity_rate"),
        F.avg(F.col("category_match").cast("double")).alias("category_rate"),
    )


def dedupe_enrichments(enrichments: DataFrame) -> DataFrame:
    """The earliest enrichment of every ticket."""
    return earliest_per(enrichments, "ticket_id", ["created_at", "id"])
