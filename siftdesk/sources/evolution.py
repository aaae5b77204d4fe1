"""The one schema change of the enrichments table, both ways."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftdesk.schemas import ADDED_ENRICHMENT_COLUMNS


def upgrade_enrichments(df: DataFrame) -> DataFrame:
    """Add the usage columns, with their defaults on rows that lack them."""
    added = {}
    for name, (kind, default) in ADDED_ENRICHMENT_COLUMNS.items():
        blank = F.lit(default).cast(kind)
        if name in df.columns:
            added[name] = F.coalesce(F.col(name), blank).cast(kind)
        else:
            added[name] = blank
    return df.withColumns(added)


def downgrade_enrichments(df: DataFrame) -> DataFrame:
    return df.drop(*ADDED_ENRICHMENT_COLUMNS)


def union_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both schema versions as one table of the new one."""
    return upgrade_enrichments(old.unionByName(new, allowMissingColumns=True))
