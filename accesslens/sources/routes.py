"""Which (event source, region) pairs are collected, and their checkpoint key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Sources, the region of global ones, and fallback regions.
IAM, SIGN_IN, STS, SSO = "iam.amazonaws.com", "signin.amazonaws.com", "sts.amazonaws.com", "sso.amazonaws.com"
GLOBAL_REGION = "us-east-1"
FALLBACK_REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "ap-southeast-1"]


@dataclass(frozen=True)
class Routes:
    """Collection switches.  Regions apply to the regional source."""

    regions: list[str] = field(default_factory=lambda: list(FALLBACK_REGIONS))
    iam: bool = True
    sign_in: bool = True
    sts: bool = True
    sso: bool = True
    sso_region: str = GLOBAL_REGION

    def pairs(self) -> dict[str, list[str]]:
        chosen = {
            IAM: [GLOBAL_REGION] if self.iam else [],
            SIGN_IN: [GLOBAL_REGION] if self.sign_in else [],
            STS: sorted(set(self.regions)) if self.sts else [],
            SSO: sorted({GLOBAL_REGION, self.sso_region}) if self.sso else [],
        }
        return {source: regions for source, regions in chosen.items() if regions}


def is_collected(routes: Routes) -> Column:
    """True for rows of a collected pair."""
    keep = F.lit(False)
    for source, regions in routes.pairs().items():
        keep = keep | ((F.col("event_source") == source) & F.col("aws_region").isin(regions))
    return keep


def select_sources(df: DataFrame, routes: Routes) -> DataFrame:
    """Rows of collected pairs, as a plain predicate that reaches the scan."""
    return df.where(is_collected(routes))


def select_by_table(df: DataFrame, route_rows: DataFrame) -> DataFrame:
    """Rows of the pairs in a routes table."""
    pair = ["event_source", "aws_region"]
    return df.join(route_rows.select(pair), pair, "left_semi")


def route_table(spark: SparkSession, routes: Routes) -> DataFrame:
    """The pairs as a table with their checkpoint keys."""
    rows = [(source, region) for source, regions in routes.pairs().items() for region in regions]
    table = spark.createDataFrame(rows, "event_source string, aws_region string")
    return table.withColumn("checkpoint_key", checkpoint_key())


def checkpoint_key() -> Column:
    """Control-table key of an event; NULL for sources never collected."""
    source = F.col("event_source")
    return (
        F.when(source == IAM, "iam-events")
        .when(source == SIGN_IN, "signin-events")
        .when(source == STS, F.concat(F.lit("sts-"), "aws_region"))
        .when(source == SSO, F.concat(F.lit("sso-"), "aws_region"))
    )
