"""The record rules shared by all operators on interactions and features."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.text import blank, usable
from veldt.session import col

RECORD = ("user_id", "item_id", "value", "event_type", "days_ago")


def distinct_records(df: DataFrame, but: str = "loaded_at") -> DataFrame:
    """Rows equal in all columns but one are one record; nulls equal nulls and NaN equals NaN."""
    return df.select(*[col(c) for c in df.columns if c != but]).distinct()


def usable_interactions(df: DataFrame, positive: bool = False) -> DataFrame:
    """The distinct records with both ids and a finite value; columns user_id, item_id, value.

    The filter stands before the distinct (it looks at compared columns only), and the distinct combines before its
    shuffle, on all columns, so that no user or item makes a large partition.
    """
    v = F.col("value")
    keep = ~blank(F.col("user_id")) & ~blank(F.col("item_id")) & usable(v) & ((v > 0) if positive else F.lit(True))
    return df.select(*RECORD).filter(keep).distinct().select("user_id", "item_id", "value")
