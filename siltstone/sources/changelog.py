"""Change logs of puts and deletes made from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def from_events(spark: SparkSession, events: DataFrame, generations: int = 6) -> DataFrame:
    """seq, key, op, value and gen: errors delete, other events put.

    The number of events comes from a scalar subquery, so the plan stays lazy.
    """
    return spark.sql(
        """
        select event_id as seq,
               format_string('user-%04d/%02d', user_id, event_id % 10) as key,
               case when event_type = 'error' then 2 else 1 end as op,
               case when event_type = 'error' then null else format_string('%s:%.2f', event_type, value) end as value,
               cast(event_id * {generations} div (select count(*) from {events}) as int) as gen
        from {events}
        """,
        events=events,
        generations=generations,
    )


def upserts_from_orders(orders: DataFrame) -> DataFrame:
    """Orders as puts on their customer, in the order of date and number."""
    return orders.selectExpr(
        "format_string('customer-%08d', o_custkey) as key",
        "1 as op",
        "concat(cast(o_orderkey as string), ':', o_orderpriority) as value",
        "o_orderdate as recency",
        "o_orderkey as seq",
    )
