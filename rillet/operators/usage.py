"""Usage, quota and billing queries over the run-log tables.

Tables (types are ours; the source system stores them in SQL):

* ``users(id, email, is_subscribed, balance)``
* ``workflows(id, user_id, name, status, source_type, source_path, transformations, dest_path)``
* ``logs(id, workflow_id, timestamp, status, rows_processed, error, cost, source_file, dest_file)``
* ``transactions(id, user_id, timestamp, amount, type, description)``

Every query covers all users at once; money is ``decimal(18,6)``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillet.operators import quota
from rillet.operators.windows import row_numbers

# Fixed values of the billing rules (must equal the source system's):
# free users may process 1000 rows per day; subscribers pay 0.01 USD per 1000 rows.
FREE_DAILY_LIMIT = 1000
COST_PER_1000_ROWS = Decimal("0.01")

MONEY = "decimal(18,6)"


def daily_usage(logs: DataFrame, workflows: DataFrame) -> DataFrame:
    """``(user_id, day, rows_used)``: rows of successful runs per user and UTC day."""
    ok = logs.where(F.col("status") == "Success").select("workflow_id", "timestamp", "rows_processed")
    owned = ok.join(workflows.select(F.col("id").alias("workflow_id"), "user_id"), "workflow_id")
    return (owned.groupBy("user_id", F.to_date("timestamp").alias("day"))
            .agg(F.coalesce(F.sum("rows_processed"), F.lit(0)).cast("bigint").alias("rows_used")))


def quota_check(requests: DataFrame, users: DataFrame, limit: int = FREE_DAILY_LIMIT,
                num_partitions: int | None = None) -> DataFrame:
    """Decide each requested run by what its user has used that day so far (see :func:`quota.quota_check`).

    ``requests`` has ``user_id, day, timestamp, id, rows_requested, succeeds``; adds ``rows_used`` and ``allowed``.
    Subscribers are never limited.
    """
    return quota.quota_check(requests, users, limit, num_partitions)


def run_cost(rows: F.Column | str, is_subscribed: F.Column | str) -> F.Column:
    """Cost of a run: subscribers pay ``rows / 1000 * 0.01`` rounded to 6 places, others 0."""
    r = F.col(rows) if isinstance(rows, str) else rows
    s = F.col(is_subscribed) if isinstance(is_subscribed, str) else is_subscribed
    per_row = F.lit(COST_PER_1000_ROWS / 1000)
    cost = F.round(r.cast("decimal(20,0)") * per_row, 6)
    return F.when(F.coalesce(s, F.lit(False)), cost).otherwise(F.lit(0)).cast(MONEY)


def ledger(logs: DataFrame, workflows: DataFrame, transactions: DataFrame) -> DataFrame:
    """Charges (runs with cost > 0, negative) and account transactions, per user.

    Columns ``(user_id, id, timestamp, amount, status, description)``; sort
    with :func:`newest_first` for display.
    """
    w = workflows.select(F.col("id").alias("workflow_id"), "user_id", F.col("name"))
    charges = (logs.where(F.col("cost") > 0).join(w, "workflow_id")
               .select("user_id", "id", "timestamp", (-F.col("cost")).cast(MONEY).alias("amount"),
                       "status", F.concat(F.lit("workflow run: "), F.col("name")).alias("description")))
    money = transactions.select("user_id", "id", "timestamp", F.col("amount").cast(MONEY).alias("amount"),
                                F.lit("Success").alias("status"), "description")
    return charges.unionByName(money)


def newest_first(df: DataFrame, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    """Order newest first; equal timestamps by id (range-partitioned sort, no single task)."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).asc())


def run_history(logs: DataFrame, workflow_id=None) -> DataFrame:
    """Log rows of one workflow (or of every workflow), newest first."""
    rows = logs if workflow_id is None else logs.where(F.col("workflow_id") == F.lit(workflow_id))
    cols = [c for c in ("workflow_id", "id", "timestamp", "status", "rows_processed", "error", "cost",
                        "source_file", "dest_file") if c in logs.columns]
    return rows.select(*cols).orderBy("workflow_id", F.col("timestamp").desc(), "id")


def balances(ledger_df: DataFrame) -> DataFrame:
    """``(user_id, balance)``: sum of ledger amounts per user."""
    return ledger_df.groupBy("user_id").agg(F.sum("amount").cast(MONEY).alias("balance"))


def running_balance(ledger_df: DataFrame, **numbering) -> DataFrame:
    """Each ledger row with the user's balance after it (order: timestamp, id).

    Uses the skew-safe running sum, so one user with most of the rows does
    not pull them into one task.
    """
    out = row_numbers(ledger_df, ["user_id"], ["timestamp", "id"], output="seq", value="amount",
                      sum_output="balance_after", **numbering)
    return out.withColumn("balance_after", F.col("balance_after").cast(MONEY))


def workflow_listing(workflows: DataFrame, user_id=None) -> DataFrame:
    """A user's (or every user's) workflows with status and paths."""
    rows = workflows if user_id is None else workflows.where(F.col("user_id") == F.lit(user_id))
    cols = [c for c in ("user_id", "id", "name", "status", "source_type", "source_path", "dest_path")
            if c in workflows.columns]
    return rows.select(*cols)
