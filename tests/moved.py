"""Rows that a query moves between its tasks."""


def shuffled_rows(df) -> int:
    """Rows written by all shuffles of ``df``, which is run for it."""
    df.collect()

    def walk(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if kind == "ReusedExchangeExec":
            return 0
        below = plan.children()
        rows = sum(walk(below.apply(i)) for i in range(below.size()))
        return rows + (plan.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0)

    return walk(df._jdf.queryExecution().executedPlan())
