"""What a plan did: rows of its operators, after it has run."""


def _children(node):
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    seq = node.children()
    return [seq.apply(i) for i in range(seq.length())]


def most_rows(df) -> int:
    """The most rows that an operator of the plan gave on."""
    df.collect()
    most, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        found = node.metrics().get("numOutputRows")
        most = max(most, found.get().value() if found.isDefined() else 0)
        nodes += _children(node)
    return most
