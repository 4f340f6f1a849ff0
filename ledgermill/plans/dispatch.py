"""Question to plan: a small state graph on the driver that picks the operator; rows stay in DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.operators import analytics as an
from ledgermill.operators import store

MAX_STEPS = 16
END = "end"


@dataclass
class Graph:
    """Nodes are functions of a state dict; an edge names the next node, a branch picks it from the state."""

    nodes: dict[str, Callable[[dict], dict]] = field(default_factory=dict)
    edges: dict[str, str] = field(default_factory=dict)
    branches: dict[str, tuple[Callable[[dict], str], dict[str, str]]] = field(default_factory=dict)
    entry: str = ""

    def run(self, state: dict) -> dict:
        at, trace = self.entry, []
        while at != END:
            if len(trace) == MAX_STEPS:
                raise RuntimeError(f"more than {MAX_STEPS} steps: {' > '.join(trace)}")
            trace.append(at)
            state = {**state, **(self.nodes[at](state) or {})}
            if at in self.branches:
                pick, to = self.branches[at]
                key = pick(state)
                at = to[key] if key in to else to["__default__"]
            else:
                at = self.edges.get(at, END)
        return {**state, "trace": trace}


def answer(facts: DataFrame, intent: str, org: int, uid: int | None, metric: str | None = None, years: tuple[int, ...] = (), months: tuple[int, ...] = (), target_year: int | None = None) -> DataFrame:
    """Rows that answer a question of an intent about a metric (all of them if none is named)."""
    from ledgermill.operators.forecast import forecast

    rows = store.series(facts, org, uid, review=False)
    if metric and intent != "breakdown":
        rows = store.first_non_empty(rows, metric)
    if intent in ("factual", "compare") and months:
        rows = store.in_months(rows, months)
    if intent == "factual":
        return an.total(store.in_years(rows, years) if years else rows)
    if intent == "compare":
        by_year = an.yearly(rows)
        return an.compare_years(by_year, min(years), max(years)) if len(years) >= 2 else an.compare_year(by_year, years[0]) if years else an.compare_latest(by_year)
    if intent == "breakdown":
        rows = store.in_years(rows, years) if years else rows
        asked = rows.where(F.col("metric") == metric).select("metric", "parent").union(rows.where(F.col("parent") == metric).select(F.col("parent").alias("metric"), F.lit(None).cast("string"))).groupBy("metric").agg(F.max("parent").alias("parent"))
        return an.breakdown_of(asked, rows) if metric else an.breakdown(rows)
    if intent == "rank":
        return an.month_rank(rows) if metric else an.growth_rank(an.yearly(rows))
    if intent == "forecast":
        return forecast(an.yearly(rows), target_year=target_year)
    return an.last_values(rows).orderBy("metric").limit(30)


def answer_factual(questions: DataFrame, facts: DataFrame, dictionary: DataFrame, org: int, uid: int | None) -> DataFrame:
    """Totals that answer factual questions (query_id, text), all of them in one plan.

    Questions are classified by rules, their words resolved against the dictionary (``resolve.entries``) by name and then by
    words, and the series met on (metric, period): with years only the periods that touch one of them count.
    """
    from ledgermill.functions import names
    from ledgermill.operators import resolve as rs

    asked = questions.select("query_id", F.inline(F.array(names.classify(F.col("text"))))).where("intent = 'factual'")
    found = rs.resolve(rs.exact(asked, dictionary), rs.lexical(asked, dictionary)).select("query_id", "metric_id", "step")
    named = dictionary.where("from_synonym = 0").select("metric_id", F.col("name").alias("metric"))
    wanted = asked.join(found, "query_id").join(named, "metric_id").select("query_id", "metric", "years", "step")
    rows = wanted.join(store.series(facts, org, uid, review=False), "metric")
    kept = rows.where((F.size("years") == 0) | F.exists("years", lambda y: y.between(F.year("period_start"), F.year("period_end"))))
    return an.total(kept, ("query_id", "metric", "step"))
