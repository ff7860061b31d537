"""Grading of ordered tool calls against a specification of tools, without per-row Python.

Whether a call's prerequisites had succeeded depends on earlier verdicts; along the order of the tools' dependencies this is
plain windows: the first successful step of a tool is the smallest step of its calls that have no hard issue, and that only
needs the first successful steps of its prerequisites. All windows share one partitioning by trajectory."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    requires: tuple[str, ...] = ()
    safety: bool = False
    max_calls: int | None = None
    #: name -> (least, most) of numeric parameters; all are required.
    params: dict[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Spec:
    tools: dict[str, Tool]
    forbidden: tuple[str, ...] = ()
    mandatory: tuple[str, ...] = ()
    max_steps: int | None = None
    hard: float = 0.5
    soft: float = 0.1
    pass_threshold: float = 0.0

    def order(self) -> list[str]:
        """Tools after their prerequisites; a cycle is an error."""
        out: list[str] = []
        while len(out) < len(self.tools):
            free = [t for t in sorted(self.tools) if t not in out and all(r in out for r in self.tools[t].requires)]
            if not free:
                raise ValueError("the tools' prerequisites form a cycle")
            out += free
        return out

    @classmethod
    def load(cls, path: str | Path) -> Spec:
        import yaml

        d = yaml.safe_load(Path(path).read_text())
        tools = {n: Tool(tuple(t.get("requires", ())), bool(t.get("safety")), t.get("max_calls"), {k: (float(v[0]), float(v[1])) for k, v in (t.get("params") or {}).items()}) for n, t in d["tools"].items()}
        return cls(tools, tuple(d.get("forbidden", ())), tuple(d.get("mandatory", ())), d.get("max_steps"))


def grade_calls(calls: DataFrame, spec: Spec) -> DataFrame:
    """Adds hard, soft (issue codes) to calls (task_id, step, tool, args map<string,double>, args_key).

    A forbidden or undeclared tool has only that issue; it changes no state."""
    w = Window.partitionBy("task_id")
    tool = F.col("tool")
    known = tool.isin(*spec.tools) & ~tool.isin(*spec.forbidden) if spec.tools else F.lit(False)
    ranked = calls.withColumn("_no", F.row_number().over(w.orderBy("step")))
    count = F.count_if(known).over(Window.partitionBy("task_id", "tool").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    same = F.row_number().over(Window.partitionBy("task_id", "tool", "args_key").orderBy("step"))
    x = ranked.withColumns({"_count": count, "_same": same})

    def arg_issues(name: str) -> list[Column]:
        p = spec.tools[name].params
        extra = F.size(F.array_except(F.map_keys("args"), F.array(*[F.lit(k) for k in p]).cast("array<string>")))
        out = [F.when(tool == name, F.array_repeat(F.lit("hallucinated_param"), extra))]
        for k, (low, high) in p.items():
            v = F.try_element_at(F.col("args"), F.lit(k))
            out.append(F.when(tool == name, F.when(v.isNull(), F.array(F.lit("missing_required_param"))).when((v < low) | (v > high), F.array(F.lit("invalid_value")))))
        return out

    none = F.array().cast("array<string>")
    flat = lambda cols: F.flatten(F.array(*[F.coalesce(c, none) for c in cols])) if cols else none
    x = x.withColumn("_args", flat([c for t in spec.tools for c in arg_issues(t)]))
    for t in spec.order():  # the first good and the first failed step of each tool, prerequisites first
        deps = [F.coalesce(F.col(f"_ok_{r}") < F.col("step"), F.lit(False)) for r in spec.tools[t].requires]
        good = (tool == t) & known & (F.size("_args") == 0)
        for d in deps:
            good = good & d
        x = x.withColumn(f"_ok_{t}", F.min(F.when(good, F.col("step"))).over(w)).withColumn(f"_bad_{t}", F.min(F.when((tool == t) & ~good, F.col("step"))).over(w))

    def dep_issue(t: str, r: str) -> Column:
        missing = ~F.coalesce(F.col(f"_ok_{r}") < F.col("step"), F.lit(False))
        code = F.when(F.col(f"_bad_{r}") < F.col("step"), "dependency_failed").otherwise("skipped_safety_check" if spec.tools[r].safety else "order_violation")
        return F.when((tool == t) & missing, F.array(code))

    deps = flat([dep_issue(t, r) for t in spec.tools for r in spec.tools[t].requires])
    hard = F.when(tool.isin(*spec.forbidden) if spec.forbidden else F.lit(False), F.array(F.lit("forbidden_tool"))).when(~known, F.array(F.lit("unknown_tool"))).otherwise(F.concat(deps, F.col("_args")))
    over = [F.when((tool == t) & (F.col("_count") > s.max_calls), F.array(F.lit("max_calls_exceeded"))) for t, s in spec.tools.items() if s.max_calls is not None]
    steps = [F.when(F.col("_no") > spec.max_steps, F.array(F.lit("max_steps_exceeded")))] if spec.max_steps is not None else []
    soft = F.when(known, F.concat(flat(steps), flat(over), F.when(F.col("_same") > 1, F.array(F.lit("redundant"))).otherwise(none))).otherwise(none)
    missing = [F.when(F.col(f"_ok_{t}").isNull(), "skipped_safety_check" if spec.tools[t].safety else "missing_required_step") for t in spec.mandatory]
    run = F.array_compact(F.array(*missing)) if missing else none
    return x.withColumns({"hard": hard, "soft": soft, "run_issues": run}).drop(*[c for c in x.columns if c.startswith("_")])


def grade_runs(graded: DataFrame, spec: Spec) -> DataFrame:
    """(task_id, n_calls, n_hard, n_soft, first_failure, score, passed)."""
    g = graded.groupBy("task_id").agg(F.count("*").alias("n_calls"), F.sum(F.size("hard")).alias("h"), F.sum(F.size("soft")).alias("n_soft"), F.min(F.when(F.size("hard") > 0, F.col("step"))).alias("first_failure"), F.max(F.size("run_issues")).alias("r"))
    n_hard = F.col("h") + F.col("r")
    score = F.round(F.greatest(F.lit(0.0), 1.0 - spec.hard * n_hard - spec.soft * F.col("n_soft")), 4)
    return g.select("task_id", "n_calls", n_hard.alias("n_hard"), "n_soft", "first_failure", score.alias("score"), ((n_hard == 0) & (score >= spec.pass_threshold)).alias("passed"))


def issue_counts(graded: DataFrame) -> DataFrame:
    return graded.select(F.explode(F.concat("hard", "soft")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def run_costs(steps: DataFrame, cost: str = "cost_usd", latency: str = "latency_s") -> DataFrame:
    """(task_id, steps, cost_usd, latency_s): totals of a run's steps; null costs and latencies count as 0. Costs are added up in
    millionths, so the sum does not depend on its order."""
    exact = lambda c: F.sum(F.coalesce(F.round(F.col(c).cast("decimal(28,12)"), 6), F.lit(0))).cast("double")
    return steps.groupBy("task_id").agg(F.count("*").alias("steps"), exact(cost).alias("cost_usd"), exact(latency).alias("latency_s"))
