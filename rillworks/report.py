"""What a run did: rows per verb and per physical operator, authors' counters, and digests that don't depend on row order."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark import Accumulator
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A verb of a chain, what it reads, and how its rows and counters are watched."""

    step: str
    inputs: tuple[Node, ...] = ()
    seen: Observation | None = None
    counts: Accumulator | None = None

    def walk(self) -> list[Node]:
        """All nodes, inputs before what reads them, each once."""
        found: dict[int, Node] = {}
        waiting = [(self, False)]
        while waiting:
            node, ready = waiting.pop()
            if id(node) in found:
                continue
            if ready:
                found[id(node)] = node
            else:
                waiting += [(node, True), *((x, False) for x in reversed(node.inputs))]
        return list(found.values())

    def graph(self) -> dict:
        """{"nodes": [{id, step}], "edges": [[from, to]]}."""
        nodes = self.walk()
        at = {id(node): i for i, node in enumerate(nodes)}
        edges = [[at[id(x)], at[id(node)]] for node in nodes for x in node.inputs]
        return {"nodes": [{"id": i, "step": node.step} for i, node in enumerate(nodes)], "edges": edges}

    def rows(self) -> int | None:
        try:
            return int(self.seen.get["rows"]) if self.seen is not None else None
        except Exception:  # a verb whose plan the optimizer cut away (an empty branch) was never observed
            return None


@dataclass
class RunReport:
    steps: list[str]
    rows_out: int = 0
    wall_seconds: float = 0.0
    value_hash: int | None = None
    state_rows: int | None = None
    errors: list[str] = field(default_factory=list)
    #: Per verb, where rows are counted (`Stream.counted`): step, inputs, rows_in and rows_out.
    verbs: list[dict] = field(default_factory=list)
    #: Per physical operator of the plan that ran: operator, rows_in and rows_out.
    operators: list[dict] = field(default_factory=list)
    #: Counters of authored operators, added up over their instances.
    metrics: dict[str, int] = field(default_factory=dict)

    @property
    def rows_per_second(self) -> float:
        return self.rows_out / self.wall_seconds if self.wall_seconds else 0.0

    def structural_digest(self) -> str:
        """Equal for the same verbs and row counts, whatever the partitioning."""
        return hashlib.sha256(json.dumps([self.steps, self.rows_out, self.verbs]).encode()).hexdigest()

    def operator(self, name: str) -> list[dict]:
        return [x for x in self.operators if x["operator"].startswith(name)]

    def to_json(self) -> str:
        return json.dumps({**asdict(self), "rows_per_second": self.rows_per_second, "digest": self.structural_digest()}, indent=2)

    def to_markdown(self) -> str:
        show = lambda n: "" if n is None else str(n)
        if self.verbs:
            lines = ["| step | rows in | rows out |", "|---|--:|--:|", *(f"| {v['step']} | {show(v['rows_in'])} | {show(v['rows_out'])} |" for v in self.verbs)]
        else:
            lines = ["| step |", "|---|", *(f"| {step} |" for step in self.steps)]
        if self.operators:
            lines += ["", "| operator | rows in | rows out |", "|---|--:|--:|"]
            lines += [f"| {x['operator']} | {show(x['rows_in'])} | {show(x['rows_out'])} |" for x in self.operators]
        lines += ["", *(f"{name}: {n}" for name, n in sorted(self.metrics.items()))]
        return "\n".join([*lines, f"{self.rows_out} rows in {self.wall_seconds:.3f} s, {self.rows_per_second:.0f} rows/s"])


#: Plan nodes that hand rows on as they are.
_THROUGH = ("WholeStageCodegenExec", "InputAdapter", "AQEShuffleReadExec", "ReusedExchangeExec", "ColumnarToRowExec", "ResultQueryStageExec")


def physical(df: DataFrame) -> list[dict]:
    """The operators of the plan that ran, children first, with their rows by Spark's own metrics."""
    out: list[dict] = []

    def walk(node) -> int | None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        children = node.children()
        below = [walk(children.apply(i)) for i in range(children.size())]
        given = None if not below or None in below else sum(below)
        if kind in _THROUGH:
            return given
        metric = node.metrics().get("numOutputRows")
        rows = int(metric.get().value()) if metric.isDefined() else given
        out.append({"operator": node.nodeName(), "rows_in": given, "rows_out": rows})
        return rows

    walk(df._jdf.queryExecution().executedPlan())
    return out


class Watch:
    """Counts a frame's rows while an action runs over it."""

    def __init__(self, df: DataFrame, node: Node, steps: tuple[str, ...], *, plan: bool = True):
        self._seen, self._node, self._plan = Observation(), node, plan
        self._before = {id(n): dict(n.counts.value) for n in node.walk() if n.counts is not None}
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("rows"))
        self._report, self._began = RunReport(list(steps)), time.perf_counter()

    def done(self) -> RunReport:
        report = self._report
        report.wall_seconds = time.perf_counter() - self._began
        report.rows_out = int(self._seen.get["rows"])
        nodes = self._node.walk()
        if self._node.seen is not None:
            rows = {id(n): n.rows() for n in nodes}
            into = lambda n: None if not n.inputs or None in (r := [rows[id(x)] for x in n.inputs]) else sum(r)
            report.verbs = [{"step": n.step, "rows_in": into(n), "rows_out": rows[id(n)]} for n in nodes]
        for n in nodes:
            for name, total in (n.counts.value if n.counts is not None else {}).items():
                report.metrics[name] = report.metrics.get(name, 0) + total - self._before[id(n)].get(name, 0)
        if self._plan:
            report.operators = physical(self.df)
        return report


def value_hash(df: DataFrame) -> int:
    """An order-insensitive 64-bit hash of all rows, computed in one aggregate."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.coalesce(F.bit_xor(row), F.lit(0)).alias("h"), F.count(F.lit(1))).first().h
