"""Replayable cleaning: a list of (step, parameters) folded over an immutable frame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.meta import ColumnMeta, is_numeric, is_temporal
from tablewise.operators.clean import OPS
from tablewise.session import cut_lineage

MAX_ROUNDS = 30
CUT_EVERY = 5


@dataclass(frozen=True)
class Step:
    op: str
    params: dict = field(default_factory=dict)

    @property
    def label(self) -> str:
        shown = ", ".join(f"{k}={v}" for k, v in self.params.items())
        return f"{self.op}({shown})"


def apply_step(df: DataFrame, op: str, /, **params) -> DataFrame:
    if op not in OPS:
        raise ValueError(f"Unknown step: {op}")
    return OPS[op](df, **params)


def apply_steps(df: DataFrame, steps: list[Step]) -> tuple[DataFrame, list[dict]]:
    """Replay from the original; a step that fails is recorded and skipped."""
    log = []
    for step in steps:
        error = None
        try:
            df = apply_step(df, step.op, **step.params)
        except (ValueError, TypeError, KeyError, PySparkException) as problem:
            error = str(problem).splitlines()[0]
        log.append({"op": step.op, "params": step.params, "label": step.label, "error": error})
    return df, log


@dataclass(frozen=True)
class History:
    """Original frame with applied and undone steps; every change returns a new history."""

    original: DataFrame
    steps: tuple[Step, ...] = ()
    undone: tuple[Step, ...] = ()

    def apply(self, op: str, /, **params) -> "History":
        apply_step(self.current(), op, **params)
        return History(self.original, (*self.steps, Step(op, params)), ())

    def undo(self) -> "History":
        return History(self.original, self.steps[:-1], (*self.undone, self.steps[-1])) if self.steps else self

    def redo(self) -> "History":
        return History(self.original, (*self.steps, self.undone[-1]), self.undone[:-1]) if self.undone else self

    def revert_to(self, count: int) -> "History":
        return History(self.original, self.steps[:count], (*self.undone, *reversed(self.steps[count:])))

    def current(self) -> DataFrame:
        return apply_steps(self.original, list(self.steps))[0]


def lineage_table(df: DataFrame, steps: list[Step], count_rows: bool = False) -> DataFrame:
    """(seq, op, params, label, error, row_count); row counts cost one job per step and come on request."""
    spark = df.sparkSession
    rows = []
    for i, step in enumerate(steps, 1):
        df, log = apply_steps(df, [step])
        rows.append((i, step.op, {k: str(v) for k, v in step.params.items()}, step.label, log[0]["error"], df.count() if count_rows else None))
    return spark.createDataFrame(rows, "seq int, op string, params map<string,string>, label string, error string, row_count long")


def changed_values(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, column, before, after) for every cell that differs between two versions with the same rows."""
    cols = [c for c in before.columns if c in after.columns and c != key]
    # Doubles and longs of the same value count as equal.
    shown = lambda df, c: (F.col(c).cast("double").cast("string") if is_numeric(before, c) and is_numeric(after, c) else F.col(c).cast("string"))
    a = before.select(F.col(key).alias("k"), F.struct(*[shown(before, c).alias(c) for c in cols]).alias("a"))
    b = after.select(F.col(key).alias("k"), F.struct(*[shown(after, c).alias(c) for c in cols]).alias("b"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").alias("before"), F.col(f"b.{c}").alias("after")) for c in cols])
    both = a.join(b, "k").where(~F.col("a").eqNullSafe(F.col("b")))
    cell = both.select(F.col("k").alias(key), F.inline(cells))
    return cell.where(~F.col("before").eqNullSafe(F.col("after")))


def preview_step(df: DataFrame, key: str, op: str, /, **params) -> dict:
    """What a step would do: row counts, changed cells, the first six changes and new columns."""
    after = apply_step(df, op, **params)
    changes = changed_values(df, after, key)
    return {
        "rows": df.agg(F.count(F.lit(1)).alias("before")).select(
            "before", after.agg(F.count(F.lit(1)).alias("n")).scalar().alias("after"), changes.agg(F.count(F.lit(1)).alias("n")).scalar().alias("changed")),
        "sample": changes.orderBy(key, "column").limit(6),
        "new_columns": [c for c in after.columns if c not in df.columns],
        "after": after,
    }


def auto_clean(df: DataFrame, metas: list[ColumnMeta], order_by: list[str] | None = None) -> tuple[DataFrame, list[Step], list[ColumnMeta]]:
    """Apply the recommended fixes, worst first, until nothing is left to fix or thirty rounds have passed.

    A round takes the first fix of every column, as those do not touch each other; dropping duplicates has a round of its own. What a fix
    needs to know (means, modes, fences) is in the profile, so it costs no pass. After a round only the columns it changed are profiled
    again; after dropped rows all are."""
    from tablewise.operators.profile import build_profile, refresh_profile

    steps: list[Step] = []
    p = build_profile(df, metas)
    for round_no in range(MAX_ROUNDS):
        fixes = _next_fixes(p.issues, steps)
        if not fixes:
            break
        changed: set[str] = set()
        dropped = False
        for fix in fixes:
            params = dict(fix["params"])
            if params.get("method") == "ffill":
                if not order_by:
                    steps.append(Step("skipped", {"column": fix["column"], "issue": fix["issue"]}))
                    continue
                params["order_by"] = order_by
            if fix["op"] == "drop_duplicates":
                dropped = True
                if order_by:
                    params["order_by"] = order_by
            df = apply_step(df, fix["op"], **params, **_known(p, fix))
            steps.append(Step(fix["op"], params))
            changed |= {fix["column"]} if fix["column"] else set()
        if not changed and not dropped:
            continue
        metas = [m for m in metas if m.name in df.columns]
        if (round_no + 1) % CUT_EVERY == 0:
            df = cut_lineage(df)
        p = build_profile(df, metas, p.unnamed_headers) if dropped else refresh_profile(p, df, metas, changed)
    return df, [s for s in steps if s.op != "skipped"], metas


def _next_fixes(issues: list[dict], steps: list[Step]) -> list[dict]:
    """The fixes of one round: in the order of the issues, one a column, none beyond a change of the rows."""
    out: list[dict] = []
    for issue in issues:
        if not issue["op"] or _tried(steps, issue) or issue["column"] in {f["column"] for f in out}:
            continue
        if issue["op"] == "drop_duplicates":
            return out or [issue]
        out.append(issue)
    return out


def _known(p, fix: dict) -> dict:
    """What the profile knows of a fix's column that the step would look for again."""
    from tablewise.operators.moments import fences, log_fences

    c = p.columns.get(fix["column"]) or {}
    params = fix["params"]
    if fix["op"] == "fill_missing" and params["method"] in ("mean", "median"):
        return {"known": c[params["method"]]} if c.get("n") else {}
    if fix["op"] == "fill_missing" and params["method"] == "mode":
        return {"known": c["top"][0][0]} if c.get("top") else {}
    if fix["op"] == "text_clean" and params["fn"] == "standardize":
        return {"known": c["rewrites"]} if c.get("rewrites") else {}
    if fix["op"] == "outliers":
        low, high = log_fences(c["spots"], params["k"]) if params["method"] == "logiqr" else fences(c["q1"], c["q3"], params["k"])
        return {"known": (c["min"] if c["min"] >= 0 and low < c["min"] else low, high)}
    return {}


def _tried(steps: list[Step], issue: dict) -> bool:
    for s in steps:
        if s.op == "skipped" and s.params == {"column": issue["column"], "issue": issue["issue"]}:
            return True
        if s.op == issue["op"] and all(s.params.get(k) == v for k, v in issue["params"].items()):
            return True
    return False
