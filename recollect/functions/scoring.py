"""Scores by configurable formulas over named variables.

A formula is an arithmetic expression over the variables and the natural ``log``;
names are checked against a whitelist, and the result becomes one Column that Spark
compiles with the rest of the plan. Every result is clamped at zero.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The defaults of the variables, the formulas, the priors of the source
# kinds, and the thresholds of the buckets.
DEFAULTS = {
    "reach": 0.5,
    "surprise": 0.5,
    "directive": 0.0,
    "sensitivity": 0.0,
    "best": 0.5,
    "confidence": 0.9,
    "freshness": 1.0,
    "source_prior": 1.0,
    "sources": 2.0,
    "relevance": 0.8,
    "observations": 5.0,
    "subpages": 0.0,
    "inbound": 2.0,
}
FORMULAS = {
    "standing": "reach * (.35 + .65 * surprise) * (1 + directive * reach) * (.5 + .5 * confidence) * freshness * (.6 + .4 * source_prior) * (1 + .15 * log(1 + sources))",
    "situational": "relevance * (.75 + .25 * reach) * (.5 + .5 * confidence) * (.7 + .3 * freshness) * source_prior",
    "chunk": "relevance * (.5 + .5 * reach) * source_prior",
    "page": "best * (1 + .1 * log(1 + observations) + .05 * log(1 + inbound))",
}
SOURCE_PRIORS = {"note_user": 1.0, "note_agent": 0.8, "meeting": 0.7, "conversation": 0.6, "document": 0.5, "chat_log": 0.4, "coding_session": 0.3}
BUCKETS = (0.6, 0.3)
STANDING_BOOST, SITUATIONAL_BOOST = 1.15, 1.05

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}

def parsed(source: str) -> ast.expr:
    """A formula's syntax tree; ValueError for names, functions or operators that it may not have."""
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"not a formula: {source!r}") from error

    def check(node: ast.AST) -> None:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float) or isinstance(node, ast.Name) and node.id in DEFAULTS:
            return
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            check(node.operand)
        elif isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            check(node.left)
            check(node.right)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "log" and len(node.args) == 1 and not node.keywords:
            check(node.args[0])
        else:
            raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")

    check(tree)
    return tree


def formula(source: str, variables: dict[str, Column] | None = None) -> Column:
    """The formula as a Column; variables that are not given, or null, take their defaults."""
    given = variables or {}

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            default = F.lit(DEFAULTS[node.id])
            return F.coalesce(given[node.id].cast("double"), default) if node.id in given else default
        if isinstance(node, ast.UnaryOp):
            return -build(node.operand)
        if isinstance(node, ast.BinOp):
            return _OPERATORS[type(node.op)](build(node.left), build(node.right))
        return F.ln(build(node.args[0]))

    return F.greatest(F.lit(0.0), build(parsed(source)))


def score(name: str, **variables: Column) -> Column:
    return formula(FORMULAS[name], variables)


def with_variables(df: DataFrame) -> DataFrame:
    """``df`` with every variable as a column, nulls and missing ones at their defaults."""
    return df.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(d)) if n in df.columns else F.lit(d) for n, d in DEFAULTS.items()})


def freshness(day: Column, now: Column, half_life: Column) -> Column:
    """Halves with every half-life in days; 1 without one, and for dates to come."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(day.cast("timestamp"))) / F.lit(86400e6)
    return F.when(half_life > 0, F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), age) / half_life)).otherwise(F.lit(1.0))


def source_prior(kind: Column) -> Column:
    """The prior of a source kind; 0 for an unknown one."""
    found = F.create_map(*(F.lit(x) for pair in SOURCE_PRIORS.items() for x in pair))
    return F.coalesce(F.try_element_at(found, kind), F.lit(0.0))


def bucket(value: Column) -> Column:
    high, low = BUCKETS
    return F.when(value >= high, 3).when(value >= low, 2).otherwise(1)


def source_kind(entry_kind: Column, actor: Column, payload_kind: Column) -> Column:
    """The payload's kind for sources; a user's or an agent's note otherwise."""
    return F.when(entry_kind == "source", payload_kind).when(actor == "user", "note_user").otherwise("note_agent")


def call_cost(prices: dict[str, Column], usage: dict[str, Column], tier_factor: Column) -> Column:
    """Cost of a model call; prices are for a million tokens, cached input has its own."""
    fresh = (usage["input"] - usage["cached"]) * prices["input"]
    return tier_factor * (fresh + usage["cached"] * prices["cached"] + usage["output"] * prices["output"]) / F.lit(1e6)


def tier_factor(configured: Column, served: Column) -> Column:
    """Twice where flex was asked for and default was served, half the other way round."""
    return F.when((configured == "flex") & (served == "default"), 2.0).when((configured != "flex") & (served == "flex"), 0.5).otherwise(1.0)


def budgets(total: Column, global_share: int, project_share: int) -> tuple[Column, Column]:
    """A budget split by ratio in whole tokens; the remainder goes to the project."""
    first = F.floor(total * global_share / (global_share + project_share)).cast("long")
    return first, total - first
