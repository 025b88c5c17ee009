"""Computed columns from named columns: + - * / ( ) and numbers, nothing else."""

from __future__ import annotations

import ast
import re
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.names import field_error, format_formula_number, parse_field_number

MAX_MAGNITUDE = 1e15
OPS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}


def _with_placeholders(text: str, names: list[str]) -> tuple[str, dict[str, str]]:
    """Known column names, longest first, become plain identifiers; also ``[name]``."""
    used: dict[str, str] = {}

    def put(m: re.Match) -> str:
        used.setdefault(m[1] or m[2], f"f{len(used)}_")
        return used[m[1] or m[2]]

    known = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    pattern = rf"\[([^\]]+)\]|(?<![\w.])({known})(?!\w)" if known else r"\[([^\]]+)\]|(?!)(x)"
    return re.sub(pattern, put, text), used


def _checked(text: str, names: list[str]) -> tuple[ast.expr | None, dict[str, str], str | None]:
    """The expression, its placeholders, and an error if it uses anything not allowed."""
    plain, used = _with_placeholders(text, names)
    back = {v: k for k, v in used.items()}
    try:
        tree = ast.parse(plain.strip(), mode="eval").body
    except (SyntaxError, ValueError):
        return None, back, "The formula cannot be read."
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            name = back.get(node.id, node.id)
            if name not in names:
                return None, back, f'There is no field named "{name}".'
            back.setdefault(node.id, name)
        elif isinstance(node, ast.Constant):
            if isinstance(node.value, bool) or not isinstance(node.value, (int, float)):
                return None, back, "The formula cannot be read."
        elif not isinstance(node, (ast.BinOp, ast.UnaryOp, ast.USub, ast.UAdd, ast.Load, *OPS)):
            return None, back, "The formula cannot be read."
    return tree, back, None


def _column(node: ast.expr, back: dict[str, str], field) -> tuple[Column, Column]:
    """(value, error) of an expression; the first error from the left wins."""
    none = F.lit(None).cast("string")
    if isinstance(node, ast.Constant):
        return F.lit(float(node.value)), none
    if isinstance(node, ast.Name):
        return field(back[node.id])
    if isinstance(node, ast.UnaryOp):
        v, e = _column(node.operand, back, field)
        return (-v if isinstance(node.op, ast.USub) else v), e
    lv, le = _column(node.left, back, field)
    rv, re_ = _column(node.right, back, field)
    op = OPS[type(node.op)]
    if op == "/":
        zero = F.when(rv == 0, F.lit("The formula divides by zero."))
        return F.try_divide(lv, rv), F.coalesce(le, re_, zero)
    return {"+": lv + rv, "-": lv - rv, "*": lv * rv}[op], F.coalesce(le, re_)


def with_formulas(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Add ``<target>`` (text of the number) and ``<target>__error`` for every formula.

    A formula may use other targets; loops, unknown or non-numeric fields, division by zero and
    results of 1e15 and more give an error and no value. All of it is one chain of projections.
    """
    names = list(dict.fromkeys([*df.columns, *formulas]))
    parsed = {t: _checked(text, names) for t, text in formulas.items()}
    uses = {
        t: {back[n.id] for n in ast.walk(tree) if isinstance(n, ast.Name)} & set(formulas) if tree else set()
        for t, (tree, back, _) in parsed.items()
    }
    in_loop: dict[str, str] = {}
    graph = dict(uses)
    while True:
        try:
            order = list(TopologicalSorter(graph).static_order())
            break
        except CycleError as e:
            loop = e.args[1][::-1]
            for t in loop:
                in_loop[t] = f"The formulas refer to each other in a loop ({' → '.join(loop)})."
                graph[t] = set()

    kinds = dict(df.dtypes)

    def field(name: str) -> tuple[Column, Column]:
        if name in formulas:
            return F.col(f"_v_{name}"), F.col(f"_e_{name}")
        none = F.lit(None).cast("string")
        if kinds[name] == "boolean":
            return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)), none
        if kinds[name] != "string":
            return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)), none
        raw = F.col(f"`{name}`")
        return parse_field_number(raw), F.when(
            field_error(raw).isNotNull(), F.concat(F.lit(f'Field "{name}" '), field_error(raw), F.lit("."))
        )

    out = df
    for t in order:
        tree, back, problem = parsed[t]
        if t in in_loop or problem:
            value, error = F.lit(None).cast("double"), F.lit(in_loop.get(t) or problem)
        else:
            value, error = _column(tree, back, field)
        out = out.withColumns({f"_v_{t}": value, f"_e_{t}": error})
    done = {}
    for t in formulas:
        v, e = F.col(f"_v_{t}"), F.col(f"_e_{t}")
        big = ~(F.abs(v) < MAX_MAGNITUDE)
        error = F.coalesce(e, F.when(big, F.lit(f'The result of "{t}" is too large.')))
        done[f"{t}__error"] = error
        done[t] = F.when(error.isNull(), format_formula_number(v))
    temp = [f"_{k}_{t}" for t in formulas for k in "ve"]
    return out.withColumns(done).drop(*temp)
