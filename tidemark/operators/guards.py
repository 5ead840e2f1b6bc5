"""Checks on SQL text before it runs: things that are valid and give a silently wrong figure.

The text is read as tokens; nothing is executed.  ``findings`` gives them as a DataFrame for a table of queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import one_slip, shortened

TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|[A-Za-z_][\w.]*|\d+(?:\.\d+)?|<>|<=|>=|!=|[^\s\w]")
#: Words that begin a clause.
CLAUSES = ("select", "from", "where", "group", "having", "order", "limit", "union")
FORBIDDEN = ("insert", "update", "delete", "drop", "create", "alter", "merge", "truncate", "grant", "call", "set", "into")


def tokens(sql: str) -> list[tuple[str, int]]:
    """(token in lower case, depth of parentheses) without comments."""
    sql = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql or "", flags=re.S)
    out, depth = [], 0
    for m in TOKEN.finditer(sql):
        t = m[0]
        depth -= t == ")"
        out.append((t if t[0] == "'" else t.lower(), depth))
        depth += t == "("
    return out


def clause(found: list[tuple[str, int]], name: str) -> list[tuple[str, int]]:
    """The tokens of the outermost clause ``name``."""
    at = next((i for i, (t, d) in enumerate(found) if t == name and d == 0), None)
    if at is None:
        return []
    end = next((i for i in range(at + 1, len(found)) if found[i][1] == 0 and found[i][0] in CLAUSES), len(found))
    return found[at + 1 : end]


def not_one_select(found) -> bool:
    words = [t for t, d in found]
    body = words[:-1] if words and words[-1] == ";" else words
    return not body or body[0] not in ("select", "with", "(") or ";" in body or any(t in FORBIDDEN for t, d in found if d == 0)


def mixed_and_or(found) -> bool:
    """a OR b AND c at one depth, without parentheses."""
    levels: dict[tuple[int, int], set[str]] = {}
    group, stack, between = 0, [0], False
    for t, d in clause(found, "where"):
        if t == "(":
            group += 1
            stack.append(group)
        elif t == ")":
            if len(stack) > 1:
                stack.pop()
        elif t == "between":
            between = True
        elif t == "and" and between:
            between = False
        elif t in ("and", "or"):
            levels.setdefault((d, stack[-1]), set()).add(t)
    return any(len(x) == 2 for x in levels.values())


def outer_join_undone(found) -> bool:
    """LEFT JOIN x ... WHERE x.col compares: rows without a match go after all."""
    words = [t for t, _ in found]
    names = set()
    for i, t in enumerate(words):
        if t == "left" and "join" in words[i + 1 : i + 3]:
            j = words.index("join", i) + 1
            alias = words[j + 1] if j + 1 < len(words) and words[j + 1] not in ("on", "using", "as") else words[j + 2] if j + 2 < len(words) and words[j + 1] == "as" else words[j]
            names |= {alias, words[j]}
    where = [t for t, _ in clause(found, "where")]
    for i, t in enumerate(where):
        if "." in t and t.split(".")[0] in names and where[i + 1 : i + 2] != ["is"]:
            inside = where[max(0, i - 2) : i]
            if "coalesce" not in inside and "or" not in where:
                return True
    return False


def pinned_group(found) -> bool:
    """GROUP BY a column that WHERE holds at one value."""
    where, group = clause(found, "where"), {t for t, _ in clause(found, "group")}
    flat = [t for t, _ in where]
    return "or" not in flat and any(flat[i + 1 : i + 2] == ["="] and t in group and (flat[i + 2][0] in "'0123456789") for i, t in enumerate(flat[:-2]))


def misnamed(found) -> bool:
    """max(...) AS min_..., or the other way."""
    words = [t for t, _ in found]
    for i, t in enumerate(words):
        if t in ("max", "min") and words[i + 1 : i + 2] == ["("]:
            depth, j = found[i + 1][1], i + 2
            while j < len(found) and not (found[j][0] == ")" and found[j][1] == depth):
                j += 1
            if words[j + 1 : j + 2] == ["as"] and words[j + 2 : j + 3] and words[j + 2].startswith({"max": "min", "min": "max"}[t]):
                return True
    return False


def same_aggregate_twice(found) -> bool:
    """One aggregate under two names."""
    items, current = [], []
    for t, d in clause(found, "select"):
        if t == "," and d == 0:
            items.append(current)
            current = []
        else:
            current.append(t)
    items.append(current)
    heads = [tuple(x[: x.index("as")]) for x in items if "as" in x and x[0] in ("sum", "avg", "count", "min", "max")]
    return len(heads) != len(set(heads))


def top_by_label(found) -> bool:
    """LIMIT over groups ordered by a grouping column and not by a measure."""
    group, order = {t for t, _ in clause(found, "group")} - {"by", ","}, [t for t, _ in clause(found, "order") if t not in ("by", ",")]
    return bool(group and order and clause(found, "limit") and order[0] in group)


def fan_out(found) -> bool:
    """SUM, AVG or COUNT(*) over a join, so repeated keys count rows twice."""
    words = [t for t, _ in found]
    return "join" in words and any(t in ("sum", "avg") or (t == "count" and words[i + 2 : i + 3] == ["*"]) for i, t in enumerate(words))


def average_of_records(found) -> bool:
    """AVG over records under a name that promises one a day."""
    words = [t for t, _ in found]
    return any(t == "avg" for t in words) and any("per_day" in t or "daily" in t for t in words) and "day" not in [t for t, _ in clause(found, "group")]


CHECKS = {
    "not_one_select": not_one_select, "mixed_and_or": mixed_and_or, "outer_join_undone": outer_join_undone, "pinned_group": pinned_group, "misnamed": misnamed,
    "same_aggregate_twice": same_aggregate_twice, "top_by_label": top_by_label, "fan_out": fan_out, "average_of_records": average_of_records,
}


def check(sql: str | None) -> list[str]:
    """The names of the checks a query fails."""
    found = tokens(sql or "")
    return [name for name, f in CHECKS.items() if f(found)]


def findings(df: DataFrame, sql: str) -> DataFrame:
    """A row for each check a query of ``df`` fails, in column ``finding``."""
    return df.withColumn("finding", F.explode(F.udf(check, "array<string>", useArrow=True)(sql)))


def unknown_values(conditions: DataFrame, values: DataFrame) -> DataFrame:
    """(field, value, nearest, distance) of conditions (field, value) that the field does not hold.

    ``nearest`` is the listed value that differs in case alone (distance 0) or by one slip, the first by name of equals; null where there is
    none.  Both sides are joined by what stays of a value with one letter less, so a field with many values is no cross product.
    """
    low = lambda c: F.trim(F.lower(F.col(c)))
    missing = conditions.distinct().join(values, ["field", "value"], "left_anti")
    asked = missing.select("field", "value", F.explode(shortened(low("value"))).alias("form"))
    known = values.distinct().select("field", F.col("value").alias("other"), F.explode(shortened(low("value"))).alias("form"))
    near = asked.join(known, ["field", "form"]).select("field", "value", "other").distinct().withColumn("d", one_slip(low("value"), low("other"))).where("d is not null")
    best = near.groupBy("field", "value").agg(F.min_by("other", F.struct("d", "other")).alias("nearest"), F.min("d").alias("distance"))
    return missing.join(best, ["field", "value"], "left").select("field", "value", "nearest", "distance")


def unsupported_numbers(said: DataFrame, known: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Numbers of an answer (answer_id, x) that no known value (answer_id, v) supports within ``tolerance``.

    Values are dealt into steps as wide as the tolerance by their logarithm; near ones are in the same or the next step, so an answer with
    many numbers is an equi-join.
    """
    step = lambda c: F.when(F.abs(c) < 1e-9, F.lit(0)).otherwise(F.floor(F.log(F.abs(F.col(c))) / F.log(F.lit(1 + 2 * tolerance)))).cast("long")
    sign = lambda c: F.when(F.abs(c) < 1e-9, 0).otherwise(F.signum(c)).cast("int")
    left = said.select("answer_id", "x", sign("x").alias("sign"), F.explode(F.array(*(step("x") + i for i in (-1, 0, 1)))).alias("step"))
    right = known.select("answer_id", "v", sign("v").alias("sign"), step("v").alias("step")).distinct()
    near = F.abs(F.col("x") - F.col("v")) <= tolerance * F.greatest(F.abs("x"), F.abs("v"), F.lit(1e-9))
    held = left.join(right, ["answer_id", "sign", "step"]).where(near).select("answer_id", "x").distinct()
    return said.join(held, ["answer_id", "x"], "left_anti")
