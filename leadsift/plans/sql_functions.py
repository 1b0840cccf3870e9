"""The library's column functions as SQL functions of a session, bodies in SQL only.

``register_functions(spark)`` makes temporary functions, so that SQL users call the same
rules: scalar ones on strings, and the table function ``posting_cards`` for use with
``LATERAL``. A body is the SQL text of the column function, so a rule has one definition.
Classic sessions only: the text is read from the column's own tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leadsift.functions import html, labels, money, names, urls
from leadsift.operators import extract

_INFIX = {
    "=": "=", "<=>": "<=>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "and": "AND", "or": "OR",
    "+": "+", "-": "-", "*": "*", "/": "/", "%": "%",
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _call(name: str, args: list[str]) -> str:
    if name in _INFIX and len(args) == 2:
        return f"({args[0]} {_INFIX[name]} {args[1]})"
    if name in ("!", "not"):
        return f"(NOT {args[0]})"
    if name == "in":
        return f"({args[0]} IN ({', '.join(args[1:])}))"
    return f"{name}({', '.join(args)})"


def _text(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        return _call(node.functionName(), [_text(a) for a in _items(node.arguments())])
    if kind == "Literal":
        value = node.value()
        return _quoted(value) if isinstance(value, str) else node.sql()
    if kind == "UnresolvedNamedLambdaVariable":
        return node.name()
    if kind == "LambdaFunction":
        variables = [a.name() for a in _items(node.arguments())]
        head = variables[0] if len(variables) == 1 else f"({', '.join(variables)})"
        return f"{head} -> {_text(node.function())}"
    if kind == "UnresolvedAttribute":
        return ".".join(_name(p) for p in _items(node.nameParts()))
    if kind == "UnresolvedExtractValue":
        return f"{_text(node.child())}[{_text(node.extraction())}]"
    if kind == "Alias":
        return f"{_text(node.child())} AS {_name(node.name().apply(0))}"
    if kind == "Cast":
        mode = node.evalMode()
        cast = "try_cast" if mode.isDefined() and "Try" in mode.get().toString() else "cast"
        return f"{cast}({_text(node.child())} AS {node.dataType().sql()})"
    if kind == "CaseWhenOtherwise":
        cases = "".join(f" WHEN {_text(b._1())} THEN {_text(b._2())}" for b in _items(node.branches()))
        last = node.otherwise()
        return f"CASE{cases}{' ELSE ' + _text(last.get()) if last.isDefined() else ''} END"
    if kind == "SqlExpression":
        return f"({node.expression()})"
    raise ValueError(f"no SQL text for a column node of kind {kind}")


def sql_text(column: Column) -> str:
    """SQL text of a column expression; windows and Python functions have none."""
    return _text(column._jc.node())


def _text_and_low(function: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda text: function(text, F.lower(text))


SCALARS: dict[str, tuple[str, Callable[..., Column]]] = {
    "normalize_company": ("name", names.normalize_company),
    "normalize_title": ("title", names.normalize_title),
    "clean_title": ("title", names.clean_title),
    "url_host": ("url", urls.url_host),
    "is_blocked_url": ("url", urls.is_blocked_url),
    "first_url": ("body", extract.first_url),
    "work_mode": ("body", lambda body: extract.work_mode(F.lower(body))),
    "estimate_salary": ("body", money.estimate_salary),
    "normalize_status": ("status", labels.normalize_status),
    "visible_text": ("html", html.visible_text),
    "posting_company": (
        "subject, sender, body",
        lambda subject, sender, body: extract.posting_company(subject, sender, body, F.lower(body)),
    ),
    "posting_title": (
        "subject, body", lambda subject, body: extract.posting_title(subject, body, F.lower(body)),
    ),
    "is_posting_digest": ("subject, sender, body", extract.is_digest),
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create or replace the functions in this session; returns their names.

    The columns are functions of strings: NULL in gives what the column function gives.
    """
    made = []
    for name, (arguments, function) in SCALARS.items():
        fields = arguments.split(", ")
        body = function(*[F.col(f) for f in fields])
        header = ", ".join(f"{_name(f)} STRING" for f in fields)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({header}) RETURN {sql_text(body)}")
        made.append(prefix + name)
    cards = extract.message_cards(F.coalesce(F.col("body"), F.lit("")))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}posting_cards(`body` STRING) "
        "RETURNS TABLE (card_idx INT, company STRING, title STRING, location STRING, url STRING, text STRING) "
        f"RETURN SELECT card_idx, company, title, place AS location, url, text FROM inline({sql_text(cards)})"
    )
    return [*made, prefix + "posting_cards"]
