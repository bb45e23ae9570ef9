"""User-defined feature columns without evaluating Python.

Formulas are Spark SQL expressions whose names are checked against the columns and an
allow-list of functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import c, log_safe, sqrt_safe
from .special import sigmoid

NAMED = {
    "log": log_safe, "sqrt": sqrt_safe, "square": lambda x: c(x) * c(x), "cube": lambda x: c(x) * c(x) * c(x),
    "abs": lambda x: F.abs(c(x)), "sign": lambda x: F.signum(c(x)), "sigmoid": sigmoid, "tanh": lambda x: F.tanh(c(x)),
}
ALLOWED = set("abs ceil coalesce cos exp floor greatest if isnull least ln log10 nullif pow round sign sin sqrt tanh try_divide".split())
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_TOKENS = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?|[-+*/%(),<>=!. ]")


def named(function: str, column: str) -> Column:
    if function not in NAMED:
        raise ValueError(f"unknown function {function}")
    return NAMED[function](column)


def expression(text: str, columns) -> Column:
    """A checked SQL expression over the given columns."""
    if _TOKENS.sub("", text):
        raise ValueError(f"characters not allowed in formula: {_TOKENS.sub('', text)!r}")
    unknown = {w for w in _WORD.findall(text) if w not in columns and w.lower() not in ALLOWED | {"and", "or", "not", "null", "e"}}
    if unknown:
        raise ValueError(f"names not allowed in formula: {sorted(unknown)}")
    return F.expr(text)


def arithmetic(formula: str, variables: dict[str, str], columns) -> Column:
    """A formula over variables bound to columns; whole words are replaced."""
    bound = _WORD.sub(lambda m: variables.get(m.group(), m.group()), formula)
    return expression(bound, columns)
