"""Building blocks for expression text.

The expressions of this package are written as Spark SQL text and handed to
Catalyst as one tree, which keeps plan building fast on the driver.  Catalyst
inlines aliases into lambda bodies and shares nothing inside them, so a value
used twice inside ``transform`` would be computed twice per element; ``let``
pins it to a lambda variable instead, computed once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ids = itertools.count()


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fresh() -> str:
    """A lambda variable name not used before."""
    return f"v{next(_ids)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(v)`` where ``v`` stands for ``value``, evaluated once."""
    v = fresh()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"{q(n)}, {e}" for n, e in fields.items()) + ")"


def let_struct(body: Callable[[str], str], /, **fields: str) -> str:
    """``let`` for several values, read as ``v.name``."""
    return let(struct(**fields), body)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def apply_text(body: Callable[..., str], *args: Column | str) -> Column:
    """Column form of an expression builder: ``body`` receives one SQL name per
    argument, each argument being evaluated once."""
    v = fresh()
    names = [f"{v}.a{i}" for i in range(len(args))]
    packed = F.named_struct(*[x for i, a in enumerate(args) for x in (F.lit(f"a{i}"), as_col(a))])
    return F.call_function("transform", F.array(packed), F.expr(f"{v} -> {body(*names)}")).getItem(0)
