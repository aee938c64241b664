"""Columns of the caller that have the names of an operator's own."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame


def shielded(op):
    """For operators whose working columns begin with an underscore: columns of the input that do so too are set aside under other names while it works, unless
    an argument names them, and come out under their own."""

    @wraps(op)
    def run(df: DataFrame, *args, **kwargs):
        named = {x for a in (*args, *kwargs.values()) for x in ([a] if isinstance(a, str) else a if isinstance(a, (list, tuple)) else ())}
        taken = set(df.columns)
        aside = {}
        for c in df.columns:
            if c.startswith("_") and c not in named:
                name = "own" + c
                while name in taken:
                    name += "_"
                taken.add(name)
                aside[c] = name
        if not aside:
            return op(df, *args, **kwargs)
        out = op(df.withColumnsRenamed(aside), *args, **kwargs)
        back = {v: k for k, v in aside.items()}
        return (out[0].withColumnsRenamed(back), *out[1:]) if isinstance(out, tuple) else out.withColumnsRenamed(back)

    return run
