"""Seeded random draws as SQL expressions.

A draw is a hash of everything that names it (seed, purpose, series, model,
individual, ...), so a retried task or a lost executor repeats exactly the same
numbers, and any SQL engine with ``md5`` can replay them.

Like everything in this folder the functions take and return SQL expression
text, to be used in ``selectExpr``: one call into the JVM per finished column
instead of one per node.
"""

from __future__ import annotations


def draw(seed: int, purpose: str, *names: str | int) -> str:
    """Uniform double in [0, 1). ``names`` are SQL expressions."""
    # as concat_ws, which is slower, would join them: a NULL is left out with its bar
    parts = ", ".join(f"coalesce(concat('|', string({n})), '')" for n in names)
    return f"(double(bigint(conv(substr(md5(concat('{seed}|{purpose}', {parts})), 1, 8), 16, 10))) / 4294967296D)"
