"""SQL texts put together from steps."""

from __future__ import annotations


def with_steps(base: str, kept: list[str], steps: list[str], out: str) -> str:
    """A query whose column x goes through steps, each a table of its own."""
    names = ", ".join(kept)
    parts = [f"x0 AS ({base})", *(f"x{k} AS (SELECT {names}, {step} AS x FROM x{k - 1})" for k, step in enumerate(steps, 1))]
    return f"WITH {', '.join(parts)} SELECT {out} FROM x{len(steps)}"
