"""Small helpers for writing Spark SQL expressions as text.

Large rule sets are written as SQL expressions: one parse in the JVM instead
of thousands of calls to build the same tree from Python.
"""


def q(s: str) -> str:
    """String literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(expr: str, values) -> str:
    return f"({expr} IN ({', '.join(q(v) for v in values)}))"


def pick(cases, otherwise="NULL") -> str:
    """CASE over (condition, value) pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def nonempty(expr: str) -> str:
    return f"nullif({expr}, '')"


def half_up(expr: str, decimals: int) -> str:
    """Round half toward plus infinity."""
    scale = 10 ** decimals
    return f"(floor(({expr}) * {scale}.0D + 0.5D) / {scale}.0D)"


def steady(expr: str, decimals: int) -> str:
    """Round half toward plus infinity, blind to the last bits that depend on summation order."""
    scale = 10 ** decimals
    return f"(floor(round(({expr}) * {scale}.0D, 6) + 0.5D) / {scale}.0D)"


def array_of(*items) -> str:
    return f"array_compact(array({', '.join(items)}))"
