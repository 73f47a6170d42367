"""Fixed-width text of metric tables; these are a few hundred rows at most, made of counts of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

LIMIT = 10_000


def fixed_width(df: DataFrame, title: str, digits: int = 4) -> str:
    """A title and one line a row, columns wide enough, numbers to the right. Refuses tables that are no report."""
    rows = df.limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} rows")
    cells = [list(df.columns)] + [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    number = [t in ("double", "float", "int", "bigint") for _, t in df.dtypes]
    line = lambda r: "  ".join(c.rjust(w) if n else c.ljust(w) for c, w, n in zip(r, width, number, strict=True)).rstrip()
    return "\n".join([title, "=" * len(title), *map(line, cells)])
