"""Least squares and ridge written in SQL: normal equations, Gauss-Jordan.

Each model is a recursive CTE that eliminates one unknown per step on a matrix
held as nested lists, one matrix per group (fold). An independent check of the
Spark implementation, which solves with numpy.
"""

from __future__ import annotations

from collections.abc import Sequence


def solve_ctes(
    tag: str, source: str, columns: Sequence[str], target: str, by: Sequence[str], alpha: float = 0.0
) -> list[str]:
    """CTEs ending in ``{tag}_fit(by..., train_size, coef)``; coef[1] is the intercept.

    ``source`` has the by-columns, the columns and the target. Columns are
    standardised with the means and spreads of the source's training rows.
    """
    keys = ", ".join(by)
    group = f" GROUP BY {keys}" if by else ""
    pick = f"{keys}, " if by else ""
    xs = [f"z{i}" for i in range(1, len(columns) + 1)]
    moments = ", ".join(
        f'avg("{c}") AS mu{i}, coalesce(nullif(stddev_pop("{c}"), 0), 1) AS sd{i}'
        for i, c in enumerate(columns, 1)
    )
    over = f"JOIN {tag}_m USING ({keys})" if by else f", {tag}_m"
    scaled = ", ".join(f'("{c}" - mu{i}) / sd{i} AS z{i}' for i, c in enumerate(columns, 1))
    terms = ["1.0", *xs]
    rows = []
    for i, a in enumerate(terms):
        cells = []
        for j, b in enumerate(terms):
            ridge = f" + {alpha}" if alpha and i == j and i > 0 else ""
            cells.append(f"sum({a} * {b})::DOUBLE{ridge}")
        cells.append(f'sum({a} * y)::DOUBLE')
        rows.append("[" + ", ".join(cells) + "]")
    size = len(terms)
    unscale = "b[1]" + "".join(f" - b[{i + 1}] * mu{i} / sd{i}" for i in range(1, len(columns) + 1))
    coefficients = ", ".join(
        [unscale, *[f"b[{i + 1}] / sd{i}" for i in range(1, len(columns) + 1)]]
    )
    keyed = f"{tag}_s.".join(["", *[f"{k}, " for k in by]]) if by else ""
    join_m = f"JOIN {tag}_m USING ({keys})" if by else f", {tag}_m"
    moment_list = f"count(*) AS n{', ' + moments if moments else ''}"
    scaled_list = f'"{target}" AS y{", " + scaled if scaled else ""}'
    return [
        f"{tag}_m AS (SELECT {pick}{moment_list} FROM {source}{group})",
        f"{tag}_z AS (SELECT {pick}{scaled_list} FROM {source} {over})",
        f"""{tag}_s AS (
          SELECT {pick}0 AS k, [{', '.join(rows)}] AS a FROM {tag}_z{group}
          UNION ALL
          SELECT {keyed}k + 1, list_transform(a, lambda row, r:
              CASE WHEN r = k + 1 THEN list_transform(row, lambda v: v / a[k + 1][k + 1])
              ELSE list_transform(row, lambda v, c: v - row[k + 1] * a[k + 1][c] / a[k + 1][k + 1])
              END)
          FROM {tag}_s WHERE k < {size})""",
        f"""{tag}_fit AS (
          SELECT {pick}n AS train_size, [{coefficients}] AS coef
          FROM (SELECT {pick}list_transform(a, lambda row: row[{size + 1}]) AS b
                FROM {tag}_s WHERE k = {size}) {join_m})""",
    ]


def prediction(columns: Sequence[str], fit: str = "coef") -> str:
    return f"{fit}[1]" + "".join(f' + {fit}[{i}] * "{c}"' for i, c in enumerate(columns, 2))


METRICS = """
avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
1 - avg((y - p) * (y - p)) / var_pop(y) AS r2
"""


def fold_metrics(
    tag: str, model: str, valid: str, columns: Sequence[str], target: str, extra: str = ""
) -> str:
    """SELECT of per-fold metrics; extra groups the fit beyond the fold."""
    more = f"f.{extra}, " if extra else ""
    return f"""
      SELECT '{model}' AS model, {extra + ', ' if extra else ''}fold, any_value(train_size) AS train_size,
             count(*) AS validation_size, {METRICS}
      FROM (SELECT {more}v.fold, f.train_size, v."{target}" AS y, {prediction(columns, 'f.coef')} AS p
            FROM {valid} v JOIN {tag}_fit f ON f.fold = v.fold)
      GROUP BY fold{', ' + extra if extra else ''}
    """
