"""Small-cell suppression and other limits on results, as plan nodes on top of a query."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medloom.functions.names import count_columns, is_rate
from medloom.session import settled

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def suppress_count(n: Column, k: int) -> Column:
    """The count as text, or ``<k``."""
    return F.when(n < k, F.lit(f"<{k}")).otherwise(n.cast("string"))


def is_small(value: Column, kind: T.DataType, k: int) -> Column:
    """A number below k (zero too), or a list of fewer than k; nulls, NaN and texts are not small."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value) < k, F.lit(False))
    if not isinstance(kind, _NUMBERS):
        return F.lit(False)
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (number < k), F.lit(False))


def drop_forbidden(rows: DataFrame, forbidden: Iterable[str]) -> DataFrame:
    names = {f.lower() for f in forbidden}
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in names])


def suppress_cells(rows: DataFrame, k: int, forbidden: Iterable[str] = ("record_id",), explicit: Iterable[str] | None = None, planned: Iterable[str] = (), masked: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """(rows with small counts as ``<k`` and the rates beside them as ``suppressed``, columns of counts).

    Columns that can hold suppressed values become strings, so small counts never leave the engine;
    maps of counts keep their keys.  In ``masked`` columns a null is a value that the engine has hidden already,
    and only whole numbers are compared with k.
    """
    rows = drop_forbidden(rows, forbidden)
    counts = count_columns(rows.columns, explicit, planned)
    if not counts:
        return rows, []
    kinds = {f.name: f.dataType for f in rows.schema}
    masked = set(masked)
    small = {c: is_small(F.col(f"`{c}`"), kinds[c], k) for c in counts if c not in masked}
    small |= {c: F.col(f"`{c}`").isNull() | (is_small(F.col(f"`{c}`"), kinds[c], k) if isinstance(kinds[c], _WHOLE) else F.lit(False)) for c in counts if c in masked}
    hidden = reduce(lambda a, b: a | b, small.values())
    out = []
    for c in rows.columns:
        value = F.col(f"`{c}`")
        if c in small and isinstance(kinds[c], T.MapType) and isinstance(kinds[c].valueType, _NUMBERS):
            value = F.transform_values(value, lambda _, n: F.when(n < k, F.lit(f"<{k}")).otherwise(n.cast("string")))
        elif c in small:
            value = F.when(small[c], F.lit(f"<{k}")).otherwise(value.cast("string"))
        elif is_rate(c):
            value = F.when(hidden, F.lit("suppressed")).otherwise(value.cast("string"))
        out.append(value.alias(c))
    return rows.select(*out), counts


#: Hidden cells whose equations the driver solves; statements with more are refused.
MOST_HIDDEN = 2000


def complementary_cells(cells: DataFrame, dimensions: int) -> list[int]:
    """Places of further cells of grouping sets to hide, so that no hidden cell is a total less its visible neighbours.

    ``cells`` has ``__place``, ``__hidden``, ``__size`` and for each dimension ``__dim_i`` and ``__all_i`` (1 where it is summed over).
    Each cell of a coarser grouping set is the sum of those of a finer one that agree with it: an equation among shown and hidden
    cells.  The smallest visible cell of each equation with a single hidden one is hidden as well, until there is none; then equations are
    solved together, and cells that they determine are treated alike.  Null dimensions are values like others.
    """
    cells = settled(cells.select("__place", "__hidden", "__size", *(f"__{n}_{i}" for i in range(dimensions) for n in ("dim", "all"))))
    pattern = reduce(lambda a, b: a + b, [F.col(f"__all_{i}").cast("int") * F.lit(1 << i) for i in range(dimensions)])
    cells = cells.withColumn("__set", pattern)
    sets = [r[0] for r in cells.select("__set").distinct().collect()]  # as many as the statement has grouping sets
    pairs = [(coarse, fine) for coarse in sets for fine in sets if coarse != fine and coarse & fine == fine]
    if not pairs:
        return []
    equations = F.array(*[
        F.when(F.col("__set").isin(coarse, fine), F.struct(F.lit(no).alias("pair"), (F.col("__set") == coarse).alias("total"), F.to_json(F.struct(*[F.when(F.lit(not coarse >> i & 1), F.col(f"__dim_{i}").cast("string")).alias(f"d{i}") for i in range(dimensions)])).alias("of")))
        for no, (coarse, fine) in enumerate(pairs)
    ])
    members = settled(cells.select("__place", "__hidden", "__size", F.explode(F.array_compact(equations)).alias("e")).select("*", "e.pair", "e.total", "e.of").drop("e"))
    with_total = Window.partitionBy("pair", "of")
    members = settled(members.withColumn("whole", F.max("total").over(with_total)).where("whole"))
    more: list[int] = []
    while True:
        now = members.withColumn("hidden", F.col("__hidden") | F.col("__place").isin(more)) if more else members.withColumn("hidden", F.col("__hidden"))
        # every hidden cell in its equations: as many rows as hidden cells times pairs of grouping sets
        unknown = now.where("hidden").select("__place", "pair", "of", "total").limit(MOST_HIDDEN * len(pairs) + 1).collect()
        if len({r[0] for r in unknown}) > MOST_HIDDEN:
            raise OutputTooLarge(f"more than {MOST_HIDDEN} cells are hidden; aggregate further")
        determined = _determined([(r[0], (r[1], r[2]), r[3]) for r in unknown])
        if not determined:
            return sorted(more)
        loose = now.withColumn("loose", F.max(F.col("__place").isin(determined)).over(with_total)).where("loose AND NOT hidden")
        order = Window.partitionBy("pair", "of").orderBy("total", "__size", "__place")
        found = {r[0] for r in loose.withColumn("no", F.row_number().over(order)).where("no = 1").select("__place").distinct().collect()}
        if not found:  # nothing is left to hide: all cells of these equations are hidden
            return sorted(more)
        more += sorted(found)


def _determined(unknown: list[tuple[int, tuple, bool]]) -> list[int]:
    """Cells that their equations determine: those alone in one first, else those that no solution of all equations leaves open."""
    by_equation: dict[tuple, list[tuple[int, bool]]] = {}
    for place, equation, total in unknown:
        by_equation.setdefault(equation, []).append((place, total))
    alone = sorted({members[0][0] for members in by_equation.values() if len(members) == 1})
    if alone or not unknown:
        return alone
    places = sorted({place for place, *_ in unknown})
    at = {place: k for k, place in enumerate(places)}
    matrix = np.zeros((len(by_equation), len(places)))
    for k, members in enumerate(by_equation.values()):
        for place, total in members:
            matrix[k, at[place]] += -1.0 if total else 1.0
    _, values, vectors = np.linalg.svd(matrix)
    free = vectors[int((values > 1e-9).sum()) :]
    return [place for place in places if not free.size or np.abs(free[:, at[place]]).max() < 1e-9]


class OutputTooLarge(ValueError):
    """A result that shows too much of the cohort."""


def validate_output_size(rows: int, cohort: int, fraction: float = 0.5) -> None:
    if cohort > 0 and rows > fraction * cohort:
        raise OutputTooLarge(f"{rows} rows are more than {fraction:.0%} of the cohort of {cohort}")
