"""Size checks in front of broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Lookup tables up to this many rows and characters are sent to every executor.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 8_000_000


def _texts(df: DataFrame) -> list[tuple[Column, str]]:
    """Columns and fields of structs that have no fixed width, with their kind."""
    out = []
    for f in df.schema.fields:
        inner = f.dataType.fields if isinstance(f.dataType, T.StructType) else []
        named = [(F.col(f.name)[x.name], x.dataType) for x in inner] or [(F.col(f.name), f.dataType)]
        out += [(c, kind.typeName()) for c, kind in named if isinstance(kind, (T.StringType, T.ArrayType, T.MapType, T.StructType))]
    return out


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> bool:
    """Whether the table is within both bounds; looks at no more than ``max_rows`` + 1 rows.

    Texts count by their lengths, also inside structs; anything else has a fixed width.
    """
    chars = F.lit(0)
    for column, kind in _texts(df):
        chars = chars + F.coalesce(F.length(column) if kind == "string" else F.length(F.to_json(column)), F.lit(0))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(chars)).first()
    return n <= max_rows and (size or 0) <= max_chars


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table marked for broadcast when its measured size allows it.

    Beyond the bounds it is returned unmarked: the join is then a shuffle join
    whose skewed partitions adaptive execution splits.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df
