"""Decoding a stream into one value that keeps what later records leave out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _told(json: Column, name: str, kind: str, clears: bool) -> Column:
    """A struct with the field's value if the document gives it, or a null that clears; else null."""
    v = F.try_parse_json(json)
    child, value = F.try_variant_get(v, f"$['{name}']", "variant"), F.try_variant_get(v, f"$['{name}']", kind)
    return F.when(value.isNotNull() | (child.isNotNull() & F.is_variant_null(child) if clears else F.lit(False)), F.struct(value.alias("x")))


def carry_forward(df: DataFrame, json: str, fields: dict[str, str], order: list[Column], partition: list[str], clears: tuple[str, ...] = ()) -> DataFrame:
    """Each field takes the last value that its or an earlier record gave.

    fields: name to type.  An explicit null leaves a field as it was, or clears
    it if it is in `clears`.  The order must be total within a partition; give a
    partition key, or one task sorts all rows.
    """
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    for name, kind in fields.items():
        out = out.withColumn(name, F.last(_told(F.col(json), name, kind, name in clears), ignorenulls=True).over(w)["x"])
    return out


def carry_forward_stream(df: DataFrame, json: str, fields: dict[str, str], key: str, order: str, clears: tuple[str, ...] = ()) -> DataFrame:
    """The same on a stream: the state of a key is its fields' last values; rows of a batch go by `order`.

    Documents are decoded to typed columns before the stateful step, by the
    expressions of the batch form, so a misfit is a field that was not told.  A
    batch holds a key's new rows at once: bound it at the source.
    """
    names = list(fields)
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, " + ", ".join(f"{n} {k}" for n, k in fields.items())
    told = df.select(F.col(key).alias("key"), F.col(order).alias("order"), *[_told(F.col(json), n, k, n in clears).alias(f"told{i}") for i, (n, k) in enumerate(fields.items())])

    def sent(i: int, kind: str) -> list[Column]:
        # pandas would turn integers beside nulls into doubles: an integer goes as 0 beside the flag that it is null
        x = F.col(f"told{i}.x")
        whole = kind.lower() in ("tinyint", "byte", "smallint", "short", "int", "integer", "bigint", "long")
        return [F.col(f"told{i}").isNotNull().alias(f"is{i}"), x.isNull().alias(f"null{i}"), (F.coalesce(x, F.lit(0).cast(kind)) if whole else x).alias(f"x{i}")]

    given = told.select("key", "order", *[c for i, k in enumerate(fields.values()) for c in sent(i, k)])

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [None] * len(names)
        rows = pd.concat(list(batches)).sort_values("order", kind="stable")
        out = {key: [k[0]] * len(rows), order: rows["order"]}
        for i, n in enumerate(names):
            known = [now[i], *(None if null else x for x, null in zip(rows[f"x{i}"].tolist(), rows[f"null{i}"].tolist(), strict=True))]
            last = np.maximum.accumulate(np.append(0, np.where(rows[f"is{i}"].to_numpy(dtype=bool), np.arange(1, len(rows) + 1), 0)))
            values = [known[j] for j in last]
            out[n], now[i] = pd.Series(values[1:], dtype=object, index=rows.index), values[-1]
        state.update(tuple(now))
        yield pd.DataFrame(out)

    return given.groupBy("key").applyInPandasWithState(run, schema, ", ".join(f"{n} {k}" for n, k in fields.items()), "append", "NoTimeout")
