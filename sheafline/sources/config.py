"""Settings of a run, from a file beside what is bundled."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Files that settings are looked for in, in this order.
CONFIG_FILES = (".sheaflinerc", ".sheaflinerc.json", "sheafline.config.json")


def _read(path: str) -> dict | None:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def settings(defaults: Mapping[str, object], base: str = ".", path: str | None = None) -> dict[str, object]:
    """``defaults`` under the settings of ``path``, or of the first of ``CONFIG_FILES`` that holds any.

    A file that is missing, or isn't a JSON object, is passed over.
    """
    names = [path] if path else []
    for name in (*names, *CONFIG_FILES):
        found = _read(os.path.join(base, name))
        if found is not None:
            return {**defaults, **found}
    return dict(defaults)


def item_tree(spark: SparkSession, path: str) -> DataFrame:
    """``(id, parent_id, ord, author, created, text, dead)`` of a discussion told as nested JSON (S15): one row an item.

    Each file holds one item with its ``children``, which hold items again.
    """
    from collections.abc import Iterator

    import pandas as pd

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["value"]:
                todo = [(json.loads(raw), None, 0)]
                while todo:
                    x, parent, k = todo.pop()
                    out.append((x.get("id"), parent, k, x.get("author"), x.get("created_at"), x.get("text"), x.get("author") is None and x.get("text") is None))
                    todo += [(c, x.get("id"), i) for i, c in enumerate(x.get("children") or [])]
            cols = ("id", "parent_id", "ord", "author", "created", "text", "dead")
            kinds = ("Int64", "Int64", "int64", "object", "object", "object", "bool")
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=t) for i, (c, t) in enumerate(zip(cols, kinds))})

    raw = spark.read.text(path, wholetext=True)
    return raw.mapInPandas(flat, "id long, parent_id long, ord long, author string, created string, text string, dead boolean")
