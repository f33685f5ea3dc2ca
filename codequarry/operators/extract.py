"""Sources to rows, without an index on disk: fragments, symbols, comments and calls of each file."""

from __future__ import annotations

from collections.abc import Collection, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from codequarry.functions import code
from codequarry.operators.store import FACTS, STEP, edge_row, parts
from codequarry.ship import map_pandas


def rows(sources: DataFrame, kind: str, fields: Sequence[str] | None = None, *, min_mass: int = 15, generated_min_mass: int | None = None, kinds: Collection[str] | None = None) -> DataFrame:
    """path and fields of each fragment, definition, reference, comment or edge of sources (path, source).

    Only what fields name is made. kinds: no fragments, definitions or references of other kinds. A source that can't be parsed has no rows.
    Sources are dealt out first: parsing costs by their number, and a table of few bytes is read by few tasks.
    """
    if kind not in FACTS:
        raise ValueError(f"no such kind: {kind}")
    types = {f.split()[0].strip("`"): f for f in FACTS[kind].split(", ")}
    names = list(types) if fields is None else list(fields)
    if kinds is not None and "kind" not in types:
        raise ValueError(f"{kind} have no kinds")

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), STEP):
                paths, columns = [], [[] for _ in names]
                for path, source in zip(frame["path"][at : at + STEP], frame["source"][at : at + STEP]):
                    for r in code.facts(kind, path, source, min_mass=min_mass, generated_min_mass=generated_min_mass, fields=names, kinds=kinds):
                        r = edge_row(r) if kind == "edges" else r
                        paths.append(path)
                        for n, c in zip(names, columns):
                            c.append(r[n])
                yield pd.DataFrame({"path": paths} | {n: pd.Series(c, dtype=object) for n, c in zip(names, columns)})

    dealt = sources.select("path", "source").repartition(parts(sources.sparkSession), "path")
    return map_pandas(dealt, run, ", ".join(["path string", *(types[n] for n in names)]))
