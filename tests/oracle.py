"""Runs a query and its SQL side by side, as sorted rows with columns in order of their names."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(v: object) -> tuple:
    return (v is None, str(type(v)) if not isinstance(v, int | float) else "", v if v is not None else 0)


def _plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def sorted_rows(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=lambda r: tuple(_key(v) for v in r))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), sorted_rows([tuple(r) for r in df.collect()], df.columns)


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for t in TABLES:
        at = Path(sf_dir, f"{t}.parquet")
        if at.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), sorted_rows(found.fetchall(), names)
