"""What several test modules use."""

from pathlib import Path


def rows_of(frame):
    """Rows of a pandas frame as comparable tuples, columns by name."""
    import math

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(float(v)) if isinstance(v, float) else str(v)

    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in row) for row in ordered.itertuples(index=False))


def duck(folder, tables=None):
    """DuckDB with the folder's tables as views."""
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        if tables is None or path.stem in tables:
            where = f"{path}/*.parquet" if path.is_dir() else str(path)
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{where}'")
    return con
