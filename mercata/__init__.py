"""mercata: commerce, risk and experiment analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus an optional column map and
literal parameters) and returns a lazy DataFrame. Work is expressed with the
DataFrame API so Catalyst prunes columns, pushes filters into the Parquet scan
and AQE picks join strategies and splits skewed partitions at run time.
"""

from mercata.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]
