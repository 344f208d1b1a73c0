"""The same results in DuckDB SQL, written independently of the Spark plans."""

from .queries import ORACLES

__all__ = ["ORACLES"]
