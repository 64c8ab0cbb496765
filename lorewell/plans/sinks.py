"""Guarded sinks: a policy and path checks stand before every write; a write replaces its folder as one job."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

PROTECTED = (".git/", ".trash/", "Daily/", "Templates/")


class Refused(Exception):
    """A write that the policy does not allow."""


def can_write(tool: str, path: str, policy: dict[str, dict]) -> bool:
    """Unknown tools, tools that may not write, protected prefixes and unsafe paths are refused."""
    rule = policy.get(tool)
    return bool(rule and rule.get("write")) and safe_path(path) and not path.startswith(PROTECTED)


def safe_path(path: str) -> bool:
    """Relative, without parent steps, backslashes or control characters."""
    return bool(path) and not path.startswith("/") and ".." not in path.split("/") and not re.search(r"[\\\x00-\x1f\x7f]", path)


def write_guarded(df: DataFrame, root: str, path: str, tool: str, policy: dict[str, dict], dry_run: bool = True, mode: str = "overwrite") -> bool:
    """Write df as Parquet below root; a dry run (the default) checks only. Returns whether anything was written."""
    if not can_write(tool, path, policy):
        raise Refused(f"{tool} may not write {path}")
    if dry_run:
        return False
    df.write.mode(mode).parquet(f"{root.rstrip('/')}/{path}")
    return True


def append_log(df: DataFrame, root: str) -> None:
    """Append action-log rows as JSON lines."""
    df.write.mode("append").json(f"{root.rstrip('/')}/action-log")
