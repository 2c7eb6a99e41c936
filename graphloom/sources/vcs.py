"""Version control as a source of changes: files and line ranges, read by the driver with a time limit."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import GIT_REF, SVN_REVISION
from ..operators.risk import parse_unified_diff

TIMEOUT_SECONDS = 30.0
MARKERS = (".git", ".svn")


def timeout_seconds() -> float:
    try:
        return float(os.environ.get("GRAPHLOOM_GIT_TIMEOUT", TIMEOUT_SECONDS))
    except ValueError:
        return TIMEOUT_SECONDS


def validate_git_ref(ref: str) -> bool:
    return re.fullmatch(GIT_REF.strip("^$"), ref) is not None


def validate_svn_revision(rev: str) -> bool:
    return re.match(SVN_REVISION, rev) is not None


def validate_repo_root(path: str) -> bool:
    return os.path.isdir(path) and any(os.path.exists(os.path.join(path, m)) for m in MARKERS)


def run_with_timeout(args: list[str], cwd: str) -> str:
    """Standard output, or nothing on any failure."""
    try:
        done = subprocess.run(args, cwd=cwd, capture_output=True, timeout=timeout_seconds())
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def changed_file_names(root: str, base: str = "HEAD~1") -> list[str]:
    if not validate_git_ref(base) or base.startswith("-"):
        return []
    return [x for x in run_with_timeout(["git", "diff", "--name-only", base, "--"], root).splitlines() if x]


def diff_text(root: str, base: str = "HEAD~1") -> str:
    """The unified diff without context lines, by git or svn."""
    if os.path.isdir(os.path.join(root, ".svn")):
        return run_with_timeout(["svn", "diff", "--diff-cmd", "diff", "-x", "-U0", "-r", base], root) if validate_svn_revision(base) else ""
    return run_with_timeout(["git", "diff", "--unified=0", base, "--"], root) if validate_git_ref(base) and not base.startswith("-") else ""


def diff_ranges(spark: SparkSession, root: str, base: str = "HEAD~1") -> DataFrame:
    diffs = spark.createDataFrame([(0, diff_text(root, base))], "diff_id int, diff string")
    return parse_unified_diff(diffs).select("file_path", "start", "end")
