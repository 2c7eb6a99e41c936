"""The registry of repositories: a JSON file of path, alias and database path."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, alias string, db_path string"


def load_registry(path: str) -> list[dict]:
    if not os.path.exists(path):
        return []
    try:
        with open(path) as f:
            return json.load(f).get("repos", [])
    except (ValueError, AttributeError):
        return []


def save_registry(path: str, repos: list[dict]) -> None:
    tmp = f"{path}.new"
    with open(tmp, "w") as f:
        json.dump({"repos": repos}, f, indent=2)
    os.replace(tmp, path)


def register(path: str, repo: str, alias: str | None = None, db_path: str | None = None) -> list[dict]:
    repos = [r for r in load_registry(path) if r["path"] != repo] + [{"path": repo, "alias": alias or os.path.basename(repo.rstrip("/")), "db_path": db_path or os.path.join(repo, ".graphloom")}]
    save_registry(path, repos)
    return repos


def unregister(path: str, name: str) -> list[dict]:
    repos = [r for r in load_registry(path) if name not in (r["path"], r.get("alias"))]
    save_registry(path, repos)
    return repos


def repos(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(r["path"], r.get("alias"), r.get("db_path")) for r in load_registry(path)], SCHEMA)
