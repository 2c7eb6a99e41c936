"""Command line: python -m graphloom.cli <command> ..."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .operators.aggregate import get_stats
from .operators.render import export_html, export_wiki
from .operators.store import Snapshots
from .service import GraphService
from .sources import registry, vcs
from .streaming.incremental import full_build, incremental_update, postprocess, watch


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="graphloom")
    ap.add_argument("--registry", default=os.path.expanduser("~/.graphloom/registry.json"))
    sub = ap.add_subparsers(dest="command", required=True)
    for name in ("build", "update", "status", "visualize", "wiki", "detect-changes", "postprocess", "watch"):
        p = sub.add_parser(name)
        p.add_argument("root")
        p.add_argument("--store")
        p.add_argument("--out", default=".")
        p.add_argument("--base", default="HEAD~1")
    for name in ("register", "unregister"):
        p = sub.add_parser(name)
        p.add_argument("repo")
        p.add_argument("--alias")
    sub.add_parser("repos")
    a = ap.parse_args(argv)
    if a.command in ("register", "unregister", "repos"):
        os.makedirs(os.path.dirname(a.registry) or ".", exist_ok=True)
        rows = registry.register(a.registry, os.path.abspath(a.repo), a.alias) if a.command == "register" else registry.unregister(a.registry, a.repo) if a.command == "unregister" else registry.load_registry(a.registry)
        for r in rows:
            print(r["alias"], r["path"])
        return 0
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    store = Snapshots(spark, a.store or os.path.join(a.root, ".graphloom"))
    if a.command == "build":
        print(full_build(spark, a.root, store))
    elif a.command == "update":
        print(incremental_update(spark, a.root, store)[0] or "nothing changed")
    elif a.command == "postprocess":
        print(postprocess(store))
    elif a.command == "status":
        get_stats(store.read("nodes"), store.read("edges")).orderBy("metric", "item").show(100, False)
    elif a.command == "watch":
        watch(spark, a.root, store, os.path.join(a.root, ".graphloom", "stream"), available_now=False).awaitTermination()
    elif a.command == "visualize":
        with open(os.path.join(a.out, "graph.html"), "w") as f:
            f.write(export_html(store.read("nodes"), store.read("edges")))
    elif a.command == "wiki":
        for name, text in export_wiki(store.read("nodes"), store.read("edges"), store.read("communities")).items():
            with open(os.path.join(a.out, name), "w") as f:
                f.write(text)
    else:
        files = vcs.changed_file_names(a.root, a.base)
        print(GraphService.open(store).detect_changes(files, vcs.diff_ranges(spark, a.root, a.base))["summary"].first().summary)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
