"""What is shown: graph data for a browser, an HTML page around it, and wiki pages in Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import community_slug, escape_html, node_color
from .aggregate import external_deps

PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<script src="https://d3js.org/d3.v7.min.js"></script></head>
<body><svg id="graph" width="1200" height="800"></svg>
<script>const graph = {data};
const svg = d3.select("#graph");
const link = svg.append("g").selectAll("line").data(graph.links).join("line").attr("stroke", "#999");
const node = svg.append("g").selectAll("circle").data(graph.nodes).join("circle").attr("r", 5).attr("fill", d => d.color);
node.append("title").html(d => d.label + " (" + d.kind + ") " + d.file);
d3.forceSimulation(graph.nodes).force("link", d3.forceLink(graph.links).id(d => d.id)).force("charge", d3.forceManyBody())
  .force("center", d3.forceCenter(600, 400)).on("tick", () => {{
  link.attr("x1", d => d.source.x).attr("y1", d => d.source.y).attr("x2", d => d.target.x).attr("y2", d => d.target.y);
  node.attr("cx", d => d.x).attr("cy", d => d.y); }});
</script></body></html>
"""


def viz_nodes(nodes: DataFrame, max_nodes: int = 500) -> DataFrame:
    """Symbols first, then files, in id order, up to ``max_nodes``."""
    first = nodes.orderBy(F.when(F.col("kind") == "File", 1).otherwise(0), "id").limit(max_nodes)
    return first.select("id", escape_html("name").alias("label"), "kind", escape_html("file_path").alias("file"), node_color("kind").alias("color"), F.col("community_id").alias("community"), "qualified_name")


def viz_links(nodes: DataFrame, edges: DataFrame, max_nodes: int = 500) -> DataFrame:
    """Edges among the shown nodes, by id."""
    shown = viz_nodes(nodes, max_nodes).select("qualified_name", "id")
    return edges.join(shown.toDF("source_qualified", "source"), "source_qualified").join(shown.toDF("target_qualified", "target"), "target_qualified").select("source", "target", "kind", edges["id"].alias("edge_id"))


def export_html(nodes: DataFrame, edges: DataFrame, title: str = "Code Graph", max_nodes: int = 500) -> str:
    shown = [r.asDict() for r in viz_nodes(nodes, max_nodes).drop("qualified_name").orderBy("id").collect()]
    links = [{"source": r.source, "target": r.target, "kind": r.kind} for r in viz_links(nodes, edges, max_nodes).orderBy("edge_id").collect()]
    safe = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return PAGE.format(title=safe, data=json.dumps({"nodes": shown, "links": links}).replace("</", "<\\/"))


def wiki_index(communities: DataFrame) -> DataFrame:
    """(position, line): the communities as a Markdown table, largest first."""
    w = Window.orderBy(F.desc("size"), "id")
    row = F.format_string("| [%s](%s.md) | %d | %s | %s |", F.col("name"), community_slug("name", "id"), F.col("size"), F.coalesce("dominant_language", F.lit("—")), F.regexp_replace(F.coalesce("description", F.lit("TODO")), "\n", " "))
    return communities.select(F.row_number().over(w).cast("long").alias("position"), row.alias("line"))


def wiki_page(nodes: DataFrame, edges: DataFrame, communities: DataFrame, community_id: int) -> DataFrame:
    """(section, position, line) of a community's page: header, up to 20 symbols, up to 10 outside dependencies."""
    c = communities.filter(F.col("id") == community_id)
    head = c.select(F.lit("header").alias("section"), F.posexplode(F.array(F.format_string("# %s", "name"), F.format_string("**Size**: %d functions/classes  ", "size"), F.format_string("**Language**: %s  ", F.coalesce("dominant_language", F.lit("unknown"))), F.format_string("**Purpose**: %s", F.coalesce("description", F.lit("TODO"))))).alias("position", "line"))
    own = nodes.filter((F.col("community_id") == community_id) & F.col("kind").isin("Function", "Class")).orderBy("name", "qualified_name").limit(20)
    symbols = own.select(F.lit("symbols").alias("section"), (F.row_number().over(Window.orderBy("name", "qualified_name")) - 1).alias("position"), F.format_string("- `%s` (%s) in `%s`", "name", "kind", "file_path").alias("line"))
    deps = external_deps(nodes, edges).filter(F.col("community_id") == community_id)
    deps = deps.select(F.lit("dependencies").alias("section"), (F.col("position") - 1).cast("int").alias("position"), F.format_string("- `%s` (referenced %d time(s))", "dependency", "ref_count").alias("line"))
    return head.unionByName(symbols).unionByName(deps).withColumn("position", F.col("position").cast("long"))


def export_wiki(nodes: DataFrame, edges: DataFrame, communities: DataFrame, describe=None) -> dict[str, str]:
    """File name -> Markdown of the index and every page. describe: an optional function of a community row that
    gives a text of its own for the purpose (a language model, for one); where it fails the stored one stays."""
    rows = communities.orderBy(F.desc("size"), "id").select("*", community_slug("name", "id").alias("slug")).collect()
    index = [r.line for r in wiki_index(communities).orderBy("position").collect()]
    head = "# Code Graph Wiki\n\nAuto-generated from the knowledge graph.\n\n## Communities\n\n"
    pages = {"index.md": head + ("| Community | Size | Language | Description |\n|-----------|------|----------|-------------|\n" + "".join(f"{x}\n" for x in index) if index else "*No communities detected yet. Run a build first.*\n")}
    for r in rows:
        lines = wiki_page(nodes, edges, communities, r.id).orderBy("position").collect()
        part = {s: [x.line for x in lines if x.section == s] for s in ("header", "symbols", "dependencies")}
        if describe is not None:
            try:
                part["header"][-1] = f"**Purpose**: {describe(r)}"
            except Exception:  # noqa: BLE001  the stored description is good enough
                pass
        text = part["header"][0] + "\n\n" + "\n".join(part["header"][1:]) + "\n\n"
        if part["symbols"]:
            text += "## Key Symbols\n\n" + "\n".join(part["symbols"]) + "\n"
        text += "\n## Dependencies (top 10 by frequency)\n\n" + ("\n".join(part["dependencies"]) + "\n" if part["dependencies"] else "*No external dependencies detected.*\n")
        pages[f"{r.slug}.md"] = text
    return pages
