"""Source files as a scan: known languages, skipped folders, size limit, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 5 * 1024 * 1024
#: Folders that hold no source.
IGNORED_DIRS = ("node_modules", ".git", "target", "__pycache__", ".tox", "dist", "build", ".next", ".nuxt", "venv", ".venv", "env", "vendor")
#: Language by file extension.
EXTENSIONS = {
    "python": "py pyw ipynb", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts", "tsx": "tsx", "rust": "rs", "go": "go", "java": "java", "kotlin": "kt kts", "c_sharp": "cs",
    "cpp": "cpp cc cxx c++ hh hpp", "c": "c h", "ruby": "rb", "php": "php", "swift": "swift", "lua": "lua", "luau": "luau", "r": "r R", "scala": "scala", "elixir": "ex exs", "dart": "dart",
    "vue": "vue", "svelte": "svelte", "haskell": "hs", "ocaml": "ml mli", "julia": "jl", "perl": "pl pm t", "bash": "sh bash zsh ksh", "nix": "nix", "solidity": "sol", "gdscript": "gd",
    "rescript": "res resi", "verilog": "v sv svh vh", "objc": "m", "sql": "sql", "hcl": "tf hcl", "toml": "toml", "json": "json", "yaml": "yaml yml", "zig": "zig", "powershell": "ps1 psm1 psd1",
}
LANGUAGE_OF = {ext: lang for lang, exts in EXTENSIONS.items() for ext in exts.split()}


def detect_language(path):
    """Language of a path column by its extension, case counts; null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    name = F.element_at(F.split(path, "/"), -1)
    return F.try_element_at(table, F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def select_sources(spark: SparkSession, files: DataFrame, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, content, file_hash) of those files of a binaryFile source that are source code.

    Paths become relative to ``root``. Hidden folders other than ``.github`` and folders of build products are skipped;
    larger files too. The same rule serves scans and streams.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    plain = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^/+", "/")
    rel = F.substr(plain, F.lit(len(full) + 2))
    dirs = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    out = files.filter(F.col("length") <= max_bytes).select(rel.alias("path"), "content", dirs.alias("dirs")).withColumn("language", detect_language(F.col("path")))
    skipped = F.exists("dirs", lambda d: d.isin(*IGNORED_DIRS) | (d.startswith(".") & (d != ".github")))
    return out.filter(F.col("language").isNotNull() & ~skipped).select("path", "language", "content", F.sha2("content", 256).alias("file_hash"))


def scan_files(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The source files below ``root``."""
    return select_sources(spark, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, max_bytes)


def changed_files(scanned: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, change): files that are new, changed by hash, or gone, against the stored File nodes."""
    had = nodes.filter("kind = 'File'").select(F.col("file_path").alias("path"), F.coalesce("file_hash", F.lit("")).alias("old_hash"))
    both = scanned.select("path", "file_hash").join(had, "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("file_hash").isNull(), "deleted").when(F.col("file_hash") != F.col("old_hash"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")
