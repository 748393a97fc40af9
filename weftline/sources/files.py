"""Text files as documents: discovery, inclusion and exclusion, containment, strict decoding. Files are listed and judged by Spark."""

from __future__ import annotations

import fnmatch
import os
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WeftlineError
from ..tables import file_system

#: Fixed suffixes of text files.
SUFFIXES = (".c", ".cc", ".cfg", ".conf", ".cpp", ".css", ".csv", ".go", ".h", ".hpp", ".html", ".ini", ".java", ".js", ".json", ".jsx", ".md", ".mdx", ".php", ".py", ".rb", ".rs", ".rst", ".sh", ".sql", ".tex", ".toml", ".ts", ".tsx", ".txt", ".xml", ".yaml", ".yml")

#: Files of more bytes are not read.
MOST_BYTES = 512 << 20


def _segment(glob: str) -> str:
    """A glob inside one part of a path, as a regular expression of Python and Java."""
    part = fnmatch.translate(glob)
    return "(?:" + re.sub(r"\\[Zz]$", "", part).replace("(?s:", "(?:").replace(".*?", "[^/]*?").replace(".*", "[^/]*").replace("(?:.", "(?:[^/]") + ")"


def exclusions(patterns: tuple[str, ...]) -> list[str]:
    """Regular expressions of which one finds a path that is excluded: a pattern fits the whole relative path, the name, or the last parts
    of the path; a leading ``**/`` also stands for no folder."""
    out = []
    for given in patterns:
        glob = given.replace("\\", "/")
        while True:
            whole = re.sub(r"\\[Zz]$", r"$", fnmatch.translate(glob))
            out += [f"^{whole}", f"^(?:.*/)?(?=[^/]*$){whole}", "(?:^|/)" + "/".join(_segment(s) for s in glob.split("/")) + "$"]
            if not glob.startswith("**/"):
                break
            glob = glob[3:]
    return out


def inclusion(glob: str) -> str:
    """A glob below the base as a regular expression: ``**`` is any folders, none included."""
    parts = glob.replace("\\", "/").split("/")
    body = "".join("(?:[^/]+/)*" if p == "**" and k + 1 < len(parts) else ".*" if p == "**" else _segment(p) + ("/" if k + 1 < len(parts) else "") for k, p in enumerate(parts))
    return f"^{body}$"


def excluded(relative: str, patterns: tuple[str, ...]) -> bool:
    return any(re.search(p, relative) for p in exclusions(patterns))


def _any(column: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (column.rlike(p) for p in patterns), F.lit(False))


def relative_id(spark: SparkSession, path: Column, base: str) -> Column:
    """The part of a file's path below ``base``."""
    fs, root = file_system(spark, base)
    prefix = re.sub("^file:/+", "file:/", fs.makeQualified(root).toString().rstrip("/") + "/")
    return F.regexp_replace(F.replace(F.regexp_replace(path, "^file:/+", "file:/"), F.lit(prefix), F.lit("")), "^/", "")


def _input_paths(spark: SparkSession, base: str, inputs: tuple[str, ...]) -> list[str]:
    """The given files and folders, each of which must exist below ``base``."""
    out = []
    for given in inputs:
        if given.startswith("/") or "://" in given or ".." in given.split("/"):
            raise WeftlineError(f"{given!r} is no path below the base")
        path = f"{base.rstrip('/')}/{given}"
        fs, p = file_system(spark, path)
        if not fs.exists(p):
            raise WeftlineError(f"source does not exist: {path}")
        out.append(path)
    return out


def _inside(path: Column, base: str) -> Column:
    """Whether links lead out of a local base; other file systems have no links."""
    root = os.path.realpath(re.sub("^file:/+", "/", base))

    @F.pandas_udf("boolean")
    def inside(found: pd.Series) -> pd.Series:
        return found.map(lambda p: os.path.realpath(re.sub("^file:/+", "/", p)).startswith(root.rstrip("/") + "/"))

    return inside(path)


def chosen_files(spark: SparkSession, base: str, exclude: tuple[str, ...], suffixes: tuple[str, ...], include: tuple[str, ...], inputs: tuple[str, ...], protect: tuple[str, ...]) -> DataFrame:
    """path, document_id, length and modificationTime of the files that would be read; from the listing alone, no file is opened."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(_input_paths(spark, base, inputs) or base).select("path", "length", "modificationTime")
    own = own.withColumn("document_id", relative_id(spark, F.col("path"), base))
    own = own.where(F.lower(F.regexp_extract("document_id", r"(\.[^./]+)$", 1)).isin(*suffixes))
    if include and not inputs:
        own = own.where(_any(F.col("document_id"), [inclusion(g) for g in include]))
    own = own.where(~_any(F.col("document_id"), exclusions(exclude)))
    for p in protect:
        own = own.where((F.col("document_id") != p) & ~F.col("document_id").startswith(p.rstrip("/") + "/"))
    return own.dropDuplicates(["document_id"]) if inputs else own  # a file may be named and lie in a named folder


def read_documents(spark: SparkSession, base: str, exclude: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES, include: tuple[str, ...] = (), inputs: tuple[str, ...] = (), protect: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """document_id (path below ``base``), text, metadata, mtime_ns, size of the text files below ``base``: those among ``inputs`` (files or
    folders) or, without any, those that a glob of ``include`` fits (all without globs), but for excluded ones and the project's own state
    (``protect``: paths below the base). Files that lead out of the base by links, that have a NUL byte in the first 8192, that are not
    UTF-8, that have more than ``most_bytes``, or that changed while they were read are errors; a byte-order mark is dropped. Files are chosen
    by their names first; only the chosen ones are opened."""
    found = chosen_files(spark, base, exclude, suffixes, include, inputs, protect).select("path", "document_id", "length").collect()  # a row a file, as Spark's own list of files is
    if (large := next((f for f in found if f["length"] > most_bytes), None)) is not None:
        raise WeftlineError(f"{large['document_id']} has more than {most_bytes} bytes")
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", f["path"]) for f in found]  # names, not globs
    files = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    own = files.withColumn("document_id", relative_id(spark, F.col("path"), base))
    bad = F.when(F.locate("\0", F.substring("content", 1, 8192).cast("string")) > 0, "not a text file: ").when(F.octet_length("content") != F.col("length"), "the file changed while it was read: ")
    if file_system(spark, base)[0].getScheme() == "file":
        bad = F.when(~_inside(F.col("path"), base), "the file lies outside the base: ").otherwise(bad)
    text = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, "document_id"))).otherwise(F.validate_utf8(F.col("content").cast("string")))
    metadata = F.to_json(F.struct(F.unix_micros("modificationTime").alias("mtime_us"), F.col("document_id").alias("path"), F.col("length").alias("size")))
    return own.select("document_id", F.regexp_replace(text, "^﻿", "").alias("text"), metadata.alias("metadata"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def unique_ids(docs: DataFrame) -> DataFrame:
    """The documents, or an error that names an id that occurs twice."""
    twice = docs.groupBy("document_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two documents have the id {twice[0]['document_id']!r}")
    return docs
