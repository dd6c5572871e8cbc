"""Listed paths as a table: which files they stand for, and in which place of the list."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLOB = re.compile(r"[*?\[\]{}\\]")
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(.*)$")
#: Files below a listed folder count at any depth, and each file once.
READ = {"recursiveFileLookup": "true"}


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _matches(spark: SparkSession, glob: str) -> list[str]:
    """Names of what a glob stands for, in one call however many they are."""
    found = spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(spark._jvm.org.apache.hadoop.fs.Path(glob))
    return [p for p in found.mkString("\0").split("\0") if p]


def qualified(paths: Sequence[str], default: str, working: str) -> list[str]:
    """Paths as a file listing names them: with scheme and authority, from the root, without ``.`` and ``..``.

    ``default`` is the default file system, ``working`` its working directory.
    """
    own = _SCHEME.match(default)
    base = (_SCHEME.match(working) or [working] * 4)[3]
    out = []
    for path in paths:
        found = _SCHEME.match(path)
        scheme, authority, rest = found.groups() if found else (own[1], own[2], path)
        if not authority and scheme == own[1]:
            authority = own[2]
        rest = posixpath.normpath(re.sub("/+", "/", rest if rest.startswith("/") else f"{base}/{rest}"))
        out.append(f"{scheme}:" + (f"//{authority}" if authority else "") + rest)
    return out


def _plain(spark: SparkSession, paths: Sequence[str], suffix: str) -> list[tuple[int, str]]:
    """(place, path) without globs: one for each path of the suffix, or match of a glob of the suffix."""
    system = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    default, working = system.getUri().toString(), system.getWorkingDirectory().toString()
    places, plain, expanded = [], [], {}
    for place, path in enumerate(paths):
        if not path.endswith(suffix):
            continue
        if GLOB.search(path):
            if path not in expanded:
                expanded[path] = _matches(spark, path)
            matches = expanded[path]
        else:
            matches = [path]
        places += [place] * len(matches)
        plain += matches
    return list(zip(places, qualified(plain, default, working)))


def _listed_files(spark: SparkSession, paths: Sequence[str], suffix: str) -> DataFrame:
    """Rows (path, source_path) of the files, not empty, below the paths of the suffix; contents are not read."""
    return (
        spark.read.format("binaryFile").options(**READ).load([p for p in dict.fromkeys(paths) if p.endswith(suffix)])
        .select("path", F.col("_metadata.file_path").alias("source_path"))
    )


def list_files(spark: SparkSession, paths: Sequence[str], suffix: str = "") -> DataFrame:
    """Rows (source_no, source_path): each file for each listed path that stands for it.

    A path is a file, a folder at any depth, or a glob of both; ``source_no`` is its
    place in ``paths``, of which only those that end with ``suffix`` are looked at, and ``source_path`` what Spark's readers name the file. Globs
    are expanded once through the file system, and a file is found by an equal join of
    itself and the folders above it with the listed paths. A path listed twice, or
    a file listed by itself and by its folder, counts for each. Files of zero
    bytes, which Spark's readers pass over, are not among them; see ``empty_files``.
    """
    listed = spark.createDataFrame(_plain(spark, paths, suffix), "source_no int, listed string")
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return (
        _listed_files(spark, paths, suffix)
        .select("source_path", F.explode(above).alias("listed"))
        .join(listed, "listed")
        .select("source_no", "source_path")
        .distinct()
    )


def empty_files(spark: SparkSession, paths: Sequence[str], suffix: str = "") -> DataFrame:
    """Rows (source_no, source_path) of files of zero bytes that listed paths stand for.

    Names come from the file systems, a call per folder; a table join leaves those
    that the listing of files with content does not know, and only these are looked at one by one.
    """
    plain = _plain(spark, paths, suffix)
    known = _listed_files(spark, paths, suffix).select("path")
    todo, seen, found = [path for _, path in plain], set(), []
    while todo:
        names = spark.createDataFrame([(p,) for p in dict.fromkeys(todo) if p not in seen], "path string")
        seen.update(todo)
        todo = []
        for (path,) in names.join(known, "path", "left_anti").collect():
            jvm_path, system = _file_system(spark, path)
            status = system.getFileStatus(jvm_path)
            if status.isDirectory():
                inside = _matches(spark, GLOB.sub(r"\\\g<0>", path) + "/*")
                # names with these first letters are no data for Spark
                todo += [p for p in inside if posixpath.basename(p)[:1] not in ("_", ".")]
            elif status.getLen() == 0:
                found.append((path, jvm_path.toUri().toString()))
    listed: dict[str, list[int]] = {}
    for place, path in plain:
        listed.setdefault(path, []).append(place)
    rows = []
    for path, name in found:
        steps = path.split("/")
        above = {"/".join(steps[: n + 1]) for n in range(len(steps))}
        rows += [(place, name) for up in above for place in listed.get(up, [])]
    return spark.createDataFrame(sorted(set(rows)), "source_no int, source_path string")
