"""From path specifications to the files a run looks at, each once.

A specification names a file, a folder (walked, with the links in it, except one that leads back onto the walk), or a
pattern: `?` and at most one `*`, in the last component alone. A pattern that finds nothing is no error.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import FORMATS


class PathError(ValueError):
    """Specifications that can't be resolved; nothing is processed."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


def extension(name: str) -> str | None:
    """After the last dot; None without one, with nothing after it, or where it leads the name."""
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem and ext else None


def candidate(path: str) -> bool:
    return (extension(os.path.basename(path)) or "").lower() in FORMATS


@dataclass
class Discovery:
    files: list[str] = field(default_factory=list)
    warnings: list[tuple[str, str]] = field(default_factory=list)  # (path, message)


@dataclass(frozen=True)
class _Pattern:
    folder: str | None  # None: there is no such folder, and nothing matches
    test: re.Pattern


def _listable(folder: str) -> bool:
    try:
        with os.scandir(folder) as entries:
            next(entries, None)
        return True
    except OSError:
        return False


def _pattern(spec: str) -> _Pattern | str:
    """What a specification with wildcards means, or what is wrong with it."""
    folder, name = os.path.split(spec)
    if spec.count("*") > 1:
        return "at most one *"
    if "*" in folder or "?" in folder:
        return "wildcards stand in the last component alone"
    shape = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in name), re.S | (re.I if os.name == "nt" else 0))
    folder = os.path.abspath(folder or ".")
    if not os.path.isdir(folder):
        return _Pattern(None, shape)
    return _Pattern(folder, shape) if _listable(folder) else "its folder can't be listed"


def resolve(specs: list[str]) -> list[str | _Pattern]:
    """Absolute paths and patterns, or PathError with every problem. What holds a wildcard is a pattern, whatever exists."""
    out: list[str | _Pattern] = []
    problems = []
    for spec in specs:
        if "*" in spec or "?" in spec:
            found = _pattern(spec)
            if isinstance(found, str):
                problems.append(f"{spec}: {found}")
            else:
                out.append(found)
        elif not os.path.exists(spec):
            problems.append(f"{spec}: not found")
        elif os.path.isdir(spec) and not _listable(spec):
            problems.append(f"{spec}: can't be listed")
        else:
            out.append(os.path.abspath(spec))
    if problems:
        raise PathError(problems)
    return out


def _real(path: str) -> str:
    """The path with its links resolved; as it is where they can't be, so that listing it fails and says so."""
    try:
        return os.path.realpath(path, strict=True)
    except (OSError, RuntimeError):
        return os.path.abspath(path)


def _entries(folder: str, above: tuple[str, ...], found: Discovery) -> tuple[list[str], list[tuple[str, tuple[str, ...]]]]:
    """A folder's files, and its folders with the real folders above them. A linked folder is left out where its target is
    one of these; a path of more links than the system follows (40 on Linux) can't be listed, a warning like any other."""
    files, deeper = [], []
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError as e:
        found.warnings.append((folder, f"can't be listed: {e.strerror}"))
        return [], []
    for e in entries:
        try:
            is_folder = e.is_dir()
        except OSError:
            is_folder = False
        if not is_folder:
            files.append(e.path)
            continue
        real = _real(e.path) if e.is_symlink() else os.path.join(above[-1], e.name)
        if not e.is_symlink() or real not in above:
            deeper.append((e.path, (*above, real)))
    return files, deeper


def _walk(root: str, found: Discovery) -> Iterator[str]:
    """Breadth first, to any depth."""
    level = [(root, (_real(root),))]
    while level:
        further = []
        for folder, above in level:
            files, deeper = _entries(folder, above, found)
            yield from files
            further += deeper
        level = further


def discovered(specs: list[str]) -> Discovery:
    """The candidate files of all specifications, each path once, in the order found."""
    out = Discovery()
    seen: dict[str, None] = {}
    for item in resolve(specs):
        if isinstance(item, _Pattern) and item.folder is None:
            continue
        if isinstance(item, _Pattern):
            tops = [os.path.join(item.folder, n) for n in sorted(os.listdir(item.folder)) if item.test.fullmatch(n)]
        else:
            tops = [item]
        for top in tops:
            for path in _walk(top, out) if os.path.isdir(top) else [top]:
                if candidate(path):
                    seen[path] = None
    out.files = list(seen)
    return out


# The same over columns, and over stores that Spark lists


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_column(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1), F.lit(""))


def only_candidates(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(F.lower(extension_column(base_name(F.col(path)))).isin(*FORMATS))


def distinct_paths(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first.dropDuplicates(["path"])


def files_frame(spark: SparkSession, files: list[str], per_task: int = 200) -> DataFrame:
    """A frame of paths, dealt by their number: reading the edges of a file takes alike for any size."""
    df = spark.createDataFrame([(f,) for f in files], "path string")
    return df.repartition(max(1, -(-len(files) // per_task)))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of folders: files, folders to go on with (and the real folders above them), and what couldn't be listed."""
    for b in batches:
        rows: list[tuple] = []
        for folder, above in zip(b["path"].to_pylist(), b["above"].to_pylist()):
            found = Discovery()
            files, deeper = _entries(folder, tuple(above), found)
            rows += [(f, None, None) for f in files] + [(p, list(x), None) for p, x in deeper] + [(p, None, m) for p, m in found.warnings]
        cols = list(zip(*rows)) or [[]] * 3
        kinds = (pa.string(), pa.list_(pa.string()), pa.string())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "above", "warning"])


def walked_frame(spark: SparkSession, folders: list[str], per_task: int = 50) -> DataFrame:
    """The candidate files below folders that all executors see, listed by them a level at a time: path, and a warning
    instead of a file where a folder can't be listed. The rules are those of the driver's own walk."""
    schema = "path string, above array<string>, warning string"
    level = spark.createDataFrame([(os.path.abspath(f), [_real(f)]) for f in dict.fromkeys(folders)], "path string, above array<string>")
    found, n = [], len(folders)
    while n:
        entries = level.repartition(max(1, -(-n // per_task))).mapInArrow(_listed, schema).persist()
        level = entries.filter("above IS NOT NULL").select("path", "above")
        n = level.count()
        found.append(entries.filter("above IS NULL").select("path", "warning"))
    every = functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "path string, warning string")
    warned = every.filter("warning IS NOT NULL")
    return distinct_paths(only_candidates(every.filter("warning IS NULL"))).unionByName(warned)


def store_frame(spark: SparkSession, root: str) -> DataFrame:
    """path and length of the candidate files below a folder of any store, which Spark lists in parallel; nothing is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return only_candidates(df.select("path", "length"))
