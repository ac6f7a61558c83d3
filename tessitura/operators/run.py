"""The two commands over audio files, `list` and `hash`: results, warnings, a summary and an exit code."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.discover import discovered, files_frame
from ..sources.reader import AudioCatalog, layouts
from ..sources.window import Policy
from .predicate import CATEGORIES, Predicate, compiled, data_message, exit_code

ALGORITHMS = ("md5", "sha1")
FORMATS = ("plain", "json")


def choice(written: str | None, known: tuple[str, ...]) -> str:
    """One of the known names, whatever its case; the first for a blank."""
    name = (written or "").strip().lower()
    if name and name not in known:
        raise ValueError(f"{written} is none of {', '.join(known)}")
    return name or known[0]


def suppressed(written: str | None) -> frozenset[str]:
    """The warning categories that --no-warn names; None is no such option.

    An empty value is a mistake, since to silence everything must not be a slip; so is an empty item. White space
    alone means every category.
    """
    if written is None:
        return frozenset()
    if not written:
        raise ValueError(f"--no-warn needs categories: {', '.join((*CATEGORIES, 'all'))}")
    if not written.strip():
        return frozenset(CATEGORIES)
    names = [w.strip().lower() for w in written.split(",")]
    if bad := [n for n in names if n not in (*CATEGORIES, "all")]:
        raise ValueError(f"no warning category {bad[0]!r}")
    return frozenset(CATEGORIES if "all" in names else names)


@dataclass
class Run:
    """Rows by file (path, hash), warnings (path, category, message), and the counts of the whole run.

    All three are made of `files`; whoever needs more than one of them persists it, so that each file is read once.
    """

    files: DataFrame
    rows: DataFrame
    warnings: DataFrame
    counts: DataFrame
    walked: list[tuple[str, str]] = field(default_factory=list)  # warnings of the walk


def judged(files: DataFrame, predicate: Predicate | None, catalog: AudioCatalog | None, algorithm: str | None = None, policy: Policy = Policy()) -> DataFrame:
    """Files with their disposition: matched, unmatched or unreadable; the truth, what was consumed, and the hash."""
    if predicate is None and algorithm is None:  # nothing is opened
        return files.select("path", F.lit("matched").alias("disposition"), F.lit(True).alias("truth"), F.array().cast("array<string>").alias("warnings"), F.lit(False).alias("opened"), F.lit(False).alias("incomplete"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("hash"))
    read = layouts(files, catalog.requests if catalog else None, algorithm, policy)
    if predicate is None:
        ok = F.col("readable")
        return read.select("path", F.when(ok, "matched").otherwise("unreadable").alias("disposition"), F.lit(True).alias("truth"), F.array().cast("array<string>").alias("warnings"), F.lit(True).alias("opened"), (ok & F.col("incomplete")).alias("incomplete"), "error", "hash")
    return disposed(predicate.evaluate(read), bool(algorithm))


def disposed(seen: DataFrame, hashed: bool = False) -> DataFrame:
    """Evaluated files with their disposition; a file that had to be opened and can't be read has no truth and no defects."""
    lost = F.col("opened") & ~F.col("readable")
    return seen.select(
        "path",
        F.when(lost, "unreadable").when(F.col("truth"), "matched").otherwise("unmatched").alias("disposition"),
        F.when(lost, F.lit(False)).otherwise(F.col("truth")).alias("truth"),
        F.when(lost, F.array().cast("array<string>")).otherwise(F.col("warnings")).alias("warnings"),
        "opened",
        (F.col("opened") & ~lost & F.col("incomplete")).alias("incomplete"),
        F.when(lost, F.col("error")).alias("error"),
        *(["hash"] if hashed else [F.lit(None).cast("string").alias("hash")]),
    )


# Stages: from frame to frame, to be put one after another

Stage = Callable[[DataFrame], DataFrame]


def then(*stages: Stage) -> Stage:
    """One stage of several, each working on what the one before gives; none leaves the frame as it is."""
    return lambda df: functools.reduce(DataFrame.transform, stages, df)


def judging(predicate: Predicate | None, catalog: AudioCatalog | None, algorithm: str | None = None, policy: Policy = Policy()) -> Stage:
    return lambda files: judged(files, predicate, catalog, algorithm, policy)


def matching(files: DataFrame) -> DataFrame:
    return files.filter(F.col("disposition") == "matched")


def rendering(style: str, algorithm: str | None = None) -> Stage:
    return lambda rows: (objects if style == "json" else plain)(rows, algorithm)


def warnings_of(files: DataFrame, silent: Iterable[str] = ()) -> DataFrame:
    w = lambda category, message: F.struct(F.lit(category).alias("category"), message.alias("message"))
    none = F.array().cast("array<struct<category:string,message:string>>")
    said = F.concat(
        F.coalesce(F.when(F.col("disposition") == "unreadable", F.array(w("file", F.coalesce("error", F.lit("can't be read"))))), none),
        F.transform("warnings", lambda s: w("data", data_message(s))),
    )
    return files.select("path", F.explode(said).alias("w")).select("path", "w.category", "w.message").filter(~F.col("category").isin(*silent) if silent else F.lit(True))


def counts_of(files: DataFrame) -> DataFrame:
    """One row: found, examined, matched, unanswered, opened, incomplete, unreadable, defective."""
    read = F.col("disposition") != "unreadable"
    return files.agg(
        F.count("*").alias("found"),
        F.count_if(read).alias("examined"),
        F.count_if(F.col("disposition") == "matched").alias("matched"),
        F.count_if(read & F.col("truth").isNull()).alias("unanswered"),
        F.count_if("opened").alias("opened"),
        F.count_if("incomplete").alias("incomplete"),
        F.count_if(~read).alias("unreadable"),
        F.count_if(F.size("warnings") > 0).alias("defective"),
    )


def run(spark: SparkSession, specs: list[str], where: str | None = None, algorithm: str | None = None, silent: Iterable[str] = (), policy: Policy = Policy()) -> Run:
    """Everything about a run, lazily; predicate and path errors are raised before any file is opened."""
    catalog = AudioCatalog()
    predicate = compiled(where, catalog) if where is not None else None
    found = discovered(specs)
    files = files_frame(spark, found.files).transform(judging(predicate, catalog, algorithm, policy))
    shown = files.transform(then() if algorithm else matching)
    return Run(files, shown.select("path", "hash"), warnings_of(files, silent), counts_of(files), found.warnings)


def _some(n: int, of: int, one: str, many: str, said: str) -> str:
    """How many of a run's files something is said of: the only one, one, all, or some."""
    if n == of:
        return f"{'the only' if of == 1 else 'all'} {f'{of} {many}' if of > 1 else one} {said}"
    return f"{n} of {of} {many} {said}"


def last_warnings(counts: Row, silent: Iterable[str] = ()) -> list[tuple[str, str]]:
    """What is said at the end of a run."""
    out = []
    if n := counts["unanswered"]:
        out.append(("unanswered", _some(n, counts["examined"], "examined file", "examined files", f"{'has' if n == 1 else 'have'} no answer and {'is' if n == 1 else 'are'} left out")))
    if n := counts["incomplete"]:
        out.append(("incomplete", _some(n, counts["opened"], "opened file", "opened files", f"{'was' if n == 1 else 'were'} read in part")))
    return [(c, m) for c, m in out if c not in silent]


def status(counts: Row, walked: list, silent: Iterable[str] = (), strict: bool = True) -> int:
    produced = {"file": counts["unreadable"] + len(walked), "incomplete": counts["incomplete"], "unanswered": counts["unanswered"], "data": counts["defective"]}
    return exit_code(counts, [c for c, n in produced.items() if n and c not in silent], strict)


# Sinks


def plain(rows: DataFrame, algorithm: str | None = None) -> DataFrame:
    """One line for each row: the path, and with an algorithm its name and the hash, - for none."""
    line = F.concat_ws(" ", "path", F.lit(algorithm), F.coalesce("hash", F.lit("-"))) if algorithm else F.col("path")
    return rows.select(line.alias("line"))


def objects(rows: DataFrame, algorithm: str | None = None) -> DataFrame:
    """One JSON object for each row, nulls included."""
    made = F.struct(F.col("path").alias("file"), *([F.lit(algorithm).alias("algo"), F.col("hash")] if algorithm else []))
    return rows.select(F.to_json(made, {"ignoreNullFields": "false"}).alias("line"))


_ESCAPED = {c: f"\\u{ord(c):04X}" for c in "<>&'+`"}


def _escape(m: re.Match) -> str:
    """Escapes in upper case, a quote among them."""
    return "\\u0022" if m[1] == '"' else "\\u" + m[1][1:].upper() if m[1][0] == "u" and len(m[1]) == 5 else m[0]


def json_array(rows: DataFrame, algorithm: str | None = None) -> Iterator[str]:
    """An indented JSON array, a row at a time; outside ASCII, and where HTML might mind, characters are escaped."""
    first = True
    for r in objects(rows, algorithm).toLocalIterator():
        text = re.sub(r"\\(u[0-9a-f]{4}|.)", _escape, json.dumps(json.loads(r["line"]), indent=2))
        text = "".join(_ESCAPED.get(c, c) for c in text)
        yield ("[\n" if first else ",\n") + "\n".join("  " + x for x in text.split("\n"))
        first = False
    yield "[]\n" if first else "\n]\n"
