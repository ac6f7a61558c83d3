"""Compiled predicates over frames: filter, evaluate, warn and summarize."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.analysis import analysed
from ..plans.lowering import WORD_BITS, Bag, Lowering, Origin, let
from .catalog import Catalog

CATEGORIES = ("data", "unanswered", "incomplete", "file")


@dataclass(frozen=True)
class Predicate:
    """truth: true, false, or NULL where there is no answer. opened: whether evaluation had to open the record."""

    text: str
    truth: Column
    opened: Column
    consumed: Column  # an array of the texts of the sources whose unusable occurrences were consumed
    origins: tuple[Origin, ...]

    def filter(self, df: DataFrame) -> DataFrame:
        """The rows for which the predicate is true; also on a stream, since no state is kept."""
        return df.filter(self.truth)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """All rows, with truth, warnings (one for each source, quoted as first written) and opened."""
        return df.withColumns({"truth": self.truth, "warnings": self.consumed, "opened": self.opened})


def compiled(text: str, catalog: Catalog) -> Predicate:
    """Raises PredicateError, with every error found, before any data is read."""
    tree = analysed(text, catalog)
    lowering = Lowering()
    bag = lowering.lower(tree, text)
    opened = F.lit(bag.opened) if isinstance(bag.opened, bool) else F.coalesce(bag.opened, F.lit(False))
    return Predicate(text, bag.values, opened, _quoted(bag, lowering.origins), tuple(lowering.origins))


def _quoted(bag: Bag, origins: list[Origin]) -> Column:
    """For each source the earliest of its mentions that was consumed."""
    by_source: dict[str, list[int]] = {}
    for i in sorted(range(len(origins)), key=lambda i: origins[i].start):
        if i // WORD_BITS in bag.reported:
            by_source.setdefault(origins[i].source, []).append(i)
    if not by_source:
        return F.array().cast("array<string>")

    def texts(words: Column) -> Column:
        seen = lambda i: F.coalesce(words[f"w{i // WORD_BITS}"], F.lit(0)).bitwiseAND(1 << i % WORD_BITS) != 0
        first = [F.coalesce(*(F.when(seen(i), F.lit(origins[i].text)) for i in mentions)) for mentions in by_source.values()]
        return F.filter(F.array(*first), lambda x: x.isNotNull())

    return let(F.struct(*(c.alias(f"w{w}") for w, c in bag.reported.items())), texts)


def data_message(source: Column) -> Column:
    return F.concat(F.lit("data that can't be read as its type was used: "), source)


def warnings(evaluated: DataFrame, key: str, suppressed: Iterable[str] = ()) -> DataFrame:
    """(key, category, message): `data` for each consumed source, `unanswered` for each row without an answer."""
    suppressed = set(CATEGORIES) if "all" in suppressed else set(suppressed)
    said = F.array().cast("array<struct<category:string,message:string>>")
    if "data" not in suppressed:
        said = F.transform("warnings", lambda w: F.struct(F.lit("data").alias("category"), data_message(w).alias("message")))
    if "unanswered" not in suppressed:
        alone = F.when(F.col("truth").isNull(), F.array(F.struct(F.lit("unanswered").alias("category"), F.lit("the predicate has no answer").alias("message"))))
        said = F.concat(said, F.coalesce(alone, F.array().cast("array<struct<category:string,message:string>>")))
    return evaluated.select(key, F.explode(said).alias("w")).select(key, "w.category", "w.message")


def tally(evaluated: DataFrame) -> DataFrame:
    """One row of counts: found, examined, matched, unanswered, warned."""
    return evaluated.agg(
        F.count("*").alias("found"),
        F.count("*").alias("examined"),
        F.count_if("truth").alias("matched"),
        F.count_if(F.col("truth").isNull()).alias("unanswered"),
        F.count_if(F.size("warnings") > 0).alias("warned"),
        F.count_if("opened").alias("opened"),
    )


def exit_code(run: Row | dict, warned: Iterable[str], strict: bool = True) -> int:
    """0 without strict; else 13 to 10 for file, incomplete, unanswered and data warnings, 21 none found, 20 none matched."""
    if not strict:
        return 0
    # A file that can't be read outranks one read in part, that a missing answer, that a defect.
    for code, category in ((13, "file"), (12, "incomplete"), (11, "unanswered"), (10, "data")):
        if category in set(warned):
            return code
    if run["found"] == 0:
        return 21
    return 20 if run["examined"] > 0 and run["matched"] == 0 else 0
