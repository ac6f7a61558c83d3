"""The engine's operators as queries over the driver's tables, each with SQL that gives the same rows.

Records are rows whose fields are bags: an order with its lines (some have none), a part with the words of its name,
a user with their events, a document with its words. Predicates answer for every record, so that "false" and "no
answer" are told apart. Audio comes from files that are built in memory.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import interpret, text
from .functions.convert import number_from_text, text_of
from .operators.catalog import Catalog, frame_catalog
from .operators.predicate import compiled, exit_code, tally, warnings
from .operators.run import ALGORITHMS, choice, counts_of, json_array, judged, judging, matching, objects, plain, rendering, suppressed, then, warnings_of
from .plans.diagnostics import PredicateError, closest
from .plans.syntax import parse, printed
from .sources import samples as made
from .sources.discover import base_name, discovered, distinct_paths, extension_column, only_candidates, walked_frame
from .sources.reader import AudioCatalog, faults, layouts
from .sources.window import in_memory

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _found[name] = (f, sql)
        return f

    return keep


# Record sets, in Spark and in SQL

_SQL_SETS = {
    "orders": """bags AS (SELECT l_orderkey, list(l_returnflag) AS flag, list(l_quantity) AS qty, list(l_linenumber) AS line FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS total, string_split(o_orderpriority, '-') AS prio, flag, qty, line FROM orders LEFT JOIN bags ON o_orderkey = l_orderkey)""",
    "parts": "r AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS words, string_split(p_brand, '#') AS brand, p_size AS size, p_type AS type FROM part)",
    "users": """r AS (SELECT user_id AS k, list(event_type) AS etype, list(value) AS value, list(regexp_extract(props, ':\\s*([0-9]+)', 1)) AS prop FROM events GROUP BY user_id)""",
    "docs": "r AS (SELECT doc_id AS k, text, lang, source, n_chars FROM documents)",
}


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over all cores, where they come from fewer files than there are cores; any larger input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def _set(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, Catalog]:
    key = {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"], "events": ["user_id"]}
    read = lambda t: dealt(spark.read.parquet(f"{sf_dir}/{t}.parquet"), *key.get(t, []))
    if name == "orders":
        bags = read("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flag"), F.collect_list("l_quantity").alias("qty"), F.collect_list("l_linenumber").alias("line"))
        df = read("orders").join(bags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        df = df.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.split("o_orderpriority", "-").alias("prio"), "flag", "qty", "line")
        kinds = {"status": ("string", "1..1"), "total": ("number", "1..1"), "prio": ("string", "0..n"), "flag": ("string", "0..n"), "qty": ("number", "0..n"), "line": ("number", "0..n")}
    elif name == "parts":
        df = read("part").select(F.col("p_partkey").alias("k"), F.split("p_name", " ").alias("words"), F.split("p_brand", "#").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))
        kinds = {"words": ("string", "0..n"), "brand": ("string", "0..n"), "size": ("bytecount", "1..1"), "type": ("string", "1..1")}
    elif name == "users":
        df = read("events").groupBy(F.col("user_id").alias("k")).agg(F.collect_list("event_type").alias("etype"), F.collect_list("value").alias("value"), F.collect_list(F.regexp_extract("props", r":\s*([0-9]+)", 1)).alias("prop"))
        kinds = {"etype": ("string", "0..n"), "value": ("number", "0..n"), "prop": ("string", "0..n")}
    else:
        df = read("documents").select(F.col("doc_id").alias("k"), "text", "lang", "source", "n_chars")
        kinds = {"text": ("string", "1..1"), "lang": ("string", "1..1"), "source": ("string", "0..1"), "n_chars": ("bytecount", "1..1")}
    return df, frame_catalog(df, kinds)


def some(bag: str, test: str) -> str:
    """SQL: three-valued "some x of the bag", false for an absent one."""
    return f"CASE WHEN {bag} IS NULL THEN false WHEN len(list_filter({bag}, lambda x: {test})) > 0 THEN true WHEN len(list_filter({bag}, lambda x: ({test}) IS NULL)) > 0 THEN NULL ELSE false END"


def each(bag: str, test: str) -> str:
    return f"CASE WHEN {bag} IS NULL THEN false WHEN len(list_filter({bag}, lambda x: NOT ({test}))) > 0 THEN false WHEN len(list_filter({bag}, lambda x: ({test}) IS NULL)) > 0 THEN NULL ELSE true END"


def _answers(name: str, records: str, predicate: str, truth: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, catalog = _set(spark, sf_dir, records)
        return df.select("k", compiled(predicate, catalog).truth.alias("truth"))

    _found[name] = (run, f"WITH {_SQL_SETS[records]} SELECT k, ({truth}) AS truth FROM r")


_NUM = "regexp_full_match(x, '[+-]?([0-9]+(\\.[0-9]+)?|\\.[0-9]+)')"
_AS_NUM = f"CASE WHEN {_NUM} THEN CAST(x AS DECIMAL(38, 9)) END"

for _name, _records, _predicate, _truth in (
    ("c1_equal", "orders", 'flag == "r"', some("flag", "lower(x) = 'r'")),
    ("c2_not_equal", "orders", 'ALL(flag) != "r"', each("flag", "lower(x) <> 'r'")),
    ("c3_less", "orders", "qty < 3", some("qty", "x < 3")),
    ("c4_less_or_equal", "orders", "ALL(qty) <= 30", each("qty", "x <= 30")),
    ("c5_greater", "orders", "total > 100000", "total > 100000"),
    ("c6_greater_or_equal", "orders", "qty >= 49.5", some("qty", "x >= 49.5")),
    ("c7_some_some", "orders", "qty == line", some("qty", "list_contains(line, CAST(x AS INTEGER)) AND x = floor(x)")),
    ("c8_each_each", "orders", "ALL(qty) > ALL(line)", each("qty", "x > list_max(line)")),
    ("c9_each_some", "orders", "qty == ALL(line)", each("line", "list_contains(qty, CAST(x AS DOUBLE))")),
    ("c10_conditions_equal", "orders", '(flag == "r") == (total > 100000)', f"({some('flag', chr(39).join(('lower(x) = ', 'r', '')))}) = (total > 100000)"),
    ("r1_between", "orders", "qty BETWEEN 10..12", some("qty", "x BETWEEN 10 AND 12")),
    ("r2_between_strings", "parts", 'words BETWEEN "ma".."mo"', some("words", "substr(lower(x), 1, 2) BETWEEN 'ma' AND 'mo'")),
    ("x1_match", "parts", 'words =~ r"^[a-f].*e$"', some("words", "regexp_matches(lower(x), '^[a-f].*e$')")),
    ("x1_match_literally", "parts", 'LITERALLY(type) =~ r"[A-Z]{4}"', "regexp_matches(type, '[A-Z]{4}')"),
    ("t1_absent", "orders", "flag IS ABSENT", "flag IS NULL"),
    ("t2_usable", "orders", "ALL(prio AS NUMBER) IS USABLE", each("prio", _NUM)),
    ("t3_unusable", "orders", "prio AS NUMBER IS UNUSABLE", some("prio", f"NOT {_NUM}")),
    ("t4_unanswered", "orders", "(prio AS NUMBER > 3) IS UNUSABLE", f"({some('prio', f'({_AS_NUM}) > 3')}) IS NULL"),
    ("l1_not", "orders", "NOT prio AS NUMBER > 3", f"NOT ({some('prio', f'({_AS_NUM}) > 3')})"),
    ("l2_and", "orders", "prio AS NUMBER > 3 AND total > 100000", f"({some('prio', f'({_AS_NUM}) > 3')}) AND total > 100000"),
    ("l3_or", "orders", "prio AS NUMBER > 3 OR total > 100000", f"({some('prio', f'({_AS_NUM}) > 3')}) OR total > 100000"),
    ("l4_exactly_one", "orders", 'FALLBACK(prio AS NUMBER > 3, TRUE) AND FALLBACK(status, "") != "o"', f"coalesce(({some('prio', f'({_AS_NUM}) > 3')}), true) AND lower(status) <> 'o'"),
    ("q1_all", "users", 'ALL(etype) == "click"', each("etype", "lower(x) = 'click'")),
    ("q2_any", "users", 'ANY(etype) != "click"', some("etype", "lower(x) <> 'click'")),
    ("q3_literally", "orders", 'LITERALLY(flag) == "r"', some("flag", "x = 'r'")),
    ("q4_stacked", "orders", 'ALL(LITERALLY(ALL(flag))) >= "N"', each("flag", "x >= 'N'")),
    ("v1_count", "orders", "COUNT(flag) > 4", "coalesce(len(flag), 0) > 4"),
    ("v2_fallback", "orders", "FALLBACK(qty, 1) < 2", "CASE WHEN qty IS NULL THEN true ELSE len(list_filter(qty, lambda x: x < 2)) > 0 END"),
    ("v3_preferred", "orders", "PREFERRED(prio AS NUMBER, qty) > 4", f"CASE WHEN len(list_filter(prio, lambda x: {_NUM})) > 0 THEN ({some('prio', f'({_AS_NUM}) > 4')}) WHEN qty IS NOT NULL THEN ({some('qty', 'x > 4')}) ELSE NULL END"),
    ("a1_text_as_number", "users", "prop AS NUMBER > 90", some("prop", f"({_AS_NUM}) > 90")),
    ("a2_text_as_duration", "users", "ALL(prop AS DURATION) < 1m", each("prop", "CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) < 60 END")),
    ("a3_text_as_bytecount", "users", "prop AS BYTECOUNT >= 0.09kb", some("prop", "CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) >= 90 END")),
    ("a4_number_as_duration", "orders", "ALL(qty AS DURATION) < 45s", each("qty", "CASE WHEN x >= 0 AND x = floor(x) THEN x < 45 END")),
    ("a5_number_as_bytecount", "orders", "line AS BYTECOUNT == 7b", some("line", "CASE WHEN x >= 0 THEN x = 7 END")),
    ("a6_duration_as_number", "orders", "line AS DURATION AS NUMBER > 5", some("line", "x > 5")),
    ("a7_bytecount_as_number", "parts", "size AS NUMBER <= 10", "size <= 10"),
    ("a8_number_as_text", "orders", 'line AS STRING == "3"', some("line", "CAST(x AS VARCHAR) = '3'")),
    ("a9_duration_as_text", "orders", 'line AS DURATION AS STRING == "3s"', some("line", "x = 3")),
    ("a10_bytecount_as_text", "parts", 'size AS STRING == "10b"', "size = 10"),
    ("n5_case_folded", "docs", 'source == "SRC1"', "CASE WHEN source IS NULL THEN false ELSE lower(source) = 'src1' END"),
    ("n10_code_point_order", "docs", 'LITERALLY(text) < "É"', "text < 'É'"),
):
    _answers(_name, _records, _predicate, _truth)


_FOLDED = "replace(replace(replace(lower(strip_accents(text)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"


@query("n4_marks_stripped", f"WITH r AS (SELECT doc_id AS k, {_FOLDED} AS t FROM documents) SELECT k, md5(t) AS prepared FROM r")
def _(spark, sf_dir):
    df, _ = _set(spark, sf_dir, "docs")
    return df.select("k", F.md5(text.prepare(F.col("text"), False, False)).alias("prepared"))


@query("n8_literal", "SELECT doc_id AS k, md5(nfc_normalize(text)) AS prepared FROM documents")
def _(spark, sf_dir):
    df, _ = _set(spark, sf_dir, "docs")
    return df.select("k", F.md5(text.prepare(F.col("text"), True, False)).alias("prepared"))


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


# Text preparation: pairs that must agree, and neighbours that must not.
_PREPARED = [("Motörhead", "motorhead"), ("Ænima", "aenima"), ("Straße", "strasse"), ("ＡＢＣ", "abc"), ("Łódź", "lodz"), ("ﬁn", "fin"), ("ガンダム", "ガンダム"), ("й", "й"), ("ё", "е"), ("Ὀδυσσεύς", "οδυσσευσ"), ("a­b", "ab"), ("ı", "i"), ("Þór", "thor"), ("x²", "x2")]


@query("n_preparation", _values([(a, b) for a, b in _PREPARED], "written, prepared"))
def _(spark, sf_dir):
    df = spark.createDataFrame([(a,) for a, _ in _PREPARED], "written string")
    return df.select("written", text.prepare(F.col("written"), False, False).alias("prepared"))


_DATES = [("1999", 1999), (" 2001-02 ", 2001), ("2001-02-29", None), ("2000-02-29T23:59:59", 2000), ("0000", None), ("99", None), ("2001-2", None), ("2001-01-01T24", None), ("", None)]
_TRACKS = [("7", 7), (" 03/12 ", 3), ("3 / 12", None), ("-1", None), ("", None), ("٣", None)]
_TCON = [("(17)Post-Rock", "Rock|Post-Rock"), ("(67)Psychadelic", "Psychedelic"), ("17", "Rock"), ("Rock; Metal/Jazz", "Rock|Metal|Jazz"), ("(200)x", "(200)|x"), ("((17)", "(17)"), ("(RX)(CR)", "Remix|Cover"), ("rx", "rx"), (" ", "")]


@query("d1_trim", _values([("a",), ("b c",)], "trimmed"))
def _(spark, sf_dir):
    return spark.createDataFrame([("\t a　\xa0",), ("\x85b c \n",)], "t string").select(text.trim(F.col("t")).alias("trimmed"))


@query("d2_years", _values(_DATES, "written, year"))
def _(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in _DATES], "written string").withColumn("year", interpret.year_column(F.col("written")))


@query("d3_tracks", _values(_TRACKS, "written, track"))
def _(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in _TRACKS], "written string").withColumn("track", interpret.track_column(F.col("written")).cast("int"))


@query("d4_genre_table", _values([(0, "Blues"), (17, "Rock"), (147, "Synthpop"), (148, None)], "i, genre"))
def _(spark, sf_dir):
    return spark.createDataFrame([(0,), (17,), (147,), (148,)], "i int").withColumn("genre", interpret.genre_name(F.col("i")))


@query("d5_genre_frames", _values(_TCON, "written, genres"))
def _(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in _TCON], "written string").withColumn("genres", F.array_join(interpret.genres_column(F.col("written")), "|"))


@query("d8_suggestions", _values([("yaer", "year"), ("titel", "title"), ("zzz", None)], "written, nearest"))
def _(spark, sf_dir):
    return spark.createDataFrame([(w, closest(w, ["artist", "title", "year"])) for w in ("yaer", "titel", "zzz")], "written string, nearest string")


# Language: trees, escapes and errors

_TREES = [
    ("a == 1 OR b == 2 AND NOT c", "(or (== a number:1) (and (== b number:2) (not c)))"),
    ("x AS NUMBER AS STRING == \"a\"", "(== (as-string (as-number x)) string:a)"),
    ('t =~ r"a""b"', "(=~ 'a\"b' t)"),
    ("d BETWEEN 3:30..1h", "(between d duration:210 duration:3600)"),
    ('s == "\\u{1F3B5}\\x41"', "(== s string:🎵A)"),
]
_ERRORS = [
    ("a == b == c", "chained-comparison", "=="), ("a = 1", "borrowed-operator", "="), ("a == 1.", "trailing-period", "1."), ("5x == a", "malformed-literal", "5x"),
    ("nosuch == 1", "unknown-identifier", "nosuch"), ("n != 1", "ambiguous-not-equal", "!="), ("n == \"x\"", "type-mismatch", "n == \"x\""), ("s =~ r\"(?=x)\"", "unsupported-pattern-construct", "r\"(?=x)\""),
    ("n BETWEEN 9..1", "range-reversed", "9..1"), ("COUNT(ALL(n)) == 1", "misplaced-modifier", "ALL(n)"), ("n IS NOT ABSENT", "is-not", "IS NOT"), ("s", "not-a-condition", "s"),
    (r's =~ r"[a-\d]"', "invalid-pattern", None), (r's =~ r"\p{IsNoSuch}"', "invalid-pattern", None), ('s =~ r"a{3,1}"', "invalid-pattern", None), ('s =~ r"(?<!x)y"', "unsupported-pattern-construct", None), (r's =~ r"(a)\1"', "unsupported-pattern-construct", None), ('s =~ r"(?>a)"', "unsupported-pattern-construct", None),
]


@query("y3_trees", _values(_TREES, "predicate, tree"))
def _(spark, sf_dir):
    return spark.createDataFrame([(p, printed(parse(p))) for p, _ in _TREES], "predicate string, tree string")


def _diagnosed(spark: SparkSession, catalog: Catalog, predicates: list[str], marks: bool = True) -> DataFrame:
    rows = []
    for p in predicates:
        try:
            compiled(p, catalog)
            rows.append((p, "none", None))
        except PredicateError as e:
            rows.append((p, e.diagnostics[0].code, e.diagnostics[0].marked(p)))
    out = spark.createDataFrame(rows, "predicate string, code string, marked string")
    return out if marks else out.drop("marked")


def _of_numbers_and_strings(spark: SparkSession) -> Catalog:
    df = spark.createDataFrame([], "n array<int>, s array<string>, d array<int>")
    return frame_catalog(df, {"n": ("number", "0..n"), "s": ("string", "0..n"), "d": ("duration", "0..n")})


@query("y10_diagnostics", _values([e for e in _ERRORS if e[2] is not None], "predicate, code, marked"))
def _(spark, sf_dir):
    return _diagnosed(spark, _of_numbers_and_strings(spark), [p for p, _, mark in _ERRORS if mark is not None])


_CODES = [(p, code) for p, code, mark in _ERRORS if mark is None] + [
    (r's =~ r"[\d-z]"', "none"), (r's =~ r"(?x)^[ ]$"', "none"), (r's =~ r"\bword\B"', "none"), ("n =~ r\"1\"", "match-subject-not-string"),
    ("s =~ r\"[b-a]\"", "invalid-pattern"), ("s =~ r\"(?(a)b)\"", "unsupported-pattern-construct"), ("s =~ r\"a(\"", "invalid-pattern"),
]


@query("x2_patterns", _values(_CODES, "predicate, code"))
def _(spark, sf_dir):
    return _diagnosed(spark, _of_numbers_and_strings(spark), [p for p, _ in _CODES], marks=False)


# Rejected conversions, arguments of functions, names that the language keeps for itself, numbers in place of units.
_REJECTED = {
    "a11_rejected": [("d AS BYTECOUNT == 1b", "units-do-not-convert"), ("n AS NUMBR == 1", "unknown-target"), ("NUMBER(s) == 1", "conversion-called"), ('"x" AS NUMBER == 1', "constant-does-not-convert"), ("(n == 1) AS STRING == \"x\"", "boolean-not-convertible"), ("s AS NUMBER == 1", "none")],
    "y7_reserved": [("usable == 1", "reserved-word"), ("and::x == 1", "reserved-word-in-identifier"), ("x::and == 1", "reserved-word-in-identifier"), ("n == NULL", "null-value"), ("n == 1 AND s == \"x\"", "none")],
    "y8_stand_ins": [("d > -1", "negative-unit-literal"), ("d > 1.5", "fractional-duration-literal"), ("d > 90", "none"), ("d BETWEEN 60..120s", "range-unit-missing"), ("d == 1:30", "none"), ("n == 1m", "type-mismatch")],
    "v6_arguments": [("COUNT(n, n) == 1", "wrong-argument-count"), ("FALLBACK(n, n) == 1", "fallback-default-not-constant"), ("COUNT(n) == 1", "none"), ("PREFERRED(n) == 1", "wrong-argument-count"), ("FOO(n) == 1", "unknown-function")],
}


def _rejections(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _diagnosed(spark, _of_numbers_and_strings(spark), [p for p, _ in _REJECTED[name]], marks=False)

    _found[name] = (run, _values(_REJECTED[name], "predicate, code"))


for _name in _REJECTED:
    _rejections(_name)

# Arguments of the functions that read fields, and names of sources, by the catalog of audio files.
_FIELDS = [('id3v2::field("TYER") == "x"', "argument-rejected"), ('id3v2::field("APIC") == "x"', "argument-rejected"), ('id3v2::field("TPE1", "d") == "x"', "argument-rejected"), ('id3v2::field("TXXX", "d") == "x"', "none"), ('ape::field("a", "b") == "x"', "wrong-argument-count"), ("vorbis::field(artist) == \"x\"", "argument-not-literal"), ("nosuch::artist == \"x\"", "unknown-source"), ("atrist == \"x\"", "unknown-identifier"), ('duration > 1', "needs-source")]


@query("i13_lookups", _values(_FIELDS, "predicate, code"))
def _(spark, sf_dir):
    return _diagnosed(spark, AudioCatalog(), [p for p, _ in _FIELDS], marks=False)


_CANONICAL = [("0001.500", "1.5"), ("-0", "0"), ("+7", "7"), (".25", "0.25"), ("1234567890123456789.000000001", "1234567890123456789.000000001"), ("1e5", None), ("", None)]


@query("d7_canonical_numbers", _values(_CANONICAL, "written, printed"))
def _(spark, sf_dir):
    df = spark.createDataFrame([(w,) for w, _ in _CANONICAL], "written string")
    return df.withColumn("printed", text_of(number_from_text(F.col("written")), True))


@query("n1_repair", _values([("a\ufffdb", "a\ufffdb"), ("\u00e9", "e")], "literal, normalized"))
def _(spark, sf_dir):
    """Bytes that are no text."""
    df = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray("\u00e9".encode()),)], "raw binary").select(F.col("raw").cast("string").alias("t"))
    return df.select(text.prepare(F.col("t"), True, False).alias("literal"), text.prepare(F.col("t"), False, False).alias("normalized"))


_WORDS = [("a", True), ("\u00e9", True), ("7", True), ("_", True), ("\u203f", True), ("\u2168", False), ("\u093e", False), ("\u0301", True), ("-", False), (" ", False)]


@query("x1_word_characters", _values([(w, t, w == " ") for w, t in _WORDS], "written, word, space"))
def _(spark, sf_dir):
    df = spark.createDataFrame([(w,) for w, _ in _WORDS], "written string")
    names = frame_catalog(df, {"written": ("string", "1..1")})
    truth = lambda p: compiled(p, names).truth
    return df.select("written", truth(r'LITERALLY(written) =~ r"^\w$"').alias("word"), truth(r'LITERALLY(written) =~ r"(?x)^[ ]$"').alias("space"))


# Warnings, tallies, filters

_W = 'prio AS NUMBER > 3 OR prio AS NUMBER < 2 OR flag == "r"'
_W_TRUTH = f"(({some('prio', f'({_AS_NUM}) > 3')}) OR ({some('prio', f'({_AS_NUM}) < 2')}) OR ({some('flag', chr(39).join(('lower(x) = ', 'r', '')))}))"
_W_BAD = f"len(list_filter(prio, lambda x: NOT {_NUM})) > 0"


def _evaluated(spark: SparkSession, sf_dir: str, predicate: str = _W) -> DataFrame:
    df, catalog = _set(spark, sf_dir, "orders")
    return compiled(predicate, catalog).evaluate(df)


@query("w3_one_warning_for_a_source", f"WITH {_SQL_SETS['orders']} SELECT k, CASE WHEN {_W_BAD} THEN 'prio AS NUMBER' ELSE '' END AS said FROM r")
def _(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("k", F.array_join("warnings", "|").alias("said"))


@query("w1_consumed", f"WITH {_SQL_SETS['orders']} SELECT k, CASE WHEN total > 100000 AND {_W_BAD} THEN 1 ELSE 0 END AS n FROM r")
def _(spark, sf_dir):
    return _evaluated(spark, sf_dir, "total > 100000 AND prio AS NUMBER > 3").select("k", F.size("warnings").alias("n"))


@query("w4_categories", f"WITH {_SQL_SETS['orders']}, e AS (SELECT k, {_W_TRUTH} AS truth, {_W_BAD} AS bad FROM r) SELECT k, 'data' AS category FROM e WHERE bad UNION ALL SELECT k, 'unanswered' FROM e WHERE truth IS NULL")
def _(spark, sf_dir):
    return warnings(_evaluated(spark, sf_dir), "k").select("k", "category")


@query("w5_tally", f"WITH {_SQL_SETS['orders']}, e AS (SELECT {_W_TRUTH} AS truth, {_W_BAD} AS bad FROM r) SELECT count(*) AS found, count(*) AS examined, count(*) FILTER (WHERE truth) AS matched, count(*) FILTER (WHERE truth IS NULL) AS unanswered, count(*) FILTER (WHERE bad) AS warned, CAST(0 AS BIGINT) AS opened FROM e")
def _(spark, sf_dir):
    return tally(_evaluated(spark, sf_dir))


@query("w6_suppressed", f"WITH {_SQL_SETS['orders']}, e AS (SELECT k, {_W_TRUTH} AS truth FROM r) SELECT k, 'unanswered' AS category FROM e WHERE truth IS NULL")
def _(spark, sf_dir):
    return warnings(_evaluated(spark, sf_dir), "k", ["data"]).select("k", "category")


@query("p1_filter", f"WITH {_SQL_SETS['orders']} SELECT k, total FROM r WHERE {_W_TRUTH}")
def _(spark, sf_dir):
    df, catalog = _set(spark, sf_dir, "orders")
    return compiled(_W, catalog).filter(df).select("k", "total")


@query("flagship", f"WITH {_SQL_SETS['orders']} SELECT k, total FROM r WHERE ({some('flag', chr(39).join(('lower(x) = ', 'r', '')))}) AND total > 100000")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a returned line and a high price."""
    df, catalog = _set(spark, sf_dir, "orders")
    return compiled('flag == "r" AND total > 100000', catalog).filter(df).select("k", "total")


# Files: names, discovery, sinks, over page addresses and over a folder made for it

_NAME = "regexp_extract(url, '([^/]*)$', 1)"


@query("i2_names", f"SELECT page_id, {_NAME} AS name, nullif(regexp_extract({_NAME}, '^.+\\.([^.]+)$', 1), '') AS extension FROM pages")
def _(spark, sf_dir):
    name = base_name(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", name.alias("name"), extension_column(name).alias("extension"))


@query("s6_distinct_union", "SELECT url AS path FROM pages UNION SELECT url || '/../' || CAST(page_id AS VARCHAR) FROM pages UNION SELECT url FROM pages")
def _(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    paths = pages.select(F.col("url").alias("path"))
    return distinct_paths(paths, pages.select(F.concat("url", F.lit("/../"), F.col("page_id").cast("string")).alias("path")), paths)


@query("k1_plain", "SELECT url AS line FROM pages")
def _(spark, sf_dir):
    return plain(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.lit(None).cast("string").alias("hash")))


@query("k2_lines", "SELECT concat(url, ' md5 ', coalesce(md5(html), '-')) AS line FROM pages")
def _(spark, sf_dir):
    return plain(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.md5("html").alias("hash")), "md5")


@query("k3_json", "SELECT '{\"file\":\"' || url || '\"}' AS line FROM pages")
def _(spark, sf_dir):
    return objects(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.lit(None).cast("string").alias("hash")))


# An audio file for each document: a tag, as many frames as the document's length says (the stream is the same
# frame again and again), and a closing tag with the document's number in it. The hash is that of the frames alone.

_TAG, _FRAME = made.id3v2(made.text_frame("TIT2", "of a document")), made.mp3_frames(1)
_FRAMES = "20 + n_chars % 13"


def _files_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    stream = F.unhex(F.repeat(F.lit(_FRAME.hex()), F.expr(f"int({_FRAMES})")))
    closing = F.concat(F.lit("TAG"), F.rpad(F.col("doc_id").cast("string"), 30, " "), F.lit(" " * 95)).cast("binary")
    content = F.concat(F.unhex(F.lit(_TAG.hex())), stream, closing)
    return docs.select(F.concat(F.lit("/m/"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("path"), content.alias("content"))


_FILE = "'/m/' || CAST(doc_id AS VARCHAR) || '.mp3'"


@query("m2_hashes", f"SELECT {_FILE} AS path, md5(unhex(repeat('{_FRAME.hex()}', CAST({_FRAMES} AS BIGINT)))) AS hash, true AS matched FROM documents")
def _(spark, sf_dir):
    files = judged(_files_of_documents(spark, sf_dir), None, None, "md5")
    return files.select("path", "hash", (F.col("disposition") == "matched").alias("matched"))


@query("i1_paths", f"SELECT {_FILE} AS path, regexp_matches({_FILE}, '^/m/[0-9]*7[0-9]*[.]mp3$') AND {len(_TAG)} + {len(_FRAME)} * ({_FRAMES}) + 128 > 12000 AS truth FROM documents")
def _(spark, sf_dir):
    catalog = AudioCatalog()
    where = compiled('file::path =~ r"^/m/[0-9]*7[0-9]*[.]mp3$" AND file::size > 12kb', catalog)
    return judged(_files_of_documents(spark, sf_dir), where, catalog).select("path", "truth")


@query("m5_stages", f"SELECT {_FILE} || ' md5 ' || md5(unhex(repeat('{_FRAME.hex()}', CAST({_FRAMES} AS BIGINT)))) AS line FROM documents WHERE CAST(doc_id AS VARCHAR) LIKE '%3%'")
def _(spark, sf_dir):
    """The reader with a predicate over a closing tag and the hash, then a filter, then a sink, put together as one stage."""
    catalog = AudioCatalog()
    where = compiled('id3v1::title =~ r"3"', catalog)
    return _files_of_documents(spark, sf_dir).transform(then(judging(where, catalog, "md5"), matching, rendering("plain", "md5")))


def _folder() -> str:
    top = tempfile.mkdtemp(prefix="tessitura-")
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    for name in ("a.mp3", "b.FLAC", "c.txt", ".mp3", "sub/d.mp3", "sub/deep/e.flac", "other/f.mp3", "w/p*q.mp3", "w/pxq.mp3"):
        path = os.path.join(top, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(b"x" * len(name))
    os.symlink(top, os.path.join(top, "sub", "loop"))
    os.symlink(os.path.join(top, "other"), os.path.join(top, "linked"))
    return top


_WALKS = [("a.mp3", "a.mp3"), (".", "a.mp3 b.FLAC linked/f.mp3 other/f.mp3 sub/d.mp3 sub/deep/e.flac w/p*q.mp3 w/pxq.mp3"), ("o*", "other/f.mp3"), ("?.mp3", "a.mp3"), ("nothing*", ""), ("c.txt", ""), ("w/p*q.mp3", "w/p*q.mp3 w/pxq.mp3"), ("nowhere/*.mp3", "")]


@query("s1_to_s5_discovery", _values(_WALKS, "spec, files"))
def _(spark, sf_dir):
    top = _folder()
    rows = [(s, " ".join(sorted(os.path.relpath(f, top) for f in discovered([os.path.join(top, s)]).files))) for s, _ in _WALKS]
    return spark.createDataFrame(rows, "spec string, files string")


@query("s2_walk_by_executors", _values([("a.mp3",), ("b.FLAC",), ("linked/f.mp3",), ("other/f.mp3",), ("sub/d.mp3",), ("sub/deep/e.flac",), ("w/p*q.mp3",), ("w/pxq.mp3",)], "file"))
def _(spark, sf_dir):
    top = _folder()
    return walked_frame(spark, [top]).filter("warning IS NULL").select(F.substring("path", len(top) + 2, 1000).alias("file"))


@query("s7_rejected", _values([("*a*", 1), ("missing", 1), ("*/a.mp3", 1), ("a.mp3", 0), ("nowhere/?", 0)], "spec, problems"))
def _(spark, sf_dir):
    from .sources.discover import PathError, resolve

    top, rows = _folder(), []
    for s in ("*a*", "missing", "*/a.mp3", "a.mp3", "nowhere/?"):
        try:
            resolve([os.path.join(top, s)])
            rows.append((s, 0))
        except PathError as e:
            rows.append((s, len(e.problems)))
    return spark.createDataFrame(rows, "spec string, problems int")


@query("s5_candidates", "SELECT path FROM (VALUES ('/x/a.mp3'), ('/x/B.FLAC')) t(path)")
def _(spark, sf_dir):
    return only_candidates(spark.createDataFrame([("/x/a.mp3",), ("/x/B.FLAC",), ("/x/c.ogg",), ("/x/.mp3",), ("/x/mp3",)], "path string"))


# Audio

_AUDIO = {
    "/m/full.mp3": made.id3v2(made.text_frame("TPE1", "Motörhead", "Girlschool"), made.text_frame("TCON", "(17)(9)"), made.text_frame("TRCK", "3/12"), made.text_frame("TDRC", "soon"), made.frame("TXXX", b"\3MOOD\0calm")) + made.xing_frame(500, 501 * 417) + made.mp3_frames(500) + made.id3v1("Title", year="1999", genre=9),
    "/m/ape.mp3": made.mp3_frames(400) + made.ape([("Artist", b"Abba\0Beta", 0), ("Year", b"1977-01-02", 0), ("Cover", b"\1\2", 2)]),
    "/m/plain.mp3": made.mp3_frames(500),
    "/m/broken.mp3": made.id3v2(made.text_frame("TPE1", "Cut"), made.frame("TALB", b"\3long")[:-2]) + made.mp3_frames(50),
    "/m/voice.flac": made.flac(60, "ARTIST=Nina", "artist=Duo", "DATE=1965", "TRACKNUMBER=7", "GENRE=Jazz"),
    "/m/untrue.flac": made.flac(5, "TITLE=t", total=0, tail=b"\1" * 40),
    "/m/noise.mp3": b"not audio at all" * 40,
}


def _audio(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, bytearray(v)) for k, v in _AUDIO.items()], "path string, content binary")


def _name_of(path: str = "path") -> F.Column:
    return base_name(F.col(path))


_LISTS = [
    ('artist == "motorhead"', "full.mp3"), ('artist == "beta"', "ape.mp3"), ("COUNT(artist) == 2", "ape.mp3 full.mp3 voice.flac"), ('genre == "metal"', "full.mp3"), ("year < 1970", "voice.flac"),
    ("track == 3", "full.mp3"), ('id3v2::field("TXXX", "mood") == "CALM"', "full.mp3"), ('vorbis::field("Artist") == "duo"', "voice.flac"), ('ape::bytes("cover") IS USABLE', "ape.mp3"), ('ape::field("cover") IS UNUSABLE', "ape.mp3"),
    ("file::duration > 11", "full.mp3 plain.mp3"), ('file::extension == "flac" AND file::duration IS UNUSABLE', "untrue.flac"), ('file::name =~ r"^p"', "plain.mp3"), ("file::size < 1kb", "noise.mp3 untrue.flac voice.flac"), ('id3v1::title == "title"', "full.mp3"),
    ("id3v1::genre IS USABLE", "full.mp3"), ("album IS UNUSABLE", "broken.mp3"), ("PREFERRED(vorbis::year, ape::year) == 1977", "ape.mp3"), ("artist IS ABSENT", "plain.mp3 untrue.flac"),
]


@query("m1_list", _values(_LISTS, "filter, files"))
def _(spark, sf_dir):
    """All filters over one reading of the files."""
    catalog = AudioCatalog()
    filters = [(where, compiled(where, catalog)) for where, _ in _LISTS]
    read = layouts(_audio(spark), catalog.requests)
    lost = lambda p: p.opened & ~F.col("readable")
    answers = F.array(*(F.struct(F.lit(where).alias("filter"), (p.truth & ~lost(p)).alias("listed")) for where, p in filters))
    listed = read.select(_name_of().alias("name"), F.explode(answers).alias("x")).filter("x.listed").groupBy("x.filter")
    return listed.agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("files"))


@query("f_layouts", _values([("ape.mp3", 10, False, None), ("broken.mp3", 1, True, None), ("full.mp3", 13, False, None), ("noise.mp3", None, False, "no MPEG audio found"), ("plain.mp3", 13, False, None), ("untrue.flac", None, True, None), ("voice.flac", 5, False, None)], "name, seconds, incomplete, error"))
def _(spark, sf_dir):
    return layouts(_audio(spark)).select(_name_of().alias("name"), F.col("duration").cast("int").alias("seconds"), "incomplete", "error")


_MD5 = lambda *pieces: hashlib.md5(b"".join(pieces)).hexdigest()
_PLAIN = _MD5(made.mp3_frames(500))
_VOICE = _MD5(*(made.flac_frame(i, 4096, i) for i in range(60)))
_UNTRUE = _MD5(*(made.flac_frame(i, 4096, i) for i in range(5)))


@query("m3_m4_audio_hashes", _values([("full.mp3", _PLAIN, True), ("plain.mp3", _PLAIN, True), ("noise.mp3", None, False), ("voice.flac", _VOICE, True), ("untrue.flac", _UNTRUE, True)], "name, hash, matched"))
def _(spark, sf_dir):
    files = judged(_audio(spark), None, None, "md5").filter(_name_of().isin("full.mp3", "plain.mp3", "noise.mp3", "voice.flac", "untrue.flac"))
    return files.select(_name_of().alias("name"), "hash", (F.col("disposition") == "matched").alias("matched"))


def _damaged() -> dict[str, bytes]:
    """FLAC files of five frames: sound, one frame's body changed, one frame missing, the last frame cut."""
    frames = [made.flac_frame(i, 4096, i) for i in range(5)]
    head = made.flac(5)[: -sum(map(len, frames))]
    changed = bytearray(frames[2])
    changed[-3] ^= 1
    return {
        "/f/sound.flac": head + b"".join(frames),
        "/f/changed.flac": head + b"".join([*frames[:2], bytes(changed), *frames[3:]]),
        "/f/missing.flac": head + b"".join([*frames[:2], *frames[3:]]),
        "/f/cut.flac": head + b"".join(frames)[:-3],
        "/f/other.mp3": made.mp3_frames(50),
    }


@query("m4_faults", _values([("changed.flac", "crc16-fails", 2), ("cut.flac", "cut-off", 4), ("missing.flac", "numbers-skipped", 2)], "name, kind, number"))
def _(spark, sf_dir):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in _damaged().items()], "path string, content binary")
    return faults(files).select(_name_of().alias("name"), "kind", F.col("number").cast("int").alias("number"))


# Options and exit codes

_NO_WARN = [(None, ""), ("data", "data"), (" File ,data", "data file"), ("all", "data file incomplete unanswered"), ("  ", "data file incomplete unanswered"), ("", "refused"), ("data,,file", "refused"), ("data,", "refused"), ("x", "refused")]
_CHOICES = [("md5", "md5"), (" SHA1", "sha1"), ("", "md5"), ("SHA-1", "refused"), ("pl-ain", "refused")]


def _or_refused(f: Callable[[], str]) -> str:
    try:
        return f()
    except ValueError:
        return "refused"


@query("w6_options", _values([(w or "-" if w is None else w, x) for w, x in _NO_WARN], "written, silent"))
def _(spark, sf_dir):
    rows = [("-" if w is None else w, _or_refused(lambda w=w: " ".join(sorted(suppressed(w))))) for w, _ in _NO_WARN]
    return spark.createDataFrame(rows, "written string, silent string")


@query("k4_choices", _values(_CHOICES, "written, chosen"))
def _(spark, sf_dir):
    return spark.createDataFrame([(w, _or_refused(lambda w=w: choice(w, ALGORITHMS))) for w, _ in _CHOICES], "written string, chosen string")


_EXITS = [("", 5, 5, 5, 0), ("data", 5, 5, 5, 10), ("unanswered data", 5, 5, 5, 11), ("incomplete unanswered", 5, 5, 0, 12), ("data file incomplete", 5, 5, 5, 13), ("", 0, 0, 0, 21), ("", 5, 5, 0, 20), ("data", 5, 5, 0, 10), ("", 5, 0, 0, 0)]


@query("w7_exit_codes", _values(_EXITS, "warned, found, examined, matched, code"))
def _(spark, sf_dir):
    rows = [(w, f, e, m, exit_code({"found": f, "examined": e, "matched": m}, w.split())) for w, f, e, m, _ in _EXITS]
    return spark.createDataFrame(rows, "warned string, found int, examined int, matched int, code int")


@query("w7_w8_run", _values([(7, 6, 0, 1, 7, 2, 1, 1)], "found, examined, matched, unanswered, opened, incomplete, unreadable, defective"))
def _(spark, sf_dir):
    catalog = AudioCatalog()
    counts = counts_of(judged(_audio(spark), compiled("id3v2::year == 1965", catalog), catalog))
    return counts.select(*(F.col(c).cast("int").alias(c) for c in counts.columns))


@query("p2_unreadable", _values([("full.mp3", "data"), ("noise.mp3", "file")], "name, category"))
def _(spark, sf_dir):
    catalog = AudioCatalog()
    return warnings_of(judged(_audio(spark), compiled("id3v2::year == 1965", catalog), catalog)).select(_name_of().alias("name"), "category")


@query("s9_bounded_reads", _values([("full.mp3", True), ("voice.flac", True)], "name, within"))
def _(spark, sf_dir):
    from .sources.audio import analysed

    rows = []
    for name in ("/m/full.mp3", "/m/voice.flac"):
        r = in_memory(_AUDIO[name])
        analysed(r, name.rpartition(".")[2])
        rows.append((os.path.basename(name), r.pulled <= r.policy.head + r.policy.tail))
    return spark.createDataFrame(rows, "name string, within boolean")


@query("k3_json_array", _values([('[\n  {\n    "file": "/x/\\u00E9\\u0026\\u0022.mp3"\n  }\n]\n',)], "document"))
def _(spark, sf_dir):
    rows = spark.createDataFrame([("/x/é&\".mp3", None)], "path string, hash string")
    return spark.createDataFrame([("".join(json_array(rows)),)], "document string")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}
