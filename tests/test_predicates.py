"""The language against a small model of its rules: quantifiers, three values, reports, conversions, errors."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F
from tessitura.operators.catalog import frame_catalog
from tessitura.operators.predicate import compiled, exit_code, tally, warnings
from tessitura.plans.diagnostics import PredicateError
from tessitura.plans.syntax import parse, printed

OPS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def k_any(xs):
    xs = list(xs)
    return True if True in xs else None if None in xs else False


def k_all(xs):
    xs = list(xs)
    return False if False in xs else None if None in xs else True


def model(left, op, right, all_left, all_right):
    """None in a bag: an occurrence that can't be read; an empty bag: absent. None as a result: no answer."""
    if not left or not right:
        return False
    test = lambda a, b: None if a is None or b is None else OPS[op](a, b)
    fold = lambda universal: k_all if universal else k_any
    if all_right and not all_left:
        return k_all(fold(all_left)(test(a, b) for a in left) for b in right)
    return fold(all_left)(fold(all_right)(test(a, b) for b in right) for a in left)


BAGS = [[], [1], [2], [None], [1, 2], [2, 3], [1, 2, 3], [1, None], [3, None], [None, None]]


def test_every_quantifier_over_every_pair_of_bags(spark):
    pairs = list(itertools.product(BAGS, BAGS))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<int>, b array<int>").cache()
    catalog = frame_catalog(df, {"a": ("number", "0..n"), "b": ("number", "0..n")})
    cases = list(itertools.product(OPS, (False, True), (False, True)))
    written = [f"{'ALL' if x else 'ANY'}(a) {op} {'ALL' if y else 'ANY'}(b)" for op, x, y in cases]
    made = [compiled(w, catalog) for w in written]
    rows = df.select("i", *(p.truth.alias(f"t{k}") for k, p in enumerate(made)), made[0].consumed.alias("said")).collect()
    for r in rows:
        a, b = pairs[r["i"]]
        for k, (op, x, y) in enumerate(cases):
            assert r[f"t{k}"] == model(a, op, b, x, y), (a, op, b, x, y)
        assert set(r["said"]) == ({n for n, bag in (("a", a), ("b", b)) if None in bag} if a and b else set())


class Random:
    """Random predicates over x0, x1, x2 with their truth and reports by the model."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def make(self, depth):
        if depth == 0 or self.rng.random() < 0.3:
            x, op, n = self.rng.choice(["x0", "x1", "x2"]), self.rng.choice(list(OPS)), self.rng.randrange(5)
            every = self.rng.random() < 0.4
            text = f"{'ALL' if every else 'ANY'}({x}) {op} {n}"
            return text, lambda row: (model(row[x], op, [n], every, False), {x} if row[x] and None in row[x] else set())
        kind = self.rng.choice(["AND", "OR", "NOT"])
        t1, f1 = self.make(depth - 1)
        if kind == "NOT":
            return f"NOT ({t1})", lambda row: (None if (v := f1(row))[0] is None else not v[0], v[1])
        t2, f2 = self.make(depth - 1)

        def both(row):
            (a, ra), (b, rb) = f1(row), f2(row)
            settles = kind == "OR"
            truth = (k_any if settles else k_all)([a, b])
            return truth, ra if a is settles else ra | rb

        return f"({t1}) {kind} ({t2})", both


def test_random_predicates_answer_and_report_like_the_model(spark):
    rng = random.Random(7)
    bag = lambda: [None if rng.random() < 1 / 3 else rng.randrange(5) for _ in range(rng.randrange(4))]
    data = [{"i": i, "x0": bag(), "x1": bag(), "x2": bag()} for i in range(40)]
    df = spark.createDataFrame([(d["i"], d["x0"], d["x1"], d["x2"]) for d in data], "i int, x0 array<int>, x1 array<int>, x2 array<int>").cache()
    catalog = frame_catalog(df, {x: ("number", "0..n") for x in ("x0", "x1", "x2")})
    source = Random(20)
    for _ in range(6):
        some = [source.make(3) for _ in range(10)]
        made = [compiled(t, catalog) for t, _ in some]
        rows = df.select("i", *(p.truth.alias(f"t{k}") for k, p in enumerate(made)), *(p.consumed.alias(f"s{k}") for k, p in enumerate(made))).collect()
        for r in rows:
            for k, (text, f) in enumerate(some):
                truth, said = f(data[r["i"]])
                assert (r[f"t{k}"], set(r[f"s{k}"])) == (truth, said), text


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("Motörhead", ["metal", "rock"], [1, None], ["5", "x"], 90, True), ("metallica", None, [], ["1h", "3:30", "90"], 5000, False)]
    df = spark.createDataFrame(rows, "artist string, genre array<string>, v array<int>, s array<string>, size int, flag boolean").cache()
    names = {"artist": ("string", "1..1"), "genre": ("string", "0..n"), "v": ("number", "0..n"), "s": ("string", "0..n"), "size": ("bytecount", "1..1"), "d": ("duration", "1..1", F.col("size")), "flag": ("boolean", "1..1"), "b": ("blob", "0..1", F.col("artist").cast("binary"))}
    return df, frame_catalog(df, names)


GOLDEN = [
    ('artist == "motorhead"', [True, False]), ('LITERALLY(artist) == "motorhead"', [False, False]), ('artist =~ r"motö"', [False, False]), ('LITERALLY(artist) =~ r"otö"', [True, False]),
    ('artist BETWEEN "ma".."mi"', [False, True]), ('artist BETWEEN "mo".."mo"', [True, False]), ('LITERALLY(artist) BETWEEN "m".."m"', [False, True]),
    ('ALL(genre) == "rock"', [False, False]), ('genre == "rock"', [True, False]), ('NOT genre == "metal"', [False, True]), ('ALL(genre) != "metal"', [False, False]),
    ("v == 1", [True, False]), ("v == 2", [None, False]), ("v IS UNUSABLE", [True, False]), ("ALL(v) IS USABLE", [False, False]), ("v IS ABSENT", [False, True]), ("COUNT(v) == 2", [True, False]),
    ("FALLBACK(v, 7) == 7", [True, True]), ("PREFERRED(v, size AS NUMBER) > 80", [None, True]), ("s AS DURATION == 1h", [None, True]), ("s AS DURATION == 210s", [None, True]), ("s AS DURATION == 1m30s", [None, True]),
    ("s AS NUMBER == 5", [True, None]), ("ALL(s AS NUMBER) IS USABLE AND s AS NUMBER > 1", [False, False]), ("size > 1kb", [False, True]), ("size BETWEEN 60..120", [True, False]), ("d == 1:30", [True, False]),
    ('size AS STRING == "5000b"', [False, True]), ('d AS STRING == "90s"', [True, False]), ('1.50 AS STRING == "1.5"', [True, True]), ('-0 AS STRING == "0"', [True, True]), ('1.4kib AS STRING == "1433.6b"', [True, True]), ('4m5s AS STRING == "245s"', [True, True]),
    ("(size > 1kb) == flag", [False, False]), ("flag == TRUE", [True, False]), ("(v > 5) IS UNUSABLE", [True, False]), ("FALLBACK(v > 5, TRUE)", [True, False]), ('artist =~ r"^\\w+$"', [True, True]), ('artist =~ r"[a-z-[aeiou]]{2}"', [True, True]),
    ("b IS USABLE AND COUNT(b) == 1", [True, True]), ("a" "rtist == ARTIST", [True, True]),
]


def test_golden_answers(spark, catalog):
    df, names = catalog
    made = [compiled(t, names).truth.alias(f"t{i}") for i, (t, _) in enumerate(GOLDEN)]
    rows = df.select("size", *made).orderBy("size").collect()
    for i, (text, wanted) in enumerate(GOLDEN):
        assert [r[f"t{i}"] for r in rows] == wanted, text


SOURCES = [("v > 5", 1), ("v > v", 1), ("v < 0 OR v > 20", 1), ("s AS NUMBER > s AS NUMBER", 1), ("s AS NUMBER > 9 OR s AS DURATION > 1h", 2), ("ALL(v) == 1 OR v == 9", 1), ("v > 9 AND s AS NUMBER > 9", 2), ("(v > 9) == (v > 9)", 1), ("FALLBACK(v > 9, FALSE)", 1), ("v == 1 OR s AS NUMBER == 9", 1), ("v IS USABLE", 0), ("COUNT(v) == 1", 0)]


def test_a_warning_for_each_source(spark, catalog):
    df, names = catalog
    first = df.filter("size = 90")
    row = first.select(*(F.size(compiled(t, names).consumed).alias(f"n{i}") for i, (t, _) in enumerate(SOURCES))).first()
    assert [row[f"n{i}"] for i in range(len(SOURCES))] == [n for _, n in SOURCES]
    assert first.select(compiled("9 < V OR v > 9", names).consumed.alias("w")).first()["w"] == ["V"]


def test_warnings_and_tally(spark, catalog):
    df, names = catalog
    seen = compiled("v == 2", names).evaluate(df)
    assert sorted(r["category"] for r in warnings(seen, "artist").collect()) == ["data", "unanswered"]
    assert [r["category"] for r in warnings(seen, "artist", ["data"]).collect()] == ["unanswered"]
    assert warnings(seen, "artist", ["all"]).count() == 0
    counts = tally(seen).first()
    assert (counts["found"], counts["matched"], counts["unanswered"]) == (2, 0, 1)
    assert exit_code(counts, ["data", "unanswered"]) == 11 and exit_code(counts, ["data", "file", "incomplete"]) == 13
    assert exit_code(counts, []) == 20 and exit_code(counts, ["file"], strict=False) == 0
    assert exit_code({"found": 0, "examined": 0, "matched": 0}, []) == 21 and exit_code({"found": 1, "examined": 0, "matched": 0}, []) == 0


ERRORS = [
    ("", "empty-predicate", None), ("artist ==", "unexpected-end", None), ("artist == )", "unexpected-token", ")"), ("artist == \"x", "unterminated-string", '"x'), ('artist == "\\q"', "unknown-escape", "\\q"), ('artist == "\\x4"', "malformed-escape", "\\x4"),
    ('artist == "\\uD800"', "lone-surrogate", "\\uD800"), ('artist == "\\u{D800}"', "surrogate-code-point", "\\u{D800}"), ('artist == "\\u{110000}"', "code-point-out-of-range", "\\u{110000}"), ("size > 1.", "trailing-period", "1."), ("d > 1:75", "clock-field-out-of-range", "75"),
    ("size > 99999999999999999999999999999999", "unrepresentable-literal", "9" * 32), ("size > 5xb", "malformed-literal", "5xb"), ("size > -5kb", "signed-unit-literal", "-5kb"), ("size > 5 kb", "whitespace-in-literal", "5 kb"), ("a == b == c", "chained-comparison", "=="),
    ("artist = \"x\"", "borrowed-operator", "="), ("flag && flag", "borrowed-operator", "&&"), ("artist ~= \"x\"", "borrowed-operator", "~="), ("usable == 1", "reserved-word", "usable"), ("and::x == 1", "reserved-word-in-identifier", "and"), ("x::and == 1", "reserved-word-in-identifier", "and"),
    ("x :: y == 1", "whitespace-in-identifier", "x :: y"), ("::x == 1", "rooted-identifier", "::x"), ("a::b::c == 1", "nested-identifier", "a::b::c"), ('a::"x" == 1', "quoted-name", 'a::"x"'), ("size BETWEEN v..2", "range-endpoint-not-literal", "v"), ('artist =~ "x"', "quoted-pattern", '"x"'),
    ('artist =~ (r"x")', "parenthesized-pattern", '(r"x")'), ('artist =~ LITERALLY(r"x")', "modified-pattern", 'LITERALLY(r"x")'), ("artist =~ artist", "pattern-not-raw-string", "artist"), ("v IS NOT USABLE", "is-not", "IS NOT"), ("v IS NULL", "is-null", "NULL"), ("é == 1", "non-ascii-name", "é"), ("v # 1", "unexpected-character", "#"),
    ("nosuch == 1", "unknown-identifier", "nosuch"), ("nosuch::x == 1", "unknown-source", "nosuch"), ("FOO(v) == 1", "unknown-function", "FOO"), ("v == NULL", "null-value", "NULL"), ("artist == 5", "type-mismatch", "artist == 5"), ("size > -1", "negative-unit-literal", "-1"), ("d > 1.5", "fractional-duration-literal", "1.5"),
    ("flag < flag", "boolean-not-ordered", "flag < flag"), ("flag AS NUMBER == 1", "boolean-not-convertible", "flag"), ("size AS DURATION == 1s", "units-do-not-convert", "size"), ("v AS NUMBR == 1", "unknown-target", "NUMBR"), ("NUMBER(s) == 1", "conversion-called", "NUMBER(s)"), ("size =~ r\"x\"", "match-subject-not-string", "size"),
    ("b == b", "blob-not-usable", "b"), ("artist", "not-a-condition", "artist"), ("v != 1", "ambiguous-not-equal", "!="), ("COUNT(ALL(v)) == 1", "misplaced-modifier", "ALL(v)"), ("ALL(ANY(v)) == 1", "contradictory-quantifiers", "ANY(v)"), ("LITERALLY(v) == 1", "literally-not-string", "LITERALLY(v)"),
    ("LITERALLY(artist) IS USABLE", "literally-on-state-test", "LITERALLY(artist)"), ("ALL(v) IS ABSENT", "quantifier-on-absent-test", "ALL(v)"), ("COUNT(v, v) == 1", "wrong-argument-count", "COUNT(v, v)"), ("FALLBACK(v, v) == 1", "fallback-default-not-constant", "v"), ('"x" AS NUMBER == 1', "constant-does-not-convert", '"x"'),
    ("size BETWEEN 60..120kb", "range-unit-missing", "60"), ('size BETWEEN 1kb.."x"', "range-endpoint-types", '1kb.."x"'), ("v BETWEEN 9..1", "range-reversed", "9..1"), ('artist =~ r"a("', "invalid-pattern", None), ('artist =~ r"a**"', "invalid-pattern", None), ('artist =~ r"\\1"', "unsupported-pattern-construct", 'r"\\1"'), ('artist =~ r"(?>a)"', "unsupported-pattern-construct", None),
]


@pytest.mark.parametrize("text,code,marked", ERRORS, ids=[f"{c}-{i}" for i, (_, c, _) in enumerate(ERRORS)])
def test_errors(catalog, text, code, marked):
    with pytest.raises(PredicateError) as e:
        compiled(text, catalog[1])
    d = e.value.diagnostics[0]
    assert d.code == code and (marked is None or d.marked(text) == marked)
    assert code in str(e.value)


@pytest.mark.parametrize("pattern", [r"[a-\d]", r"\p{IsNoSuch}", r"\p{Nope}", "a{3,1}", "[b-a]", "(", r"a\q"])
def test_invalid_patterns_never_reach_a_task(catalog, pattern):
    with pytest.raises(PredicateError) as e:
        compiled(f'artist =~ r"{pattern}"', catalog[1])
    assert e.value.diagnostics[0].code == "invalid-pattern"


WORDS = [
    (r"^\w$", "\u2168", False), (r"^\w$", "\u093e", False), (r"^\w$", "\u0301", True), (r"^\w$", "\u203f", True), (r"^\w$", "\u0669", True), (r"^\W$", "\u2168", True), (r"^[\w-]$", "\u093e", False), (r"^[\W]$", "\u093e", True),
    (r"^[^\w]$", "\u2168", True), (r"a\b", "a\u2168", True), (r"a\B", "a\u2168", False), (r"a\b", "a\u200d", False), (r"a\B", "ab", True), (r"(?x)^[ ]$", " ", True), (r"(?x)^[#]$", "#", True), (r"^[\d-z]$", "-", True), (r"^[a-c-[b]]$", "b", False),
    (r"^[a-c-[b]]$", "c", True), (r"^[\x41-\u0043]$", "B", True), (r"^[\t-\r]$", "\n", True), (r"^[&&~^]$", "&", True), (r"^[\]]$", "]", True), (r"^.$", "\u2028", True), (r"^[\cA-\cC]$", "\x02", True),
]


def test_classes_and_boundaries_of_the_dialect(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(WORDS)], "i int, t string")
    names = frame_catalog(df, {"t": ("string", "1..1")})
    for i, (pattern, t, want) in enumerate(WORDS):
        got = df.filter(f"i = {i}").select(compiled(f'LITERALLY(t) =~ r"{pattern}"', names).truth.alias("x")).first()["x"]
        assert got is want, (pattern, t)


def test_all_semantic_errors_are_reported_in_order(catalog):
    with pytest.raises(PredicateError) as e:
        compiled('nosuch == 1 AND v != 1 AND artist == 5 AND "x" AS NUMBER > 1', catalog[1])
    assert [d.code for d in e.value.diagnostics] == ["unknown-identifier", "ambiguous-not-equal", "type-mismatch", "constant-does-not-convert"]


@pytest.mark.parametrize("text,rewrites", [("v != 1", ["NOT v == 1", "ALL(v) != 1"]), ("ALL(v) AS STRING == \"1\"", ["ALL(v AS STRING) == \"1\""]), ("a == b == c", ["a == b AND b == c"]), ("flag&&flag", ["flag AND flag"]), ("v IS NOT USABLE", ["NOT (v IS USABLE)"]), ("atrist == \"x\"", ["artist == \"x\""]), ("v == NULL", ["v IS ABSENT"])])
def test_rewrites(catalog, text, rewrites):
    with pytest.raises(PredicateError) as e:
        compiled(text, catalog[1])
    assert e.value.diagnostics[0].rewritten(text) == rewrites


@pytest.mark.parametrize("text,tree", [("a OR b AND NOT c", "(or a (and b (not c)))"), ("5BETWEEN 1..10", None), ('r"a" == R"b"', "(== raw:a raw:b)"), ("x AS A AS B == 1", "(== (as-b (as-a x)) number:1)"), ("f(a, b) == s::g(\"x\")", "(== (f a b) (s::g string:x))")])
def test_trees(text, tree):
    if tree is None:
        with pytest.raises(PredicateError):
            parse(text)
    else:
        assert printed(parse(text)) == tree


def test_plain_comparisons_reach_the_scan(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id * 1.5D AS price", "CAST(id AS string) AS name")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    names = frame_catalog(df, {"id": ("number", "1..1"), "price": ("number", "1..1")})
    kept = compiled("id > 3 AND price <= 9", names).filter(df).select("id")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "LessThanOrEqual(price,9.0)" in plan and "name" not in plan
    assert [r["id"] for r in kept.collect()] == [4, 5, 6]


def test_many_origins_and_wide_numbers(spark):
    df = spark.createDataFrame([(["x"] * 2, ["0.1234567890123", "12345678901234567890123456789"])], "s array<string>, n array<string>")
    names = frame_catalog(df, {"s": ("string", "0..n"), "n": ("string", "0..n")})
    text = " OR ".join(f"s AS NUMBER > {i}" for i in range(70))
    assert df.select(compiled(text, names).consumed.alias("w")).first()["w"] == ["s AS NUMBER"]
    for p, t in (("n AS NUMBER == 0.1234567890123", True), ("n AS NUMBER == 0.1234567890124", False), ("n AS NUMBER > 12345678901234567890123456788", True), ('n AS NUMBER AS STRING == "0.1234567890123"', True), ("n AS NUMBER BETWEEN 0.12..0.13", True)):
        assert df.select(compiled(p, names).truth.alias("t")).first()["t"] is t, p


def test_text_converts_like_literals_read(spark):
    from tessitura.functions import convert

    rng = random.Random(1)
    xs = ["12345678901234567890123456789b", "0.12345678901234567890123456kb", "79228162514264337593543950335", "79228162514264337593543950336", "1.4KiB", "5.b", " 5", "1m1h", "3:60", "250:00:00", "0.0000001", "7.9228162514264337593543950335", "0" * 37 + "1", ""]
    xs += ["".join(rng.choice("0123456789.:hmskbi+- ") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "s string")
    for kind, read in (("number", convert.number_from_text), ("duration", convert.duration_from_text), ("bytecount", convert.bytecount_from_text)):
        for r in df.select("s", convert.text_of(read(F.col("s")), True).alias("t")).collect():
            value = convert.constant(r["s"], "string", kind)
            assert r["t"] == (None if value is None else convert.canonical(value)), (kind, r["s"])
