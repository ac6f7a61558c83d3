"""How strings are prepared before they are compared.

Normalized: compatibility decomposition, no default-ignorables, no marks on Latin and Greek letters, simple case
folding, a few letters spelled out, recomposition. Literal: recomposition alone. In both, lone surrogates become
U+FFFD. The rules are applied to a string once.

In Spark all of it runs in generated JVM code. ASCII text needs the lower case alone. Text of characters that become one
character or a fixed pair, whatever stands beside them, goes by a table that the Python rules fill. For other text, the
normal forms are ICU's, which Spark ships for its collations, called as expressions, with regular expressions between. The
Python rules prepare constants, and everything where a session has no JVM at hand (Spark Connect), by a vectorized UDF.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode's Default_Ignorable_Code_Point, the blocks of Latin and Greek letters, and letters spelled out.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
LATIN_GREEK = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x2AF), (0x370, 0x3FF), (0x1D00, 0x1DBF), (0x1E00, 0x1FFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F))
SPELLED = {"ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ħ": "h"}
TRIMMED = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"  # white space, as a class of both Python and Java


def _within(code: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= code <= b for a, b in ranges)


@functools.lru_cache(1 << 14)
def fold(c: str) -> str:
    """Simple case folding: the lower case of the upper case, each only where it is one character."""
    if c in "ıİ":
        return "i"
    up = c.upper() if len(c.upper()) == 1 else c
    return up.lower() if len(up.lower()) == 1 else up


_LONE = re.compile("[\ud800-\udfff]")


def repaired(text: str) -> str:
    return _LONE.sub("\ufffd", text)


@functools.lru_cache(1 << 14)
def _kind(c: str) -> tuple[bool, bool, bool]:
    """Whether a character is ignorable, a combining mark, a letter whose marks go."""
    return _within(ord(c), IGNORABLE), unicodedata.category(c)[0] == "M", _within(ord(c), LATIN_GREEK)


class _Folds(dict):
    """What becomes of a code point that no mark depends on, filled as it is asked for."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        folded = fold(c)
        self[code] = "" if _kind(c)[0] else SPELLED.get(folded, folded)
        return self[code]


class _Marks(dict):
    def __missing__(self, c: str) -> bool:
        self[c] = _kind(c)[1]
        return self[c]


_FOLDS, _MARKS = _Folds(), _Marks()


def _without_marks(text: str) -> str:
    """Decomposed text without the marks that go: those on Latin and Greek letters, and the dots of Cyrillic e."""
    out: list[str] = []
    base, bare = "", False
    for c in text:
        ignorable, mark, plain = _kind(c)
        if not mark:
            base, bare = (base, bare) if ignorable else (c, plain)
            out.append(c)
        elif not (bare or c == "\u0308" and base in ("\u0435", "\u0415")):
            out.append(c)
    return "".join(out)


def normalized(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", repaired(text))
    if any(map(_MARKS.__getitem__, set(text))):
        text = _without_marks(text)
    return unicodedata.normalize("NFC", text.translate(_FOLDS))


def literal(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", repaired(text))


def prepared(text: str, literally: bool) -> str:
    return literal(text) if literally else normalized(text)


def _set(ranges: tuple[tuple[int, int], ...]) -> str:
    """The ranges within a character class of Java."""
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


# Marks and ignorable characters are looked for at marks alone, which most text hasn't.
_IGNORED = f"[\\x{{ad}}-\\x{{e0fff}}&&[{_set(IGNORABLE)}]]+"
_BARE_MARKS = f"[\\x{{300}}-\\x{{10ffff}}&&\\p{{M}}]+(?<=[{_set(LATIN_GREEK)}]\\p{{M}}{{1,255}})"
_DOTS = "\\x{308}(?<=[\\x{435}\\x{415}]\\p{M}{1,255})"
# Lower-case letters that fold to another one, beside those spelled out.
_REFOLDED = {
    "\u03c2": "\u03c3", "\u0131": "i", "\u0345": "\u03b9",
    "\u1c80": "\u0432", "\u1c81": "\u0434", "\u1c82": "\u043e", "\u1c83": "\u0441", "\u1c84": "\u0442",
    "\u1c85": "\u0442", "\u1c86": "\u044a", "\u1c87": "\u0463", "\u1c88": "\ua64b",
}


def _jvm():
    """The JVM of this session; None where there is none at hand."""
    try:
        from pyspark.sql.utils import is_remote

        return None if is_remote() else SparkContext._active_spark_context._jvm
    except (AttributeError, ImportError):
        return None


def _normal_form(c: Column, name: str, compatible: bool) -> Column:
    """ICU's Normalizer.compose or .decompose as an expression; bytes that are no text become U+FFFD on the way."""
    from pyspark.sql.classic.column import _to_seq

    sc, jvm = SparkContext._active_spark_context, _jvm()
    made, objects = jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions.objects
    of = lambda n: jvm.java.lang.Class.forName(n, True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    seq = lambda *xs: _to_seq(sc, list(xs))
    java_string, nothing = jvm.org.apache.spark.sql.types.ObjectType(of("java.lang.String")), jvm.scala.Option.empty()
    spark_string = getattr(getattr(jvm.org.apache.spark.sql.types, "StringType$"), "MODULE$")
    text = objects.Invoke(made.expression(c._jc), "toString", java_string, seq(), seq(), True, True, True)
    form = objects.StaticInvoke(of("com.ibm.icu.text.Normalizer"), java_string, name, seq(text, made.expression(F.lit(compatible)._jc)), seq(), True, True, True, nothing)
    back = objects.StaticInvoke(of("org.apache.spark.unsafe.types.UTF8String"), spark_string, "fromString", seq(form), seq(), True, True, True, nothing)
    return Column(made.column(back))


def _folded(c: Column) -> Column:
    singles = {**{k: v for k, v in SPELLED.items() if len(v) == 1}, **_REFOLDED}
    rare = "[" + "".join(f"\\x{{{ord(x):x}}}" for x in (*SPELLED, *_REFOLDED)) + "]"

    def respelled(x: Column) -> Column:
        out = F.translate(x, "".join(singles), "".join(singles.values()))
        for old, new in SPELLED.items():
            if len(new) > 1:
                out = F.replace(out, F.lit(old), F.lit(new))
        return F.when(x.rlike(rare), out).otherwise(x)

    # A lambda variable is computed once, however often it is used.
    return F.element_at(F.transform(F.array(F.lower(c)), respelled), 1)


# Blocks whose characters a table may hold, for two kinds of text, since a pattern of few ranges is the faster one: Latin;
# and Greek, Cyrillic, kana, ideographs and syllables of Hangul. Both hold ASCII.
_LATIN = ((0x9, 0xD), (0x20, 0x7E), (0xA1, 0x24F), (0x1EA0, 0x1EF9))
_OTHER = ((0x20, 0x7E), (0x400, 0x52F), (0x30A1, 0x30FA), (0x30FC, 0x30FE), (0x4E00, 0x9FFF), (0x3041, 0x3096), (0xAC00, 0xD7A3), (0x386, 0x3CE))
_PAIRS = ("ß", "æ", "Æ", "œ", "Œ", "þ", "Þ")


@functools.cache
def _table(blocks: tuple[tuple[int, int], ...]) -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """Characters and what each becomes, those that become a pair, and a pattern of texts of such characters alone.

    What a character becomes doesn't depend on its neighbours where neither it nor its result holds a mark, an ignorable
    character or a letter of Hangul that joins with others.
    """
    ones, pairs, ranges = [], [], []
    joins = lambda c: unicodedata.category(c)[0] == "M" or _kind(c)[0] or 0x1100 <= ord(c) <= 0x11FF
    for first, last in blocks:
        same = first in (0x4E00, 0xAC00)  # they become themselves
        begin = first
        for code in range(first, last + 1) if not same else ():
            c = chr(code)
            new = normalized(c)
            if joins(c) or any(map(joins, new)) or len(new) != 1 and c not in _PAIRS:
                ranges += [(begin, code - 1)] * (begin < code)
                begin = code + 1
            elif new != c:
                (ones if len(new) == 1 else pairs).append((c, new))
        ranges += [(begin, last)] * (begin <= last)
    return "".join(c for c, _ in ones), "".join(new for _, new in ones), tuple(pairs), f"^[{_set(tuple(ranges))}]*\\z"


def _prepared_in_jvm(c: Column, literally: bool) -> Column:
    ascii_ = F.octet_length(c) == F.char_length(c)
    if literally:
        return F.when(ascii_, c).otherwise(_normal_form(c, "compose", False))
    old, new, pairs, latin = _table(_LATIN)
    by_table = spelled = F.translate(c, old, new)
    for a, b in pairs:
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    by_table = F.when(c.rlike("[" + "".join(a for a, _ in pairs) + "]"), spelled).otherwise(by_table)
    old, new, _, known = _table(_OTHER)
    bare = F.regexp_replace(F.regexp_replace(_normal_form(c, "decompose", True), _IGNORED, ""), _BARE_MARKS, "")
    other = _normal_form(_folded(F.regexp_replace(bare, _DOTS, "")), "compose", False)
    return F.when(ascii_, F.lower(c)).when(c.rlike(latin), by_table).when(c.rlike(known), F.translate(c, old, new)).otherwise(other)


def _udf(literally: bool, bag: bool):
    """The Python rules over Arrow arrays, each distinct string of a batch once."""

    def scalars(a: pa.Array) -> pa.Array:
        coded = a.dictionary_encode()
        words = pa.array([None if x is None else prepared(x, literally) for x in coded.dictionary.to_pylist()], pa.string())
        return words.take(coded.indices)

    def bags(a: pa.Array) -> pa.Array:
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.list_value_length(a), 0))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), scalars(a.flatten()), mask=a.is_null())

    for f in (scalars, bags):
        f.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(bags, "array<string>") if bag else F.arrow_udf(scalars, "string")


def prepare(c: Column, literally: bool, bag: bool) -> Column:
    """A string column, or an array of strings, prepared; nulls stay."""
    if _jvm() is None:
        return _udf(literally, bag)(c)
    return F.transform(c, lambda x: _prepared_in_jvm(x, literally)) if bag else _prepared_in_jvm(c, literally)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{TRIMMED}]+|[{TRIMMED}]+\\z", "")


_ENDS = re.compile(f"^[{TRIMMED}]+|[{TRIMMED}]+\\Z")


def trimmed(text: str) -> str:
    return _ENDS.sub("", text)
