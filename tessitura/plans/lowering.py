"""Typed trees to Columns: the truth of a predicate, the defects it consumed, and whether it had to open the record.

Truth is a nullable boolean: NULL is "can't be answered", and AND, OR and NOT are SQL's own. A bag's quantifiers are
`exists` and `forall`, which are three-valued alike; an absent operand makes an operator false before they run. An
operand that is exactly one stays a plain expression, so that Catalyst can push the comparison to the scan.

Consumed defects are sets of origins (a mention of an identifier or a conversion in the text), as bits of longs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import convert
from ..functions.text import prepare, prepared
from .analysis import Typed

WORD_BITS = 60
INTEGRAL = ("tinyint", "smallint", "int", "bigint")
EXACT_IN_DOUBLE = {"tinyint", "smallint", "int", "double"}


@dataclass(frozen=True)
class Origin:
    """Where an unusable occurrence arose: its source, and how and where that is written."""

    source: str
    text: str
    start: int


Mask = dict[int, Column]  # word -> bits; a word that is missing is zero


def both(a: Mask, b: Mask) -> Mask:
    return {w: a[w].bitwiseOR(b[w]) if w in a and w in b else a.get(w, b.get(w)) for w in {**a, **b}}


def only_if(condition: Column | None, m: Mask) -> Mask:
    return m if condition is None else {w: F.when(condition, c).otherwise(F.lit(0).cast("long")) for w, c in m.items()}


def bit(i: int) -> Mask:
    return {i // WORD_BITS: F.lit(1 << i % WORD_BITS).cast("long")}


Flag = Column | bool


def either(a: Flag, b: Flag) -> Flag:
    if isinstance(a, bool):
        return True if a else b
    return True if b is True else a if b is False else a | b


def flag_if(condition: Column, f: Flag) -> Flag:
    return False if f is False else condition if f is True else condition & f


@dataclass
class Bag:
    """An expression's value. `values` is an array (bag), or a plain column of which a null is unusable or absent."""

    values: Column
    bag: bool
    absent: Column | None = None  # None: never
    defects: Mask = field(default_factory=dict)  # of its unusable occurrences
    reported: Mask = field(default_factory=dict)  # consumed while it was worked out
    opened: Flag = False
    wide: bool = False
    spark_type: str = ""  # of a number, or of a bag's numbers, where it isn't a narrow decimal
    may_fail: bool = True

    def narrowed(self) -> None:
        """Numbers of another type as narrow decimals."""
        if not self.wide and self.spark_type not in ("", convert.NARROW):
            self.values, self.spark_type = self.elementwise(lambda x: x.cast(convert.NARROW)), convert.NARROW

    def array(self) -> Column:
        return self.values if self.bag else F.array(self.values) if self.absent is None else F.when(~self.absent, F.array(self.values))

    def elementwise(self, f: Callable[[Column], Column]) -> Column:
        return F.transform(self.values, f) if self.bag else f(self.values)


class Lowering:
    def __init__(self):
        self.origins: list[Origin] = []

    def origin(self, t: Typed, text: str) -> Mask:
        self.origins.append(Origin(t.shape, text, t.node.start))
        return bit(len(self.origins) - 1)

    def lower(self, t: Typed, text: str) -> Bag:
        return getattr(self, "_" + t.kind)(t, text)

    # Values

    def _constant(self, t: Typed, text: str) -> Bag:
        if t.type in convert.NUMERIC:
            wide = not convert.narrow_enough(t.value)
            return Bag(convert.number(t.value, wide), False, wide=wide, may_fail=False)
        return Bag(F.lit(t.value), False, may_fail=False)

    def _read(self, t: Typed, text: str) -> Bag:
        i = t.value
        c = i.column
        absent = None if i.required else c.isNull()
        some = F.exists(c, lambda x: x.isNull()) if i.bag else c.isNull() if i.required else None
        defects: Mask = {}
        if i.unreadable and some is not None:
            defects = only_if(some, self.origin(t, t.node.text(text)))
        single = i.bag and not i.several and i.required
        return Bag(F.get(c, F.lit(0)) if single else c, i.bag and not single, absent, defects, {}, i.opens, False, i.spark_type, i.unreadable)

    def _convert(self, t: Typed, text: str) -> Bag:
        a = self.lower(t.args[0], text)
        source, target = t.value
        if source in convert.NUMERIC:
            a.narrowed()
        wide = convert.converted(F.lit(None), source, target, a.wide)[1]
        one = lambda x: convert.converted(x, source, target, a.wide)[0]
        lost = lambda x: x.isNotNull() & one(x).isNull()
        own = only_if(F.exists(a.values, lost) if a.bag else lost(a.values), self.origin(t, t.node.text(text)))
        absent = a.absent
        return Bag(a.elementwise(one), a.bag, absent, both(a.defects, own), a.reported, a.opened, wide)

    def _count(self, t: Typed, text: str) -> Bag:
        a = self.lower(t.args[0], text)
        n = F.coalesce(F.size(a.values), F.lit(0)) if a.bag else F.lit(1) if a.absent is None else F.when(a.absent, 0).otherwise(1)
        return Bag(n.cast("int"), False, None, {}, a.reported, a.opened, False, "int", False)

    def _fallback(self, t: Typed, text: str) -> Bag:
        a, d = (self.lower(x, text) for x in t.args)
        wide = a.wide or d.wide
        if t.type in convert.NUMERIC:
            a, d = self._same_width(a, d)
        fill = lambda x: F.coalesce(x, d.values)
        if a.bag:
            values = F.transform(a.values, fill)
            if a.absent is not None:
                values = F.when(a.absent, F.array(d.values)).otherwise(values)
            if not t.several:
                return Bag(F.get(values, F.lit(0)), False, None, {}, a.reported, a.opened, wide, may_fail=False)
            return Bag(values, True, None, {}, a.reported, a.opened, wide, may_fail=False)
        return Bag(fill(a.values), False, None, {}, a.reported, a.opened, wide, may_fail=False)

    def _same_width(self, *bags: Bag) -> list[Bag]:
        """Numbers in one form: narrow decimals, or all wide if one is."""
        wide = any(b.wide for b in bags)
        for b in bags:
            if wide and not b.wide:
                b.values, b.wide = b.elementwise(convert.widened), True
            elif not wide:
                b.narrowed()
        return list(bags)

    def _preferred(self, t: Typed, text: str) -> Bag:
        args = [self.lower(a, text) for a in t.args]
        if t.type in convert.NUMERIC:
            args = self._same_width(*args)
        arrays = [a.array() for a in args]
        usable = [F.coalesce(F.exists(x, lambda v: v.isNotNull()), F.lit(False)) for x in arrays]
        values = F.coalesce(*(F.when(u, x) for u, x in zip(usable, arrays)), *arrays)
        reported, opened, defects = {}, False, {}
        before: Column | None = None  # an earlier argument has settled it
        for a, u in zip(args, usable):
            reached = None if before is None else ~before
            reported = both(reported, only_if(reached, a.reported))
            opened = either(opened, a.opened if reached is None else flag_if(reached, a.opened))
            before = u if before is None else before | u
        for i, (a, x) in enumerate(zip(args, arrays)):
            first = reduce(lambda p, q: p & q, [~u for u in usable[:i]], usable[i])
            none = reduce(lambda p, q: p & q, [~u for u in usable], reduce(lambda p, q: p & q, [y.isNull() for y in arrays[:i]], x.isNotNull()))
            defects = both(defects, only_if(first | none, a.defects))
        absent = None if t.required else values.isNull()
        if t.required and not t.several:
            return Bag(F.get(values, F.lit(0)), False, None, defects, reported, opened, args[0].wide)
        return Bag(values, True, absent, defects, reported, opened, args[0].wide)

    # Operators

    def _operands(self, t: Typed, text: str) -> list[Bag]:
        out = []
        for a in t.args:
            b = self.lower(a, text)
            if a.type == "string":
                if a.constant:
                    b.values = F.lit(prepared(a.value, t.literally))
                else:
                    b.values = prepare(b.values, t.literally, b.bag)
            out.append(b)
        return out

    def _aligned(self, t: Typed, a: Bag, b: Bag) -> None:
        """Numbers made comparable: a plain column with a constant in the column's own type where that is exact."""
        if t.args[0].type not in convert.NUMERIC:
            return
        for x, y, constant in ((a, b, t.args[1]), (b, a, t.args[0])):
            if constant.constant and x.spark_type and not x.wide:
                value = constant.value
                if x.spark_type in INTEGRAL and value == value.to_integral_value() and abs(value) < 2**31:
                    y.values, y.wide = F.lit(int(value)), False
                    return
                if x.spark_type == "double" and float(value) == value:
                    y.values, y.wide = F.lit(float(value)), False
                    return
        if {a.spark_type, b.spark_type} <= set(INTEGRAL) or {a.spark_type, b.spark_type} <= EXACT_IN_DOUBLE:
            return
        self._same_width(a, b)

    def _decided(self, operands: list[Bag], truth: Column, reads: bool = True) -> Bag:
        """The result of an operator that reads its operands' content."""
        absents = [b.absent for b in operands if b.absent is not None]
        absent = reduce(lambda p, q: p | q, absents) if absents else None
        if absent is not None:
            truth = F.when(absent, F.lit(False)).otherwise(truth)
        reported = reduce(both, (b.reported for b in operands))
        consumed = reduce(both, (b.defects for b in operands))
        if consumed:
            reported = both(reported, only_if(None if absent is None else ~absent, consumed))
        opened = reduce(either, (b.opened for b in operands))
        return Bag(truth, False, None, {}, reported, opened)

    @staticmethod
    def _over(b: Bag, universal: bool, test: Callable[[Column], Column]) -> Column:
        if not b.bag:
            return test(b.values)
        return (F.forall if universal else F.exists)(b.values, test)

    def _compare(self, t: Typed, text: str) -> Bag:
        a, b = self._operands(t, text)
        self._aligned(t, a, b)
        ops = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
        test = ops[t.value]
        every = [q == "ALL" for q in t.quantifiers]
        if every[1] and not every[0]:  # the universal side is outermost
            truth = self._over(b, True, lambda y: self._over(a, False, lambda x: test(x, y)))
        else:
            truth = self._over(a, every[0], lambda x: self._over(b, every[1], lambda y: test(x, y)))
        return self._decided([a, b], truth)

    def _between(self, t: Typed, text: str) -> Bag:
        (b,) = self._operands(t, text)
        low, high = t.value
        if t.args[0].type == "string":
            test = lambda x: (F.substring(x, 1, len(low)) >= F.lit(low)) & (F.substring(x, 1, len(high)) <= F.lit(high))
        elif b.spark_type in INTEGRAL and all(v == v.to_integral_value() and abs(v) < 2**31 for v in t.value):
            test = lambda x: (x >= F.lit(int(low))) & (x <= F.lit(int(high)))
        elif b.spark_type == "double" and all(float(v) == v for v in t.value):
            test = lambda x: (x >= F.lit(float(low))) & (x <= F.lit(float(high)))
        else:
            wide = b.wide or not all(map(convert.narrow_enough, t.value))
            if wide and not b.wide:
                b.values = b.elementwise(convert.widened)
            elif not wide:
                b.narrowed()
            lo, hi = (convert.number(v, wide) for v in t.value)
            test = lambda x: F.when(x.isNotNull(), (x >= lo) & (x <= hi))
        return self._decided([b], self._over(b, t.quantifiers[0] == "ALL", test))

    def _match(self, t: Typed, text: str) -> Bag:
        (b,) = self._operands(t, text)
        return self._decided([b], self._over(b, t.quantifiers[0] == "ALL", lambda x: x.rlike(t.value)))

    def _state(self, t: Typed, text: str) -> Bag:
        a = self.lower(t.args[0], text)
        if t.value == "ABSENT":
            truth = F.lit(False) if a.absent is None else a.absent
        else:
            usable = t.value == "USABLE"
            if a.bag:
                truth = self._over(a, t.quantifiers[0] == "ALL", lambda x: x.isNotNull() if usable else x.isNull())
            elif a.absent is not None:
                truth = a.values.isNotNull() if usable else F.lit(False)
            else:
                truth = a.values.isNotNull() if usable else a.values.isNull()
            if a.absent is not None and a.bag:
                truth = F.when(a.absent, F.lit(False)).otherwise(truth)
        return Bag(truth, False, None, {}, a.reported, a.opened)

    # The logical operators. Truth is their operands' own; what they consumed and opened depends on the truths before,
    # so both are worked out over the leaves' results, each of which is computed once.

    def _not(self, t: Typed, text: str) -> Bag:
        return self._leaf_free(t, text)

    _and = _or = _not

    def _leaf_free(self, t: Typed, text: str) -> Bag:
        inner: list[Typed] = leaves(t)
        made = [self.lower(x, text) for x in inner]
        truth = {id(x): b.values for x, b in zip(inner, made)}
        words = sorted({w for b in made for w in b.reported})

        def found(s: Column) -> dict[int, tuple[Column, Mask, Flag]]:
            field = lambda i, b: (s[f"t{i}"], {w: s[f"r{i}_{w}"] for w in b.reported}, b.opened if isinstance(b.opened, bool) else s[f"o{i}"])
            return {id(x): field(i, b) for i, (x, b) in enumerate(zip(inner, made))}

        columns = [b.values.alias(f"t{i}") for i, b in enumerate(made)]
        columns += [b.reported[w].alias(f"r{i}_{w}") for i, b in enumerate(made) for w in b.reported]
        columns += [b.opened.alias(f"o{i}") for i, b in enumerate(made) if not isinstance(b.opened, bool)]
        once = F.struct(*columns)

        def word(w: int) -> Column:
            return let(once, lambda s: followed(t, found(s))[1].get(w, F.lit(0).cast("long")))

        reported = {w: word(w) for w in words}
        opened: Flag = False
        if any(b.opened is not False for b in made):
            always = followed(t, {id(x): (F.lit(None), {}, b.opened if isinstance(b.opened, bool) else True) for x, b in zip(inner, made)})[2]
            opened = True if always is True else let(once, lambda s: _flag(followed(t, found(s))[2]))
        return Bag(followed(t, {k: (v, {}, False) for k, v in truth.items()})[0], False, None, {}, reported, opened)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _flag(f: Flag) -> Column:
    return F.lit(f) if isinstance(f, bool) else f


def leaves(t: Typed) -> list[Typed]:
    """The conditions below logical operators, in order."""
    return [x for a in t.args for x in leaves(a)] if t.kind in ("not", "and", "or") else [t]


def followed(t: Typed, found: dict[int, tuple[Column, Mask, Flag]]) -> tuple[Column, Mask, Flag]:
    """Truth, consumed defects and opening of a tree over its leaves' results: a settled operator stops before its right side."""
    if t.kind not in ("not", "and", "or"):
        return found[id(t)]
    parts = [followed(a, found) for a in t.args]
    if t.kind == "not":
        return ~parts[0][0], parts[0][1], parts[0][2]
    (a, ra, oa), (b, rb, ob) = parts
    goes_on = ~a.eqNullSafe(F.lit(t.kind == "or"))
    return (a | b if t.kind == "or" else a & b), both(ra, only_if(goes_on, rb)), either(oa, flag_if(goes_on, ob))
