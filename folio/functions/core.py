"""The few functions all rules are written in. Each takes Columns and gives a Column, or takes E and gives E.

White space is Python's, letters and digits are Unicode's, and patterns stay within what
Java and RE2 share: no look-around, no case flag (lower() first), quotes as \\x22 and \\x27.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.plans.sql import E, quoted

#: One character of white space, of a word, a letter, an upper- and a lower-case letter.
S = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
W, L = r"[\p{L}\p{N}_]", r"\p{L}"


def _sql(*values) -> bool:
    return any(isinstance(v, E) for v in values)


def lit(value, like=None):
    return E.of(value) if isinstance(like, E) else F.lit(value)


def _call(name: str, *args) -> E:
    return E(f"{name}({', '.join(str(E.of(a)) for a in args)})")


# ---- strings ----


def like(x, pattern: str):
    """Whether the pattern is found."""
    return E(f"regexp_matches({x}, {quoted(pattern)})") if _sql(x) else F.rlike(x, F.lit(pattern))


def full(x, pattern: str):
    """Whether the pattern is the whole of it."""
    return like(x, rf"^(?:{pattern})\z" if _sql(x) else rf"\A(?:{pattern})\z")


def sub(x, pattern: str, by: str):
    """Every match replaced; \\1 is the first group."""
    if _sql(x):
        return E(f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')")
    return F.regexp_replace(x, pattern, by.replace("$", r"\$").replace(r"\1", "$1").replace(r"\2", "$2"))


def found(x, pattern: str):
    """All matches, an array."""
    return E(f"regexp_extract_all({x}, {quoted(pattern)})") if _sql(x) else F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def matches(x, pattern: str):
    """How many."""
    return size(found(x, pattern))


def group(x, pattern: str, n: int = 1):
    """A group of the first match; empty without one."""
    return E(f"regexp_extract({x}, {quoted(pattern)}, {n})") if _sql(x) else F.regexp_extract(x, pattern, n)


def lower(x):
    return _call("lower", x) if _sql(x) else F.lower(x)


def upper(x):
    return _call("upper", x) if _sql(x) else F.upper(x)


def length(x):
    return _call("length", x) if _sql(x) else F.length(x)


def left(x, n):
    return E(f"substr({x}, 1, {E.of(n)})") if _sql(x) else F.substring(x, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def last(x):
    """The last character."""
    return E(f"right({x}, 1)") if _sql(x) else F.right(x, F.lit(1))


def first(x):
    return left(x, 1)


def behind(x, n):
    """What follows the first n characters."""
    return E(f"substr({x}, {E.of(n)} + 1)") if _sql(x) else F.substr(x, (n if isinstance(n, Column) else F.lit(n)) + 1)


def strip(x, characters: str | None = None):
    """Without white space, or any of these characters, at both ends."""
    one = S if characters is None else "[" + "".join(_in_class(c) for c in characters) + "]"
    return sub(sub(x, f"^{one}+", ""), rf"{one}+\z", "")


def lstrip(x):
    return sub(x, f"^{S}+", "")


def rstrip(x):
    return sub(x, rf"{S}+\z", "")


def _in_class(c: str) -> str:
    return f"\\x{{{ord(c):X}}}"


def squeeze(x):
    """Runs of white space as one space, none at the ends."""
    return strip(sub(x, f"{S}+", " "))


def plus(*parts):
    """Joined; null if a part is."""
    return E("(" + " || ".join(str(E.of(p)) for p in parts) + ")") if _sql(*parts) else F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def has(x, text: str):
    return E(f"contains({x}, {E.of(text)})") if _sql(x) else F.contains(x, text if isinstance(text, Column) else F.lit(text))


def starts(x, *texts: str):
    return any_of(*[E(f"starts_with({x}, {quoted(t)})") if _sql(x) else F.startswith(x, F.lit(t)) for t in texts])


def swapped(x, old: str, new: str):
    return _call("translate", x, old, new) if _sql(x) else F.translate(x, old, new)


def cut(x, text: str):
    """Split at a text; an array."""
    return E(f"string_split({x}, {quoted(text)})") if _sql(x) else F.split(x, "\\Q" + text + "\\E", -1)


def short_hash(x, n: int = 16):
    return E(f"substr(sha256({x}), 1, {n})") if _sql(x) else F.substring(F.sha2(x.cast("binary"), 256), 1, n)


def sha1(x):
    return _call("sha1", x) if _sql(x) else F.sha1(x.cast("binary"))


# ---- arrays ----


def words(x):
    """Runs of other characters than white space."""
    return keep(cut(squeeze(x), " "), lambda w: w != "")


def size(a):
    return _call("len", a) if _sql(a) else F.size(a)


_NAMES = iter(f"v{k}" for k in range(10**9))


def keep(a, test):
    if _sql(a):
        v = next(_NAMES)
        return E(f"list_filter({a}, lambda {v}: {test(E(v))})")
    return F.filter(a, lambda x: test(x))


def each(a, make):
    if _sql(a):
        v = next(_NAMES)
        return E(f"list_transform({a}, lambda {v}: {make(E(v))})")
    return F.transform(a, lambda x: make(x))


def joined(a, by: str = " "):
    return E(f"coalesce(array_to_string({a}, {quoted(by)}), '')") if _sql(a) else F.array_join(a, by)


def unique(a):
    return _call("list_distinct", a) if _sql(a) else F.array_distinct(a)


def shared(a, b):
    return E(f"list_intersect({a}, {b})") if _sql(a) else F.array_intersect(a, b)


def part(a, start, n):
    """n members from the start-th on, which counts from 1."""
    if _sql(a):
        return E(f"list_slice({a}, {E.of(start)}, {E.of(start)} + {E.of(n)} - 1)")
    return F.slice(a, start if isinstance(start, Column) else F.lit(start), n if isinstance(n, Column) else F.lit(n))


def reasons(*pairs):
    """The names whose test holds, in this order, comma-joined; pairs of name and test."""
    return joined(named(*pairs), ",")


def named(*pairs):
    if _sql(*[t for _, t in pairs]):
        return E("list_filter([" + ", ".join(f"CASE WHEN {t} THEN {quoted(n)} END" for n, t in pairs) + "], lambda r: r IS NOT NULL)")
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in pairs]), lambda r: r.isNotNull())


# ---- logic and numbers ----


def any_of(*tests):
    return reduce(lambda a, b: a | b, tests)


def all_of(*tests):
    return reduce(lambda a, b: a & b, tests)


def case(*pairs, other=None):
    """The value of the first test that holds; pairs of test and value."""
    sql = _sql(*[t for t, _ in pairs])
    if sql:
        return E("(CASE " + " ".join(f"WHEN {t} THEN {E.of(v)}" for t, v in pairs) + ("" if other is None else f" ELSE {E.of(other)}") + " END)")
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(pairs[0][0], value(pairs[0][1]))
    for t, v in pairs[1:]:
        out = out.when(t, value(v))
    return out if other is None else out.otherwise(value(other))


def first_of(*values):
    return _call("coalesce", *values) if _sql(*values) else F.coalesce(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def holds(test):
    """False where it is null."""
    return first_of(test, False)


def one(test):
    return E(f"(CASE WHEN {test} THEN 1 ELSE 0 END)") if _sql(test) else F.when(test, F.lit(1)).otherwise(F.lit(0))


def least(*values):
    return _call("least", *values) if _sql(*values) else F.least(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def greatest(*values):
    return _call("greatest", *values) if _sql(*values) else F.greatest(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def ratio(a, b, digits: int = 4):
    """Guarded: zero where the divisor is."""
    if _sql(a, b):
        return E(f"(CASE WHEN {b} = 0 THEN 0 ELSE round({a}::DOUBLE / {b}, {digits}) END)")
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / F.when(b == 0, F.lit(1)).otherwise(b), digits))


def whole(x):
    """Digits as a number."""
    return E(f"try_cast({x} AS BIGINT)") if _sql(x) else x.try_cast("long")


def floor(x):
    return E(f"floor({x})::BIGINT") if _sql(x) else F.floor(x).cast("long")


def text_of(x):
    """A number as text."""
    return E(f"{x}::VARCHAR") if _sql(x) else x.cast("string")


def nullif(x, value):
    return _call("nullif", x, value) if _sql(x) else F.nullif(x, F.lit(value))


def member(a, at):
    """The at-th member, from 1; null beyond the end."""
    return E(f"list_extract({a}, {E.of(at)})") if _sql(a) else F.get(a, (at if isinstance(at, Column) else F.lit(at)) - 1)


def halved(x):
    """Half of a count, rounded down, as an int."""
    return E(f"({x} // 2)") if _sql(x) else F.floor(x / 2).cast("int")
