"""Scalar functions of the PostgreSQL dialect that Spark lacks or means otherwise, as column builders; JSON surgery as Arrow UDFs."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import analysis
from weft.operators.graph import settled


#: Exponentials of more are infinite.
MOST_EXP = 709.782712893384


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm over a sequence long enough for 64 bits: it stays within Spark."""
    start = F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide(F.abs(a.cast("bigint")), gcd(a, b))) * F.abs(b.cast("bigint")), F.lit(0)).cast("bigint")


def trunc(x: Column, digits: int = 0) -> Column:
    """Toward zero."""
    scale = float(10**digits)
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)).cast("double") / scale


def nearest(x: Column, digits: int) -> Column:
    """x rounded to so many digits as SQL engines round doubles: the double nearest to x times the power of ten, halves away from
    zero, over that power; x itself where that is too large. Spark's round() rounds the shortest decimal of x instead."""
    m = F.lit(10.0**digits)
    y = x.cast("double") * m
    a, r = F.abs(y), F.rint(F.abs(y))
    z = F.signum(y) * F.when(a - r == 0.5, r + 1).otherwise(r) / m
    return F.when(F.abs(z) < float("inf"), z).otherwise(x.cast("double"))


@F.pandas_udf(T.DoubleType())
def exp(x: pd.Series) -> pd.Series:
    """The C library's exponential, as SQL engines have it: the JVM's differs in the last bit of some."""
    return x.map(lambda v: math.exp(v) if v == v and v < MOST_EXP else v * math.inf, na_action="ignore")


def floor_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down; null by 0."""
    return F.floor(F.try_divide(a, b)).cast("bigint")


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of b; null by 0."""
    return F.try_mod(F.try_mod(a, b) + b, b)


def bankers_round(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def initcap(s: Column) -> Column:
    """Upper case after anything that isn't a letter."""
    parts = F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def left(s: Column, n: int) -> Column:
    """The first n characters; for negative n all but the last -n."""
    return F.substring(s, 1, n) if n >= 0 else s.substr(F.lit(1), F.greatest(F.lit(0), F.length(s) + n))


def right(s: Column, n: int) -> Column:
    return F.lit("") if n <= 0 else F.when(F.length(s) <= n, s).otherwise(s.substr(F.length(s) - n + 1, F.lit(n)))


def regexp_replace(s: Column, pattern: str, new: str, flags: str = "") -> Column:
    """The first match, or all with flag g; i ignores case."""
    p = f"(?i){pattern}" if "i" in flags else pattern
    new = re.sub(r"\\(\d)", r"$\1", new)
    if "g" in flags:
        return F.regexp_replace(s, p, new)
    groups = re.compile(pattern).groups
    later = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", new)
    return F.regexp_replace(s, rf"(?s)\A(.*?)(?:{p})(.*)\z", f"$1{later}${groups + 2}")


PATTERNS = [("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("AM", "a"), ("Month", "MMMM"), ("Mon", "MMM"), ("Day", "EEEE"), ("Dy", "EEE"), ("YY", "yy"), ("DDD", "DDD"), ("Q", "Q")]


def date_pattern(tokens: str) -> str:
    """A PostgreSQL date pattern in Spark's letters; other letters are quoted."""
    names = dict(PATTERNS)
    some = "|".join(sorted(names, key=len, reverse=True))
    return "".join(names.get(t) or (f"'{t}'" if t.isalpha() else t) for t in re.findall(rf"{some}|.", tokens))


def to_char(ts: Column, tokens: str) -> Column:
    return F.date_format(ts, date_pattern(tokens))


def to_date(s: Column, tokens: str) -> Column:
    return F.try_to_date(s, date_pattern(tokens)) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(s, F.lit(date_pattern(tokens))))


def to_timestamp(s: Column, tokens: str) -> Column:
    return F.try_to_timestamp(s, F.lit(date_pattern(tokens)))


def to_number(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9.-]", "").try_cast("double")


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Half-open periods share some time; bounds may be given in either order."""
    return (F.least(a1, a2) < F.greatest(b1, b2)) & (F.least(b1, b2) < F.greatest(a1, a2))


def age(a: Column, b: Column) -> Column:
    """'N years N mons N days' by years of 365 and months of 30 days; the sign is dropped."""
    d = F.abs(F.datediff(a, b))
    y, rest = F.floor(d / 365), d % 365
    m, n = F.floor(rest / 30), rest % 30
    parts = [F.when(y > 0, F.concat(y.cast("string"), F.lit(" years"))), F.when(m > 0, F.concat(m.cast("string"), F.lit(" mons"))), F.when((n > 0) | ((y == 0) & (m == 0)), F.concat(n.cast("string"), F.lit(" days")))]
    return F.when(d.isNotNull(), F.concat_ws(" ", *parts))


def make_interval(years=0, months=0, days=0, hours=0, mins=0, secs=0) -> Column:
    """HH:MM:SS by years of 365 and months of 30 days."""
    s = F.lit(((years * 365 + months * 30 + days) * 24 + hours) * 3600 + mins * 60 + secs).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def extract(part: str, ts: Column) -> Column:
    """year month day hour minute second quarter week doy, dow (Sunday 0), epoch."""
    if part == "dow":
        return F.dayofweek(ts) - 1
    if part == "epoch":
        return F.unix_micros(ts.cast("timestamp")) / 1e6
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "week": F.weekofyear, "doy": F.dayofyear}[part](ts)


def isfinite(ts: Column) -> Column:
    return ~F.lower(ts.cast("string")).isin("infinity", "-infinity")


def trim_scale(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def min_scale(x: Column) -> Column:
    return F.length(F.regexp_extract(trim_scale(x), r"\.(\d+)$", 1))


def encode(s: Column, form: str) -> Column:
    raw = F.encode(s, "UTF-8")
    return {"base64": F.base64(raw), "hex": F.lower(F.hex(raw)), "escape": s}[form]


def decode(s: Column, form: str) -> Column:
    return {"base64": F.decode(F.unbase64(s), "UTF-8"), "hex": F.decode(F.unhex(s), "UTF-8"), "escape": s}[form]


def array_lower(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.lit(1))


def array_upper(a: Column) -> Column:
    return F.nullif(F.size(a), F.lit(0))


def array_cat(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))


# --- JSON text -------------------------------------------------------------------------------------------------------------


def _json(c: Column, f: Callable, kind: str = "string") -> Column:
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(json.loads(x)))

    return run(c)


def _dump(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def json_typeof(c: Column) -> Column:
    return _json(c, lambda x: {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number"))


def json_get(c: Column, *path: str | int) -> Column:
    """The value at a path as text; strings without quotes."""
    return F.get_json_object(c, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def json_set(c: Column, path: list[str], value, create: bool = True) -> Column:
    """The document with the value at a path replaced, or put there if `create`."""

    def put(x):
        at = x
        for k in path[:-1]:
            at = at[int(k)] if isinstance(at, list) else at.setdefault(k, {}) if create else at.get(k, {})
        k = path[-1]
        if isinstance(at, list):
            i = int(k)
            if -len(at) <= i < len(at):
                at[i] = value
            elif create:
                at.append(value)
        elif create or k in at:
            at[k] = value
        return _dump(x)

    return _json(c, put)


def _without_nulls(x):
    if isinstance(x, dict):
        return {k: _without_nulls(v) for k, v in x.items() if v is not None}
    return [_without_nulls(v) for v in x] if isinstance(x, list) else x


def json_strip_nulls(c: Column) -> Column:
    return _json(c, lambda x: _dump(_without_nulls(x)))


def contained(a, b) -> bool:
    """JSON containment: all of b is in a."""
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and contained(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(contained(x, y) for x in a) for y in b)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def json_contains(c: Column, value) -> Column:
    return _json(c, lambda x: contained(x, value), "boolean")


def json_has_key(c: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(c), key)


# --- relational helpers ------------------------------------------------------------------------------------------------------


def text_similarity_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], least: float = 0.5, analyzer: str = "plain") -> DataFrame:
    """(left_id, right_id, jaccard) of pairs of rows whose sets of tokens have at least that Jaccard: pairs are made by an
    equi-join on tokens, overlaps are counted, and sizes joined once."""
    own = analysis.column(analyzer)

    def sets(df, on, name):
        t = df.select(F.col(on[0]).alias(name), F.array_distinct(own(F.col(on[1]))).alias("s"))
        return t.select(name, F.explode("s").alias("token"), F.size("s").alias(f"n_{name}"))

    a, b = sets(left, left_on, "left_id"), sets(right, right_on, "right_id")
    o = a.join(b, "token").groupBy("left_id", "right_id").agg(F.count("*").alias("o"), F.first("n_left_id").alias("m"), F.first("n_right_id").alias("n"))
    return o.select("left_id", "right_id", (F.col("o") / (F.col("m") + F.col("n") - F.col("o"))).alias("jaccard")).where(F.col("jaccard") >= least)


def recursive_union(first: DataFrame, step: Callable[[DataFrame], DataFrame], depth: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows that no earlier round had are stepped again, until there are none. Raises at `depth`."""
    seen = new = settled(first.distinct())
    for _ in range(depth):
        made = step(new).distinct()
        marked = made.join(seen, [made[c].eqNullSafe(seen[c]) for c in made.columns], "left_anti")
        new = settled(marked)
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise RecursionError(f"no fixpoint after {depth} rounds")
