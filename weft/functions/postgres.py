"""PostgreSQL's scalar functions as Spark SQL: each call is rewritten, with its arguments, to an expression of built-in functions.

Only what changes or searches JSON documents by structure is an Arrow UDF, registered under a name of its own by register().
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from weft.functions import analysis, scalar

RADIUS = 6_371_000


def _constant(arg: str) -> str | None:
    """The value of a string constant; None for other expressions."""
    m = re.fullmatch(r"(?s)\s*'((?:[^']|'')*)'\s*", arg)
    return m[1].replace("''", "'") if m else None


def _string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pattern(arg: str, flags: str = "") -> str:
    """A pattern with the flags i, s, m and x inside it."""
    own = "".join(f for f in "ismx" if f in flags)
    p = _constant(arg)
    if p is not None:
        return _string((f"(?{own})" if own else "") + p)
    return f"concat('(?{own})', {arg})" if own else arg


def _groups(arg: str) -> int:
    p = _constant(arg)
    return re.compile(p).groups if p is not None else 0


def _flags(args: tuple, at: int) -> str:
    return (_constant(args[at]) or "") if len(args) > at else ""


def _left(s: str, n: str) -> str:
    return f"CASE WHEN {n} < 0 THEN substring({s}, 1, greatest(0, length({s}) + ({n}))) ELSE substring({s}, 1, {n}) END"


def _substring(s: str, start: str, n: str | None = None) -> str:
    return f"substring({s}, {start}{f', {n}' if n else ''})"


def _initcap(s: str) -> str:
    return f"array_join(transform(regexp_extract_all({s}, '(\\\\p{{L}}+|\\\\P{{L}}+)', 1), w -> concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), '')"


def _chr(n: str) -> str:
    """Code points beyond 255 too: UTF-16 units of the point, decoded."""
    unit = lambda x: f"lpad(hex({x}), 4, '0')"
    return f"decode(unhex(CASE WHEN {n} < 65536 THEN {unit(n)} ELSE concat({unit(f'55296 + ({n} - 65536) div 1024')}, {unit(f'56320 + ({n} - 65536) % 1024')}) END), 'UTF-16BE')"


def _format(pattern: str, *args: str) -> str:
    """%s and %I put a value in, %L puts it in quotes, %% is a per cent sign; a null is an empty string."""
    p = _constant(pattern)
    if p is None:
        return f"format_string({', '.join([pattern, *args])})"
    out, left = [], list(args)
    for piece in re.findall(r"%[sIL%]|[^%]+|%", p):
        if piece in ("%s", "%I", "%L"):
            value = f"coalesce(CAST({left.pop(0)} AS STRING), '')"
            out.append(f"concat('\\'', {value}, '\\'')" if piece == "%L" else value)
        else:
            out.append(_string("%" if piece == "%%" else piece))
    return f"concat({', '.join(out)})" if out else "''"


def _match_of(s: str, p: str, pattern: str) -> str:
    n = _groups(pattern)
    return f"array({', '.join(f'regexp_extract({s}, {p}, {i})' for i in (range(1, n + 1) if n else [0]))})"


def _regexp_match(s: str, pattern: str, *rest: str) -> str:
    p = _pattern(pattern, _flags(rest, 0))
    return f"CASE WHEN {s} RLIKE {p} THEN {_match_of(s, p, pattern)} END"


def _regexp_matches(s: str, pattern: str, *rest: str) -> str:
    flags = _flags(rest, 0)
    p = _pattern(pattern, flags.replace("g", ""))
    if "g" not in flags:
        return f"CASE WHEN {s} RLIKE {p} THEN array({_match_of(s, p, pattern)}) END"
    n = _groups(pattern)
    every = [f"regexp_extract_all({s}, {p}, {i})" for i in (range(1, n + 1) if n else [0])]
    if len(every) == 1:
        return f"transform({every[0]}, z -> array(z))"
    return f"transform(arrays_zip({', '.join(every)}), z -> array({', '.join(f'z.`{i}`' for i in range(len(every)))}))"


def _regexp_replace(s: str, pattern: str, new: str = "''", *rest: str) -> str:
    flags = _flags(rest, 0)
    text = _constant(new)
    p = _pattern(pattern, flags.replace("g", ""))
    java = lambda shift: _string(re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + shift}", text.replace("$", "\\$")))
    if text is None or _constant(pattern) is None:
        return f"regexp_replace({s}, {p}, {new}{'' if 'g' in flags else ', 1'})"
    if "g" in flags:
        return f"regexp_replace({s}, {p}, {java(0)})"
    own = "".join(f for f in "imx" if f in flags)
    first = _string(f"(?s)\\A(.*?)(?{own}:{_constant(pattern)})(.*)\\z")
    return f"regexp_replace({s}, {first}, concat('$1', {java(1)}, '${_groups(pattern) + 2}'))"


def _encode(s: str, form: str) -> str:
    raw = f"CAST({s} AS BINARY)"
    return {"base64": f"base64({raw})", "hex": f"lower(hex({raw}))"}.get((_constant(form) or "").lower(), s)


def _decode(s: str, form: str) -> str:
    return {"base64": f"decode(unbase64({s}), 'UTF-8')", "hex": f"decode(unhex({s}), 'UTF-8')"}.get((_constant(form) or "").lower(), s)


def _log(*args: str) -> str:
    return f"log({args[0]}, {args[1]})" if len(args) > 1 else f"log10({args[0]})"


def _round(x: str, digits: str = "0") -> str:
    """Half to even. Doubles are rounded as they print; the result has the type of x."""
    return f"bround({x}, {digits})"


def _mod(a: str, b: str) -> str:
    return f"try_mod(try_mod({a}, {b}) + {b}, {b})"


def _trunc(x: str, digits: str = "0") -> str:
    scaled = f"CAST({x} AS DOUBLE) * pow(10, {digits})"
    return f"(CASE WHEN {x} < 0 THEN ceil({scaled}) ELSE floor({scaled}) END) / pow(10, {digits})"


def quotient(a: str, b: str) -> str:
    """a / b: rounded down between integers, null by 0."""
    whole = "('tinyint', 'smallint', 'int', 'bigint')"
    return f"(CASE WHEN typeof({a}) IN {whole} AND typeof({b}) IN {whole} THEN floor(try_divide({a}, {b})) ELSE try_divide({a}, {b}) END)"


def _gcd(a: str, b: str) -> str:
    """Euclid's algorithm over a sequence long enough for 64 bits."""
    return f"aggregate(sequence(1, 92), named_struct('a', abs(CAST({a} AS BIGINT)), 'b', abs(CAST({b} AS BIGINT))), (s, _) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', try_mod(s.a, s.b)) END, s -> s.a)"


def _lcm(a: str, b: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN coalesce(abs(CAST({a} AS BIGINT)) div nullif({_gcd(a, b)}, 0) * abs(CAST({b} AS BIGINT)), 0) END)"


def _width_bucket(x: str, lo: str, hi: str, n: str) -> str:
    return f"(CASE WHEN {hi} = {lo} OR {n} <= 0 THEN NULL WHEN {x} < {lo} THEN 0 WHEN {x} >= {hi} THEN {n} + 1 ELSE CAST(floor(({x} - {lo}) / (({hi} - {lo}) / CAST({n} AS DOUBLE))) AS INT) + 1 END)"


def _trim_scale(x: str) -> str:
    return f"regexp_replace(regexp_replace(CAST({x} AS STRING), '(\\\\.\\\\d*?)0+$', '$1'), '\\\\.$', '')"


def _field(part: str, ts: str) -> str:
    part = part.strip().strip("'").lower()
    if part == "epoch":
        return f"(unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000)"
    return {"dow": f"(dayofweek({ts}) - 1)", "doy": f"dayofyear({ts})", "week": f"weekofyear({ts})", "isodow": f"(weekday({ts}) + 1)"}.get(part) or f"{part}({ts})"


def _extract(whole: str, *rest: str) -> str:
    if rest:
        return _field(whole, rest[0])
    part, ts = re.match(r"(?is)^\s*'?(\w+)'?\s+from\s+(.*)$", whole).groups()
    return _field(part, ts)


def _pattern_of(tokens: str) -> str:
    p = _constant(tokens)
    if p is None:
        raise ValueError("a date pattern must be a constant")
    return "'" + scalar.date_pattern(p).replace("'", "\\'") + "'"


def _make_interval(*args: str) -> str:
    """HH:MM:SS by years of 365 and months of 30 days; weeks aren't among the arguments, but for names."""
    names, given = ["years", "months", "weeks", "days", "hours", "mins", "secs"], {}
    for i, a in enumerate(args):
        m = re.match(r"(?is)^(\w+)\s*=>\s*(.*)$", a)
        given[m[1].lower() if m else names[i]] = m[2] if m else a
    g = lambda n: f"coalesce({given.get(n, '0')}, 0)"
    s = f"CAST((({g('years')} * 365 + {g('months')} * 30 + {g('weeks')} * 7 + {g('days')}) * 24 + {g('hours')}) * 3600 + {g('mins')} * 60 + {g('secs')} AS BIGINT)"
    return f"format_string('%02d:%02d:%02d', {s} div 3600, {s} div 60 % 60, {s} % 60)"


def _age(a: str, b: str = "current_timestamp()") -> str:
    d = f"abs(datediff({a}, {b}))"
    y, rest = f"{d} div 365", f"({d} % 365)"
    m, n = f"{rest} div 30", f"({rest} % 30)"
    part = lambda x, unit, also="": f"CASE WHEN {x} > 0{also} THEN concat(CAST({x} AS STRING), ' {unit}') END"
    return f"CASE WHEN {d} IS NOT NULL THEN concat_ws(' ', {part(y, 'years')}, {part(m, 'mons')}, {part(n, 'days', f' OR {d} = 0')}) END"


def _overlaps(a: str, b: str, c: str, d: str) -> str:
    return f"(least({a}, {b}) < greatest({c}, {d}) AND least({c}, {d}) < greatest({a}, {b}))"


def _typeof(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN typeof({x}) IN ('float', 'double') OR typeof({x}) LIKE 'decimal%' THEN 'real' ELSE 'text' END)"


# --- JSON: documents are text ------------------------------------------------------------------------------------------------


def json_value(x: str) -> str:
    """An expression as JSON text; strings that the dialect knows to be JSON stay as they are."""
    return x if re.match(r"(?is)^(?:(?:weft_json_\w+|get_json_object|to_json)\(|concat\('[\[{]')", x) else f"nullif(substring(to_json(named_struct('v', {x})), 6, length(to_json(named_struct('v', {x}))) - 6), '')"


def _json_build_array(*args: str) -> str:
    return f"concat('[', array_join(array({', '.join(f'coalesce({json_value(a)}, {chr(39)}null{chr(39)})' for a in args)}), ','), ']')" if args else "'[]'"


def _json_build_object(*args: str) -> str:
    pairs = [f"concat({json_value(f'CAST({k} AS STRING)')}, ':', coalesce({json_value(v)}, 'null'))" for k, v in zip(args[::2], args[1::2])]
    return f"concat('{{', array_join(array({', '.join(pairs)}), ','), '}}')" if pairs else "'{}'"


def _json_typeof(x: str) -> str:
    return f"(CASE coalesce(substring(trim({x}), 1, 1), '') WHEN '{{' THEN 'object' WHEN '[' THEN 'array' WHEN '\"' THEN 'string' WHEN 't' THEN 'boolean' WHEN 'f' THEN 'boolean' WHEN 'n' THEN 'null' WHEN '' THEN NULL ELSE 'number' END)"


def _json_path(x: str, *keys: str) -> str:
    path = "$" + "".join(f"[{k}]" if re.fullmatch(r"\d+", k := (_constant(a) if _constant(a) is not None else a)) else f"[\\'{k}\\']" for a in keys)
    return f"get_json_object({x}, '{path}')"


def _to_json(x: str) -> str:
    return f"weft_json_text(CAST({x} AS STRING), typeof({x}) = 'string')"


def _array_json(x: str) -> str:
    return f"from_json({x}, 'array<string>')"


def _haversine(a: str, b: str) -> str:
    at = lambda p, i: f"CAST({p} AS ARRAY<DOUBLE>)[{i}]"
    dp, dl = f"radians({at(b, 1)} - {at(a, 1)}) / 2", f"radians({at(b, 0)} - {at(a, 0)}) / 2"
    return f"(2 * {RADIUS} * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin({dp}), 2) + cos(radians({at(a, 1)})) * cos(radians({at(b, 1)})) * pow(sin({dl}), 2)))))"


def _within(a: str, b: str, metres: str) -> str:
    return f"({_haversine(a, b)} <= {metres})"


def _highlight(column: str, query: str, *rest: str) -> str:
    return f"weft_highlight({', '.join([column, query, *rest])})"


CALLS = {
    "btrim": lambda s, *c: f"trim(BOTH {c[0]} FROM {s})" if c else f"trim({s})",
    "ltrim": lambda s, *c: f"trim(LEADING {c[0]} FROM {s})" if c else f"ltrim({s})",
    "rtrim": lambda s, *c: f"trim(TRAILING {c[0]} FROM {s})" if c else f"rtrim({s})",
    "concat": lambda *a: f"concat_ws('', {', '.join(a)})", "left": _left, "right": lambda s, n: f"CASE WHEN {n} <= 0 THEN '' ELSE right({s}, {n}) END",
    "initcap": _initcap, "chr": _chr, "format": _format, "strpos": lambda s, x: f"instr({s}, {x})", "starts_with": lambda s, x: f"startswith({s}, {x})",
    "regexp_match": _regexp_match, "regexp_matches": _regexp_matches, "regexp_replace": _regexp_replace,
    "regexp_split_to_array": lambda s, p, *f: f"split({s}, {_pattern(p, _flags(f, 0))})", "string_to_array": lambda s, d: f"split({s}, concat('\\\\Q', {d}, '\\\\E'))",
    "split_part": lambda s, d, n: f"CASE WHEN {n} < 1 THEN '' ELSE split_part({s}, {d}, greatest(1, {n})) END",
    "exp": lambda x: f"weft_exp(CAST({x} AS DOUBLE))", "encode": _encode, "decode": _decode, "round": _round, "log": _log, "mod": _mod, "trunc": _trunc, "div": lambda a, b: f"CAST(floor(try_divide({a}, {b})) AS BIGINT)",
    "gcd": _gcd, "lcm": _lcm, "width_bucket": _width_bucket, "trim_scale": lambda x: f"CAST({_trim_scale(x)} AS DOUBLE)", "min_scale": lambda x: f"length(regexp_extract({_trim_scale(x)}, '\\\\.(\\\\d+)$', 1))", "random": lambda: "rand()",
    "now": lambda: "date_trunc('SECOND', current_timestamp())", "clock_timestamp": lambda: "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "timeofday": lambda: "date_format(current_timestamp(), 'EEE MMM dd HH:mm:ss.SSSSSS yyyy')",
    "extract": _extract, "date_part": _extract, "make_timestamp": lambda *a: f"make_timestamp_ntz({', '.join(a)})", "make_interval": _make_interval, "isfinite": lambda x: f"(lower(CAST({x} AS STRING)) NOT IN ('infinity', '-infinity'))",
    "to_char": lambda x, p: f"date_format({x}, {_pattern_of(p)})", "to_date": lambda x, *p: f"CAST(try_to_timestamp({', '.join([x, *map(_pattern_of, p)])}) AS DATE)", "to_timestamp": lambda x, *p: f"try_to_timestamp({', '.join([x, *map(_pattern_of, p)])})",
    "age": _age, "to_number": lambda x, *p: f"try_cast(regexp_replace({x}, '[^0-9.-]', '') AS DOUBLE)", "overlaps": _overlaps, "typeof": _typeof,
    "array_length": lambda a, *d: f"nullif(size({a}), -1)", "array_upper": lambda a, *d: f"CASE WHEN size({a}) > 0 THEN size({a}) END", "array_lower": lambda a, *d: f"CASE WHEN size({a}) > 0 THEN 1 END", "array_cat": lambda a, b: f"concat(coalesce({a}, array()), coalesce({b}, array()))", "array_agg": lambda x: f"collect_list({x})", "json_agg": lambda x: f"collect_list({x})",
    "gen_random_uuid": lambda: "uuid()", "every": lambda x: f"bool_and({x})", "char_length": lambda s: f"length({s})", "character_length": lambda s: f"length({s})",
    "point": lambda x, y: f"array(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))", "st_distance": _haversine, "st_within": _within, "st_dwithin": _within, "uqa_highlight": _highlight, "highlight": _highlight,
}
for _kind in ("json", "jsonb"):
    CALLS |= {
        f"{_kind}_build_object": _json_build_object, f"{_kind}_build_array": _json_build_array, f"{_kind}_typeof": _json_typeof, f"{_kind}_array_length": lambda x: f"json_array_length({x})", f"{_kind}_extract_path": _json_path, f"{_kind}_extract_path_text": _json_path,
        f"{_kind}_object_keys": lambda x: f"json_object_keys({x})", f"{_kind}_strip_nulls": lambda x: f"weft_json_strip_nulls({x})", f"{_kind}_array_elements": _array_json, f"{_kind}_array_elements_text": _array_json,
        f"{_kind}_each": lambda x: f"map_entries(from_json({x}, 'map<string,string>'))", f"{_kind}_each_text": lambda x: f"map_entries(from_json({x}, 'map<string,string>'))",
        f"{_kind}_object_agg": lambda k, v: f"to_json(map_from_entries(collect_list(struct(CAST({k} AS STRING), {v}))))", f"{_kind}_set": lambda x, p, v, *c: f"weft_json_set({x}, {p}, {v}, {c[0] if c else 'true'})", f"{_kind}_insert": lambda x, p, v, *c: f"weft_json_set({x}, {p}, {v}, {c[0] if c else 'true'})",
    }
CALLS |= {"to_json": _to_json, "to_jsonb": _to_json, "row_to_json": _to_json}


def _loads(x):
    try:
        return json.loads(x)
    except (TypeError, ValueError):
        return x


def _keys(path: str) -> list[str]:
    return [k.strip().strip('"') for k in path.strip().strip("{}").split(",") if k.strip()]


def _put(doc, path: list[str], value, create: bool):
    at = doc
    for k in path[:-1]:
        if isinstance(at, list):
            if not -len(at) <= int(k) < len(at):
                return doc
            at = at[int(k)]
        elif isinstance(at, dict):
            if k not in at:
                if not create:
                    return doc
                at[k] = {}
            at = at[k]
        else:
            return doc
    k = path[-1] if path else None
    if isinstance(at, list) and re.fullmatch(r"-?\d+", k or ""):
        if -len(at) <= int(k) < len(at):
            at[int(k)] = value
        elif create:
            at.append(value)
    elif isinstance(at, dict) and k is not None and (create or k in at):
        at[k] = value
    return doc


def register(spark: SparkSession) -> None:
    """The Arrow UDFs behind exp and the functions that change JSON documents or search them by structure. Null arguments give null."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def add(name: str, kind: str, f):
        n = f.__code__.co_argcount
        each = lambda *columns: pd.Series([None if any(x is None or x is pd.NA for x in row) else f(*row) for row in zip(*columns)], dtype=object)
        shapes = {1: lambda a: each(a), 2: lambda a, b: each(a, b), 4: lambda a, b, c, d: each(a, b, c, d)}
        g = shapes[n]
        g.__annotations__ = dict.fromkeys([*g.__code__.co_varnames[:n], "return"], pd.Series)
        spark.udf.register(name, pandas_udf(g, kind))

    dump = scalar._dump
    spark.udf.register("weft_exp", scalar.exp)
    add("weft_json_strip_nulls", "string", lambda x: dump(scalar._without_nulls(json.loads(x))))
    add("weft_json_set", "string", lambda x, p, v, c: dump(_put(json.loads(x), _keys(p), _loads(v), bool(c))))
    add("weft_json_contains", "boolean", lambda a, b: scalar.contained(_loads(a), _loads(b)))
    add("weft_json_text", "string", lambda x, text: x if not text or not isinstance(_loads(x), str) else dump(x))
    add("weft_highlight", "string", lambda x, q: analysis.highlight(x, re.findall(r"\w+", q)))
