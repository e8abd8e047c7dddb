"""A small tokenizer over PostgreSQL-flavoured SQL and the rewriting of what Spark SQL spells in another way."""

from __future__ import annotations

import re
from contextvars import ContextVar
from dataclasses import dataclass

from weft.functions import postgres

TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*'|\$\$.*?\$\$)|(?P<quoted>\"(?:[^\"]|\"\")*\")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<param>\$\d+)|(?P<word>[^\W\d]\w*)|(?P<op>::|\?\||\?&|->>|->|#>>|#>|@>|<@|@@|<=|>=|<>|!=|\|\||:=|=>|.)", re.S)
TYPES = {"text": "STRING", "varchar": "STRING", "character": "STRING", "char": "STRING", "integer": "INT", "int": "INT", "int4": "INT", "int2": "SMALLINT", "smallint": "SMALLINT", "int8": "BIGINT", "bigint": "BIGINT", "serial": "INT", "bigserial": "BIGINT", "real": "DOUBLE", "float": "DOUBLE", "float4": "DOUBLE", "float8": "DOUBLE", "double": "DOUBLE", "numeric": "DECIMAL(38,10)", "decimal": "DECIMAL(38,10)", "boolean": "BOOLEAN", "bool": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamptz": "TIMESTAMP", "time": "STRING", "interval": "STRING", "json": "STRING", "jsonb": "STRING", "uuid": "STRING", "bytea": "BINARY", "vector": "ARRAY<DOUBLE>", "point": "ARRAY<DOUBLE>"}
#: Functions that only change their name.
NAMES = {"bool_or": "bool_or", "localtimestamp": "localtimestamp"}


@dataclass
class Token:
    kind: str
    text: str

    @property
    def low(self) -> str:
        return self.text.lower()


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m[0]) for m in TOKEN.finditer(sql)]


def text_of(ts: list[Token]) -> str:
    return "".join(t.text for t in ts)


def significant_from(ts: list[Token]) -> list[Token]:
    """What follows WHERE."""
    at = next(k for k, t in enumerate(ts) if t.low == "where")
    return ts[at + 1 :]


def significant(ts: list[Token]) -> list[Token]:
    return [t for t in ts if t.kind != "space"]


def closing(ts: list[Token], at: int) -> int:
    """The place of the parenthesis or bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(ts)):
        if ts[i].text in "([":
            depth += 1
        elif ts[i].text in ")]":
            depth -= 1
            if not depth:
                return i
    raise ValueError("a parenthesis is open")


def split(ts: list[Token], by: str = ",") -> list[list[Token]]:
    """The parts between separators outside parentheses."""
    out, depth = [[]], 0
    for t in ts:
        depth += (t.text in "([") - (t.text in ")]") if t.kind == "op" else 0
        if not depth and t.low == by:
            out.append([])
        else:
            out[-1].append(t)
    return out


def statements(sql: str) -> list[str]:
    return [s for p in split(tokens(sql), ";") if (s := text_of(p).strip())]


def literal(t: str):
    """The value of a constant: a string, number, boolean, null, or ARRAY[...] and POINT(...) of numbers."""
    s = t.strip()
    if s.startswith("$$"):
        return s[2:-2]
    if s.startswith("'"):
        return s[1:-1].replace("''", "'")
    low = s.lower()
    if low in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[low]
    m = re.match(r"(?is)^(?:array\s*\[|point\s*\(|\[)(.*)[\])]$", s)
    if m:
        return [float(x) for x in m[1].split(",") if x.strip()]
    return int(s) if re.fullmatch(r"[+-]?\d+", s) else float(s)


def type_of(words: list[Token]) -> str:
    """Spark's name of a column type."""
    ws = significant(words)
    name = ws[0].low
    if name in ("numeric", "decimal") and len(ws) > 3 and ws[1].text == "(":
        return "DECIMAL" + text_of(ws[1 : closing(ws, 1) + 1])
    base = TYPES.get(name, ws[0].text.upper())
    return f"ARRAY<{base}>" if any(t.text == "[" for t in ws) else base


def _operand(out: list[Token]) -> int:
    """Where the operand that ends a list of tokens begins."""
    i = len(out) - 1
    while i >= 0 and out[i].kind == "space":
        i -= 1
    while i >= 0:
        if out[i].text in ")]":
            depth = 0
            while i >= 0:
                depth += (out[i].text in ")]") - (out[i].text in "([")
                if not depth:
                    break
                i -= 1
            if i > 0 and out[i - 1].kind in ("word", "quoted") and out[i].text in "([":
                i -= 1
        if out[i].low == "end":
            depth = 0
            while i >= 0:
                depth += (out[i].low == "end") - (out[i].low == "case")
                if not depth:
                    break
                i -= 1
        if i > 1 and out[i - 1].text == "." and out[i - 2].kind in ("word", "quoted"):
            i -= 2
            continue
        break
    return max(i, 0)


def _before(ts: list[Token], i: int) -> int:
    """The place of the last token before i that isn't space, or -1."""
    i -= 1
    while i >= 0 and ts[i].kind == "space":
        i -= 1
    return i


def _product(out: list[Token]) -> int:
    """Where the product that ends a list of tokens begins, with its sign."""
    a = _operand(out)
    while (b := _before(out, a)) >= 0:
        if out[b].text == "*" and _before(out, b) >= 0 and (out[_before(out, b)].kind != "op" or out[_before(out, b)].text in ")]"):
            a = _operand(out[:b])
        elif out[b].text == "-" and ((c := _before(out, b)) < 0 or out[c].text in ("(", ",", "=", "<", ">", "<=", ">=", "<>", "+", "*") or out[c].low in ("select", "where", "and", "or", "then", "else", "when", "by", "on", "between")):
            a = b
        else:
            break
    return a


def _factor(ts: list[Token], at: int) -> int:
    """Where the operand that begins at `at` ends: one past it, casts and subscripts included."""
    i = at
    while ts[i].kind == "space" or ts[i].text in "+-":
        i += 1
    if ts[i].text == "(":
        i = closing(ts, i) + 1
    elif ts[i].low == "case":
        depth = 0
        while True:
            depth += (ts[i].low == "case") - (ts[i].low == "end")
            i += 1
            if not depth:
                break
    else:
        i += 1
        while i + 1 < len(ts) and ts[i].text == "." and ts[i + 1].kind in ("word", "quoted"):
            i += 2
        k = next((k for k in range(i, len(ts)) if ts[k].kind != "space"), len(ts))
        if k < len(ts) and ts[k].text == "(" and ts[i - 1].kind == "word":
            i = closing(ts, k) + 1
    while i < len(ts) and (ts[i].text == "[" or ts[i].text == "::"):
        if ts[i].text == "[":
            i = closing(ts, i) + 1
        else:
            i += 2 + (ts[i + 1].kind == "space")
            if i < len(ts) and ts[i].text == "(":
                i = closing(ts, i) + 1
    return i


#: Columns of the tables at hand that hold integers, wherever their names occur.
integers: ContextVar[frozenset[str]] = ContextVar("integers", default=frozenset())
#: Words of expressions that stay integers.
WHOLE = {"cast", "floor", "try_divide", "try_mod", "as", "bigint", "int", "smallint", "length", "count", "abs", "size", "year", "month", "day", "instr", "ascii", "octet_length"}


def _whole(expression: str) -> bool:
    """Whether an expression is plainly one of integers."""
    known = integers.get() | WHOLE
    return all(t.kind == "space" or t.kind == "number" and t.text.isdigit() or t.text in "+-*()," or t.low.strip('`"') in known for t in tokens(re.sub(r"\b[^\W\d]\w*\.(?=[^\W\d])", "", expression)))


def _quantified(left: str, op: str, which: str, query: str) -> str:
    """A comparison with ALL or ANY of a subquery's values."""
    if which in ("any", "some") and op == "=":
        return f"{left} IN ({query})"
    if which == "all" and op in ("<>", "!="):
        # NOT IN would broadcast the values from the driver, to tell nulls; these are told apart, and equal ones are a join
        values = f"(SELECT _v FROM ({query}) AS _q(_v) GROUP BY _v) AS _d"
        has = lambda what: f"EXISTS (SELECT 1 FROM {values} WHERE {what})"
        return f"(CASE WHEN {has(f'_v = ({left})')} THEN false WHEN {has('_v IS NULL')} OR ({left}) IS NULL AND {has('true')} THEN NULL ELSE true END)"
    least = (op[0] == "<") == (which == "all")
    one = lambda f: f"{left} {op} (SELECT {f}(_v) FROM ({query}) AS _q(_v))"
    if op in ("=", "<>", "!="):
        one_of = f"({one('min')} {'AND' if op == '=' else 'OR'} {one('max')})"
    else:
        one_of = one("min" if least else "max")
    return f"({one_of} OR NOT EXISTS ({query}))" if which == "all" else one_of


def rewrite(sql: str) -> str:
    """Casts, array constructors, JSON operators, aggregate order, quoted names, function names, and PostgreSQL's place of
    nulls in ORDER BY."""
    ts, out, i = tokens(sql), [], 0
    while i < len(ts):
        t = ts[i]
        nxt = next((k for k in range(i + 1, len(ts)) if ts[k].kind != "space"), None)
        if t.text == "::":
            j = nxt
            end = j + 1
            if end < len(ts) and ts[end].text == "(":
                end = closing(ts, end) + 1
            if end + 1 < len(ts) and ts[end].text == "[" and ts[end + 1].text == "]":
                end += 2
            if ts[j].low == "double" and end + 1 < len(ts) and ts[end + 1].low == "precision":
                end += 2
            a = _operand(out)
            inner = text_of(out[a:]).rstrip()
            out[a:] = [Token("word", f"CAST({inner} AS {type_of(ts[j:end])})")]
            i = end
            continue
        if t.text in ("/", "%") and out and nxt is not None:
            a = _product(out)
            end = _factor(ts, nxt)
            x, y = text_of(out[a:]).strip(), rewrite(text_of(ts[nxt:end])).strip()
            made = f"try_mod({x}, {y})"
            if t.text == "/":
                made = f"CAST(floor(try_divide({x}, {y})) AS BIGINT)" if _whole(x) and _whole(y) else postgres.quotient(x, y)
            out[a:] = [Token("word", made)]
            i = end
            continue
        if t.text in ("@>", "<@", "?", "?|", "?&") and out and nxt is not None:
            a = _operand(out)
            end = _factor(ts, nxt)
            x, y = text_of(out[a:]).strip(), rewrite(text_of(ts[nxt:end])).strip()
            has = f"(coalesce(array_contains(json_object_keys({x}), _K_), array_contains(from_json({x}, 'array<string>'), _K_), false))"
            if t.text == "?":
                made = has.replace("_K_", y)
            elif t.text in ("?|", "?&"):
                made = f"{'exists' if t.text == '?|' else 'forall'}({y}, _k -> {has.replace('_K_', '_k')})"
            else:
                made = f"weft_json_contains({x}, {y})" if t.text == "@>" else f"weft_json_contains({y}, {x})"
            out[a:] = [Token("word", made)]
            i = end
            continue
        if t.text in ("=", "<>", "!=", "<", ">", "<=", ">=") and out and nxt is not None and ts[nxt].low in ("all", "any", "some"):
            o = next((k for k in range(nxt + 1, len(ts)) if ts[k].kind != "space"), None)
            if o is not None and ts[o].text == "(" and significant(ts[o + 1 : o + 3])[:1] and significant(ts[o + 1 : o + 4])[0].low == "select":
                end = closing(ts, o)
                a = _operand(out)
                out[a:] = [Token("word", _quantified(text_of(out[a:]).strip(), t.text, ts[nxt].low, rewrite(text_of(ts[o + 1 : end]))))]
                i = end + 1
                continue
        if t.low == "fetch" and nxt is not None and ts[nxt].low in ("first", "next"):
            rest = [k for k in range(nxt + 1, len(ts)) if ts[k].kind != "space"][:3]
            n = "1" if ts[rest[0]].low in ("row", "rows") else ts[rest[0]].text
            out.append(Token("word", f"LIMIT {n}"))
            i = rest[1 if n == "1" and ts[rest[0]].low in ("row", "rows") else 2] + 1
            continue
        if t.text in ("->", "->>", "#>", "#>>") and out:
            a = _operand(out)
            left, right = text_of(out[a:]).rstrip(), ts[nxt]
            if t.text in ("->", "->>") and right.kind in ("string", "number"):
                key = f"[\\'{literal(right.text)}\\']" if right.kind == "string" else f"[{right.text}]"
                out[a:] = [Token("word", f"get_json_object({left}, '${key}')")]
                i = nxt + 1
                continue
            if t.text in ("#>", "#>>") and right.kind == "string":
                path = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in literal(right.text).strip("{}").split(","))
                out[a:] = [Token("word", f"get_json_object({left}, '${path}')")]
                i = nxt + 1
                continue
        if t.low == "array" and nxt is not None and ts[nxt].text == "[":
            end = closing(ts, nxt)
            out.append(Token("word", f"array({rewrite(text_of(ts[nxt + 1 : end]))})"))
            i = end + 1
            continue
        if t.kind == "quoted":
            out.append(Token("quoted", "`" + t.text[1:-1].replace('""', '"') + "`"))
            i += 1
            continue
        if t.kind == "word" and nxt is not None and ts[nxt].text == "(":
            end = closing(ts, nxt)
            inner = ts[nxt + 1 : end]
            parts = split(inner)
            if t.low in ("string_agg", "array_agg", "json_agg"):
                last = significant(parts[-1])
                at = next((k for k, x in enumerate(last) if x.low == "order"), None)
                if t.low == "string_agg":
                    order = f" WITHIN GROUP ({rewrite(' '.join(x.text for x in last[at:]))})" if at is not None else ""
                    sep = "".join(x.text for x in (last[:at] if at is not None else last))
                    out.append(Token("word", f"listagg({rewrite(text_of(parts[0]))}, {sep}){order}"))
                    i = end + 1
                    continue
                if at is not None:
                    key = rewrite(" ".join(x.text for x in last[at + 2 :]))
                    value = rewrite(" ".join(x.text for x in last[:at]))
                    down = key.upper().split()[-1] == "DESC"
                    key = re.sub(r"(?i)\s+(asc|desc)(\s+nulls\s+\w+)?$", "", key)
                    out.append(Token("word", f"transform(sort_array(collect_list(struct({key} AS k, {value} AS v)), {str(not down).lower()}), x -> x.v)"))
                    i = end + 1
                    continue
            after = [k for k in range(end + 1, len(ts)) if ts[k].kind != "space"][:2]
            if len(after) == 2 and ts[after[0]].low == "filter" and ts[after[1]].text == "(":
                # Spark has FILTER for aggregates but not for windows
                e = closing(ts, after[1])
                over = next((k for k in range(e + 1, len(ts)) if ts[k].kind != "space"), None)
                if over is not None and ts[over].low == "over":
                    condition = rewrite(text_of(significant_from(ts[after[1] + 1 : e])))
                    value = "1" if text_of(inner).strip() == "*" else rewrite(text_of(parts[0]))
                    rest = "".join(f", {rewrite(text_of(p)).strip()}" for p in parts[1:])
                    out.append(Token("word", f"{t.text}(CASE WHEN {condition} THEN {value} END{rest})"))
                    i = e + 1
                    continue
            if t.low in postgres.CALLS and not any(x.low == "distinct" for x in significant(inner)[:1]):
                args = [rewrite(text_of(p)).strip() for p in parts] if significant(inner) else []
                try:
                    out.append(Token("word", postgres.CALLS[t.low](*args)))
                except TypeError as e:
                    raise ValueError(f"{t.text}: {len(args)} arguments") from e
                i = end + 1
                continue
            if t.low in NAMES:
                out.append(Token("word", NAMES[t.low]))
                i += 1
                continue
        out.append(t)
        i += 1
    return nulls_last(text_of(out))


def nulls_last(sql: str) -> str:
    """ASC puts nulls last and DESC first unless the query says otherwise."""
    ts, out, i = tokens(sql), [], 0
    stop = {"limit", "offset", "rows", "range", "fetch", "union", "intersect", "except", "window", "groups"}
    while i < len(ts):
        out.append(ts[i])
        if ts[i].low == "order" and (k := next((k for k in range(i + 1, len(ts)) if ts[k].kind != "space"), None)) and ts[k].low == "by":
            j, depth = k + 1, 0
            while j < len(ts) and not (depth == 0 and (ts[j].text == ")" or ts[j].low in stop or ts[j].text == ";")):
                depth += (ts[j].text in "([") - (ts[j].text in ")]") if ts[j].kind == "op" else 0
                j += 1
            parts = []
            for p in split(ts[k + 1 : j]):
                s = nulls_last(text_of(p)).strip()
                if not re.search(r"(?i)\bnulls\s+(first|last)$", s):
                    s += " NULLS FIRST" if re.search(r"(?i)\bdesc$", s) else " NULLS LAST"
                parts.append(s)
            out += ts[i + 1 : k + 1] + [Token("word", " " + ", ".join(parts) + " ")]
            i = j
            continue
        i += 1
    return text_of(out)
