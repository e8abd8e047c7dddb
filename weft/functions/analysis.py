"""Text analysis: character filters, tokenizers and token filters, chained into named analyzers.

An analyzer is a list of stages. Chains of stages that Spark has itself become column expressions; others run as one Arrow UDF.
analyze() gives the same tokens for a query on the driver.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOP = {"en": frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())}


def _cons(w: str, i: int) -> bool:
    if w[i] != "y":
        return w[i] not in "aeiou"
    j = i
    while j and w[j - 1] == "y":
        j -= 1
    return (j == 0 or w[j - 1] in "aeiou") == ((i - j) % 2 == 0)


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    n, last = 0, None
    for c in w:
        now = c not in "aeiou" and not (c == "y" and last)
        n += now and last is False
        last = now
    return n


def porter(w: str) -> str:
    """The stemmer of Porter's paper of 1980."""
    if len(w) < 3:
        return w
    vowel = lambda s: any(not _cons(s, i) for i in range(len(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and _cons(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and _cons(s, len(s) - 3) and not _cons(s, len(s) - 2) and _cons(s, len(s) - 1) and s[-1] not in "wxy"
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (
        "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble",
        "icate ic ative - alize al iciti ic ical ic ful - ness -",
    ):
        parts = rules.split()
        for end, new in zip(parts[::2], parts[1::2]):
            if w.endswith(end):
                if _measure(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + new.strip("-")
                break
    for end in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split():
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if _measure(w) > 1 and double(w) and w[-1] == "l":
        w = w[:-1]
    return w


def fold(w: str) -> str:
    """Letters without their marks; a character that has no ASCII form stays."""
    if w.isascii():
        return w
    return "".join("".join(d for d in unicodedata.normalize("NFKD", c) if ord(d) < 128) or c for c in w)


def ngrams(w: str, low: int, high: int) -> list[str]:
    return [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]


CHAR: dict[str, Callable] = {
    "html_strip": lambda o: lambda s: html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", s))),
    "mapping": lambda o: lambda s: re.sub("|".join(map(re.escape, sorted(o["map"], key=len, reverse=True))), lambda m: o["map"][m[0]], s) if o["map"] else s,
    "pattern_replace": lambda o: lambda s: re.sub(o["pattern"], o.get("replacement", ""), s),
}
TOKENIZER: dict[str, Callable] = {
    "whitespace": lambda o: str.split,
    "standard": lambda o: re.compile(r"\w+").findall,
    "letter": lambda o: re.compile(r"[a-zA-Z]+").findall,
    "ngram": lambda o: lambda s: [g for w in s.split() for g in ngrams(w, o.get("min", 1), o.get("max", 2))],
    "pattern": lambda o: lambda s: [t for t in re.split(o["pattern"], s) if t],
    "keyword": lambda o: lambda s: [s] if s else [],
}
FILTER: dict[str, Callable] = {
    "lowercase": lambda o: lambda ts: [t.lower() for t in ts],
    "stop": lambda o: lambda ts, words=STOP.get(o.get("language", "en"), frozenset()) | frozenset(o.get("words", ())): [t for t in ts if t not in words],
    "porter": lambda o: lambda ts: [porter(t) for t in ts],
    "ascii_fold": lambda o: lambda ts: [fold(t) for t in ts],
    "synonym": lambda o: lambda ts: [x for t in ts for x in (t, *o["map"].get(t, ()))],
    "ngram": lambda o: lambda ts: [g for t in ts for g in (ngrams(t, o.get("min", 2), o.get("max", 3)) or ([t] if o.get("keep_short") else []))],
    "edge_ngram": lambda o: lambda ts: [t[:n] for t in ts for n in range(o.get("min", 1), min(o.get("max", 10), len(t)) + 1)],
    "length": lambda o: lambda ts: [t for t in ts if o.get("min", 0) <= len(t) <= o.get("max", 1 << 30)],
}
PRESETS = {
    "whitespace": {"tokenizer": "whitespace", "filters": ["lowercase"]},
    "standard": {"tokenizer": "standard", "filters": ["lowercase", "ascii_fold", "stop", "porter"]},
    "standard_cjk": {"tokenizer": "standard", "filters": ["lowercase", "ascii_fold", "stop", "porter", {"type": "ngram", "min": 2, "max": 3, "keep_short": True}]},
    "keyword": {"tokenizer": "keyword", "filters": []},
    "plain": {"tokenizer": "plain", "filters": []},
}
_own: dict[str, dict] = {}


def _stage(kinds: dict[str, Callable], spec: str | dict) -> Callable:
    o = {"type": spec} if isinstance(spec, str) else spec
    if o["type"] not in kinds:
        raise ValueError(f"no such stage: {o['type']}")
    return kinds[o["type"]](o)


def create(name: str, config: dict | str) -> None:
    """Register an analyzer: {"char_filters": [...], "tokenizer": ..., "filters": [...]}, also as JSON."""
    if name in PRESETS:
        raise ValueError(f"{name} is built in")
    config = json.loads(config) if isinstance(config, str) else config
    build(config)
    _own[name] = config


def drop(name: str) -> None:
    if name in PRESETS:
        raise ValueError(f"{name} is built in")
    del _own[name]


def names() -> list[str]:
    return sorted({*PRESETS, *_own})


def config(name: str) -> dict:
    if name in PRESETS:
        return PRESETS[name]
    if name not in _own:
        raise KeyError(f"no such analyzer: {name}")
    return _own[name]


#: Lower-case runs of ASCII letters, digits and underscores: an analyzer that Spark and SQL engines have alike.
PLAIN = re.compile("[a-z0-9_]+")


#: Analyzers built so far, by their configuration: a worker keeps what it knows of words from batch to batch.
_built: dict[str, Callable] = {}


class Filtered(dict):
    """What the filters make of a token. Every filter treats each token by itself, so that a word is filtered once and then looked up.
    Words of up to LONG characters are kept, MOST of them and those of MOST before that, of which the used ones stay."""

    MOST, LONG = 1 << 18, 32

    def __init__(self, filters: list[Callable]):
        super().__init__()
        self.filters, self.old = filters, {}

    def __missing__(self, token: str) -> tuple[str, ...]:
        out = self.old.get(token)
        if out is None:
            out = [token]
            for f in self.filters:
                out = f(out)
            out = tuple(out)
        if len(token) <= self.LONG:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[token] = out
        return out


def build(config: dict) -> Callable[[str], list[str]]:
    if config["tokenizer"] == "plain":
        return lambda s: PLAIN.findall(s.lower())
    key = json.dumps(config, sort_keys=True)
    if key in _built:
        return _built[key]
    chars = [_stage(CHAR, c) for c in config.get("char_filters", ())]
    tokenizer = _stage(TOKENIZER, config["tokenizer"])
    filtered = Filtered([_stage(FILTER, f) for f in config.get("filters", ())]).__getitem__

    def run(s: str) -> list[str]:
        for c in chars:
            s = c(s)
        return list(chain.from_iterable(map(filtered, tokenizer(s))))

    if len(_built) >= 64:
        _built.clear()
    _built[key] = run
    return run


def analyze(text: str | None, analyzer: str = "standard") -> list[str]:
    return build(config(analyzer))(text) if text else []


def column(analyzer: str = "standard") -> Callable[[Column], Column]:
    """Tokens of a text column: inside Spark where it has all stages, else by one Arrow UDF; null for null."""
    own = config(analyzer)
    if own["tokenizer"] == "plain":
        return lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1)
    if own["tokenizer"] == "whitespace" and own.get("filters", []) in ([], ["lowercase"]) and not own.get("char_filters"):
        lower = F.lower if own.get("filters") else lambda c: c
        return lambda c: F.filter(F.split(lower(c), r"\s+"), lambda t: t != "")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def tokens(s: pa.Array) -> pa.Array:
        run = build(own)
        return pa.array((None if x is None else run(x) for x in s.to_pylist()), pa.list_(pa.string()))

    return tokens


def highlight(text: str | None, terms: list[str], analyzer: str = "standard", before: str = "<b>", after: str = "</b>", size: int = 0, most: int = 0) -> str | None:
    """text with every word wrapped whose analysis is one of `terms`; with `size` only its `most` best fragments of about that
    many characters, cut at spaces and joined by ellipses."""
    if text is None:
        return None
    run, want = build(config(analyzer)), set(terms)
    spans = [m.span() for m in re.finditer(r"\w+", text) if want & set(run(m[0]))]
    wrap = lambda s, a, own: "".join([*(s[x - a : y - a] if not hit else before + s[x - a : y - a] + after for x, y, hit in own)])

    def marked(a: int, b: int) -> str:
        own, at = [], a
        for x, y in spans:
            if a <= x and y <= b:
                own += [(at, x, False), (x, y, True)]
                at = y
        return wrap(text[a:b], a, [*own, (at, b, False)])

    if not size or len(text) <= size:
        return marked(0, len(text))
    clusters: list[list[tuple[int, int]]] = []
    for s in spans:
        if clusters and s[0] - clusters[-1][-1][1] <= size / 2 and s[1] - clusters[-1][0][0] <= size:
            clusters[-1].append(s)
        else:
            clusters.append([s])
    best = sorted(sorted(clusters, key=len, reverse=True)[: most or 1]) or [[(0, 0)]]
    out = []
    for c in best:
        room = max(0, size - (c[-1][1] - c[0][0])) // 2
        a, b = max(0, c[0][0] - room), min(len(text), c[-1][1] + room)
        a = text.rfind(" ", 0, a) + 1 if a else 0
        b = len(text) if b == len(text) else (text.find(" ", b) if text.find(" ", b) >= 0 else len(text))
        out.append(("..." if a else "") + marked(a, b) + ("..." if b < len(text) else ""))
    return " ".join(out)


def highlighted(c: Column, terms: list[str], analyzer: str = "standard", **options) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: highlight(x, terms, analyzer, **options))

    return run(c)
