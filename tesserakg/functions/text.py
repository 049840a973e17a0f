"""Functions on texts: similarities, escapes, occurrences, marks and formats. Nulls give null unless stated."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit per character of ``a``."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence by both lengths; 1 for two empty texts."""
    n = len(a) + len(b)
    return 2 * lcs(a, b) / n if n else 1.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one, shorter windows at the ends included."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return float(not long_)
    best = 0.0
    for start in range(1 - n, len(long_)):
        best = max(best, ratio(short, long_[max(0, start) : start + n]))
        if best == 1.0:
            break
    return best


def _pairs(f):  # noqa: ANN001, ANN202
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


def edit_similarity(a: Column, b: Column) -> Column:
    return _pairs(ratio)(a, b)


def partial_similarity(a: Column, b: Column) -> Column:
    return _pairs(partial)(a, b)


def url_decoded(c: Column) -> Column:
    """Percent escapes as text; a plus stays a plus; broken escapes leave the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def url_encoded(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def _unescape(s: pd.Series) -> pd.Series:
    four = re.compile(r"\\u([0-9A-Fa-f]{4})")
    return s.map(lambda x: None if x is None else four.sub(lambda m: chr(int(m.group(1), 16)), x).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def unicode_unescaped(c: Column) -> Column:
    r"""``\uXXXX`` as characters, surrogate pairs included."""
    return F.pandas_udf(_unescape, "string")(c)


def _occurrences(text: pd.Series, word: pd.Series) -> pd.Series:
    def find(t, w):  # noqa: ANN001, ANN202
        return None if t is None or w is None else [m.start() for m in re.finditer(re.escape(w), t, re.IGNORECASE)] if w else []

    return pd.Series([find(t, w) for t, w in zip(text, word)])


def occurrences(text: Column, word: Column) -> Column:
    """Places (from 0) of a word in a text, in any case, taken literally and without overlaps; none for an empty word."""
    return F.pandas_udf(_occurrences, "array<int>")(text, word)


def marked(text: Column, spans: Column, left: str = "[ENTITY_S]", right: str = "[ENTITY_E]") -> Column:
    """Text up to the end of each span, then the span's text again between marks, then the rest.

    ``spans`` is an array of (start, len) structs; they are put in order first; spans beyond the text give what is there.
    """
    piece = lambda a, n: F.substring(text, a + 1, F.greatest(n, F.lit(0)))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate(ordered, start, lambda acc, s: F.struct(
        F.concat(acc["out"], piece(acc["at"], s["start"] + s["len"] - acc["at"]), F.lit(left), piece(s["start"], s["len"]), F.lit(right)).alias("out"),
        F.greatest(acc["at"], s["start"] + s["len"]).alias("at"),
    ))
    return F.concat(folded["out"], piece(folded["at"], F.length(text)))


def entity_text(label: Column, description: Column, mark: str = " </s></s> ") -> Column:
    """Label and description; nulls as empty texts."""
    return F.concat(F.coalesce(label, F.lit("")), F.lit(mark), F.coalesce(description, F.lit("")))


def entity_spans(label: Column, aliases: Column, description: Column, claims: Column) -> Column:
    """Pieces of an entity's text with their places: kind 0 label and aliases, 1 description, 2 claims; one blank between."""
    empty = F.array().cast("array<struct<kind:int,piece:string>>")
    of = lambda kind, values: F.coalesce(F.transform(F.filter(values, lambda v: v != ""), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("piece"))), empty)
    pieces = F.concat(of(0, F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>")))), of(1, F.array(description)), of(2, claims))
    begin = F.struct(F.array().cast("array<struct<kind:int,start:int,stop:int>>").alias("spans"), F.lit(0).alias("at"))
    return F.aggregate(pieces, begin, lambda acc, p: F.struct(
        F.concat(acc["spans"], F.array(F.struct(p["kind"].alias("kind"), acc["at"].alias("start"), (acc["at"] + F.length(p["piece"])).alias("stop")))).alias("spans"),
        (acc["at"] + F.length(p["piece"]) + 1).alias("at"),
    ), lambda acc: acc["spans"])


def masked(tokens: Column, start: Column, stop: Column, mask: str = "<mask>", collapse: bool = False) -> Column:
    """Tokens with those from start to stop (exclusive) masked, each or all as one."""
    each = F.transform(tokens, lambda t, i: F.when((i >= start) & (i < stop), F.lit(mask)).otherwise(t))
    if not collapse:
        return each
    one = F.concat(F.slice(tokens, F.lit(1), start), F.array(F.lit(mask)), F.slice(tokens, stop + 1, F.size(tokens)))
    return F.when(stop > start, one).otherwise(tokens)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(share: Column) -> Column:
    return F.format_string("%.1f", 100 * share)


def page_url(day: Column) -> Column:
    """Address of the day's page of current events."""
    return F.concat(F.lit("https://en.wikipedia.org/wiki/Portal:Current_events/"), F.date_format(day, "yyyy_MMMM_d"))


def xml_dict(page: str) -> dict:
    """An XML text as nested dictionaries: attributes under ``@name``, text under ``#text``, repeated children as lists."""
    from xml.etree import ElementTree

    def of(node):  # noqa: ANN001, ANN202
        out: dict = {f"@{k}": v for k, v in node.attrib.items()}
        for child in node:
            value = of(child)
            if child.tag in out:
                out[child.tag] = [*out[child.tag], value] if isinstance(out[child.tag], list) else [out[child.tag], value]
            else:
                out[child.tag] = value
        text = (node.text or "").strip()
        if not out:
            return text or None
        return out | ({"#text": text} if text else {})

    root = ElementTree.fromstring(page)
    return {root.tag: of(root)}


def xml_json(c: Column) -> Column:
    """XML texts as JSON; null for broken ones."""
    import json

    def run(s: pd.Series) -> pd.Series:
        from xml.etree.ElementTree import ParseError

        out = []
        for x in s:
            try:
                out.append(None if x is None else json.dumps(xml_dict(x), ensure_ascii=False))
            except ParseError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(c)
