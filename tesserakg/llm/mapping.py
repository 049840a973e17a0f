"""Freely typed names mapped to a canonical list by a prefix-filter set-similarity join.

Names are first brought to one form: width, case, accents, look-alike letters of another script, transliteration, digits
typed for letters, quotes, possessives, articles and abbreviated kind words; the words are sorted. Words that
many listed names share (kinds: Bank, University ...) are recognised despite typing errors. Every distinct form is then a
set of its kind words and, of its other words, the letters and letter pairs (with occurrence numbers). Sets are ordered by global rarity; only their rare
prefixes are joined, under length and positional filters (prefixes long enough for COMMON shared tokens); candidates are verified by their exact Jaccard similarity and
the edits between the forms, and the best one is kept. Forms without a partner are reported as unmatched.

Equal forms meet by an equality join beforehand. Tokens that many prefixes share are salted, and the verdict on a form goes
back to its rows by a join split by weight, so one mention or token may hold any share of the rows.

Defined cases: null and blank names are left out; names without letters or digits match nothing; copies give one row; a name of
several entities gives the smallest id (as a string), as do ties; null ids and names in the list are left out; other columns
are ignored; an empty list leaves every mention unmatched, no mentions give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakg.runtime import cut, heavy_keys, map_arrow, skew_join

#: Least Jaccard similarity; cells of the hashed token counts; salts of a token that more than 1/1000 of the prefix rows have.
LEAST, CELLS, SALTS = 0.45, 1 << 18, 32
#: Tokens that the prefixes of a pair must share; the prefixes are as much longer, so no similar pair is lost.
COMMON = 5
#: A word is a kind if more than one in KIND listed names has it: at most KIND times the words of a name, whatever the size.
KIND = 200
#: Names of up to so many words are compared in every order of them; longer ones in the sorted order only.
WORDS = 5

# Cyrillic letters by sound and by look, Latin letters without a decomposition, digits typed for letters, short
# kind words and articles.
_SOUND = dict(zip("абвгдеёжзийклмнопрстуфхцчшщыэюяіїєјѕ", "a b v g d e e zh z i j k l m n o p r s t u f h c ch w w y e yu ya i i e j s".split())) | {"ь": "", "ъ": ""}
_LOOK = dict(zip("авекмнорстухіјѕ", "abekmhopctyxijs"))
_LATIN = {"ø": "o", "ł": "l", "æ": "ae", "ß": "ss", "đ": "d", "ð": "d", "þ": "th", "œ": "oe", "ı": "i"}
_DIGITS = str.maketrans("01", "oi")
_SHORT = {"univ": "university", "inst": "institute", "utd": "united", "st": "saint", "pt": "port", "corp": "corporation", "broadc": "broadcasting"}
_ARTICLES = ("the",)
_ONE_SOUND = str.maketrans("qx", "kk")


def _word(w: str) -> str:
    cyrillic, latin = sum(c in _SOUND for c in w), sum("a" <= c <= "z" for c in w)
    if cyrillic and latin >= cyrillic:
        w = "".join(_LOOK.get(c, c) for c in w)
    if cyrillic:
        w = "".join(_SOUND.get(c, c) for c in w)
    if any(c.isalpha() for c in w):
        w = w.translate(_DIGITS)
    return _SHORT.get(w, w)


def form(name: str) -> str:
    """The name's words in one spelling, sorted."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", name).casefold())
    s = "".join(_LATIN.get(c, c) for c in s if not unicodedata.combining(c))
    words = [_word(w) for w in re.findall(r"[^\W_]+", re.sub(r"['’`´]s(?![^\W_])", "", s))]
    if len(words) > 2 and all(len(w) == 1 for w in words):
        words = ["".join(words)]
    while len(words) > 1 and words[0] in _ARTICLES:
        words = words[1:]
    while len(words) > 1 and words[-1] in _ARTICLES:
        words = words[:-1]
    return " ".join(sorted(w.translate(_ONE_SOUND) for w in words))


def tokens(f: str, kinds: frozenset[str] = frozenset()) -> list[str]:
    """Kind words, letters and letter pairs of a form; the nth of several equal ones is a token of its own."""
    out, n = [], Counter()
    for w in f.split(" "):
        for t in [f"={w}"] if w in kinds else [*w, *map("".join, zip(f"#{w}", f"{w}#"))]:
            n[t] += 1
            out.append(f"{t}{n[t]}")
    return out


@lru_cache(200_000)
def _set(f: str, kinds: frozenset[str]) -> frozenset[str]:
    return frozenset(tokens(f, kinds))


def settled(f: str, kinds: frozenset[str]) -> str:
    """The form with its mistyped kind words in order."""
    out = []
    for w in f.split(" "):
        if w not in kinds and len(w) > 4:
            most = 1 if len(w) < 7 else 2
            near = [(d, k) for k in kinds if len(k) > 4 and abs(len(k) - len(w)) <= most and (d := edits(w, k, most)) <= most]
            w = min(near)[1] if near else w
        out.append(w)
    return " ".join(sorted(out))


def edits(a: str, b: str, most: int) -> int:
    """Edits (also of neighbours that changed places), or most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(a: str, b: str) -> int:
    """Edits that may lie between two forms, by the shorter one's letters."""
    n = min(len(a), len(b))
    return 0 if n < 5 else 1 if n < 8 else 2 if n < 14 else 3


def closeness(a: str, b: str, kinds: frozenset[str] = frozenset(), least: float = 0.0) -> tuple[float, int]:
    """Exact Jaccard similarity of the token sets, and the least edits in any order of the second one's words (at most
    WORDS of them), also where one of the two is written without blanks."""
    x, y = _set(a, kinds), _set(b, kinds)
    jaccard, most = len(x & y) / max(1, len(x | y)), allowed(a, b)
    if jaccard < least:
        return jaccard, most + 1
    d = edits(a, b, most)
    if d > most:
        one, many = (a, b.split(" ")) if " " in b else (b, a.split(" "))
        if 1 < len(many) <= WORDS:
            blank = " " if " " in one else ""
            d = min(edits(one, blank.join(p), most) for p in permutations(many))
    return jaccard, d


def _forms(columns: int, schema: list[str]):
    """The last column as its form; rows whose form is empty keep an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            out = []
            for name in batch.column(columns).to_pylist():
                if name not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[name] = form(name)
                out.append(known[name])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(columns)), pa.array(out, pa.string())], schema)

    return run


def _settled(kinds: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([settled(f, kinds) for f in batch.column(0).to_pylist()], pa.string())], ["form", "settled"])

    return run


def _cells(kinds: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[int] = Counter()
        for batch in batches:
            for f in batch.column(0).to_pylist():
                n.update(_cell(t) for t in tokens(f, kinds))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["cell", "n"])

    return run


def _cell(token: str) -> int:
    h = 0
    for c in token:
        h = (h * 1_000_003 + ord(c)) & 0xFFFFFFFF
    return h % CELLS


def _prefixes(shared, least: float):
    """(token, form, size, place) of the rare prefix that any partner of the similarity asked for must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kinds = shared.value
        for batch in batches:
            rows = []
            for f in batch.column(0).to_pylist():
                ordered = sorted(set(tokens(f, kinds)), key=lambda t: (counts[_cell(t)], t))
                n = len(ordered)
                keep = n - int(np.ceil(least * n - 1e-9)) + COMMON
                rows += [(t, f, n, i) for i, t in enumerate(ordered[:keep])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))], ["token", "form", "size", "place"])

    return run


def _verify(kinds: frozenset[str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                j, d = closeness(a, b, kinds, least)
                if j >= least and d <= allowed(a, b):
                    rows.append((a, b, j, d))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.int32()))], ["form", "name", "jaccard", "edits"])

    return run


def kind_words(listed: DataFrame) -> frozenset[str]:
    """Words that more than one in KIND forms has; a bounded number of them."""
    total = listed.count()
    words = listed.select(F.explode(F.array_distinct(F.split("form", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return frozenset(r["word"] for r in words.filter((F.col("n") * KIND > total) & (F.col("n") > 2)).collect())


def similar_forms(left: DataFrame, right: DataFrame, least: float = LEAST, kinds: frozenset[str] = frozenset()) -> DataFrame:
    """``form, name, jaccard, edits`` of the pairs of distinct forms that are similar enough; left and right have ``form``."""
    both = left.select("form").unionByName(right.select("form"))
    counts = np.zeros(CELLS, dtype=np.int64)
    got = map_arrow(both, _cells(kinds), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    shared = left.sparkSession.sparkContext.broadcast((counts, kinds))
    schema = "token string, form string, size int, place int"
    a = cut(map_arrow(left.select("form"), _prefixes(shared, least), schema))
    b = map_arrow(right.select("form"), _prefixes(shared, least), schema).toDF("token", "name", "name_size", "name_place")
    hot = F.broadcast(heavy_keys(a, "token").withColumn("hot", F.lit(True)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("form"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    a = a.join(hot, "token", "left").withColumn("salt", salt).drop("hot")
    b = b.join(hot, "token", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    # overlap that the similarity needs; what can still overlap from the place of this token on
    needed = F.ceil(F.lit(least / (1 + least)) * (F.col("size") + F.col("name_size")) - 1e-9)
    left_over = 1 + F.least(F.col("size") - F.col("place"), F.col("name_size") - F.col("name_place")) - 1 + F.least("place", "name_place")
    near = (F.col("size") >= least * F.col("name_size")) & (F.col("name_size") >= least * F.col("size")) & (left_over >= needed)
    met = a.join(b, ["token", "salt"]).filter(near).groupBy("form", "name").agg(F.count("*").alias("n"), F.first(F.ceil(F.lit(least) * F.least("size", "name_size") - 1e-9)).alias("least_overlap"))
    pairs = met.filter(F.col("n") >= F.least(F.lit(COMMON), "least_overlap")).select("form", "name")
    return map_arrow(pairs, _verify(kinds, least), "form string, name string, jaccard double, edits int")


def mapped(entries: DataFrame, names: DataFrame, least: float = LEAST) -> DataFrame:
    """``key, id``: the entity meant by each entry (``key, name``) from ``id, name``; ``NIL`` if none."""
    typed = entries.filter(F.col("name").isNotNull() & F.col("name").rlike(r"\S") & (F.trim(F.regexp_replace("name", r"[\p{Z}\s]", "")) != "")).select("key", "name").distinct()
    kind = entries.schema["key"].dataType.simpleString()
    typed = cut(map_arrow(typed, _forms(1, ["key", "form"]), f"key {kind}, form string"))
    listed = map_arrow(names.filter(F.col("id").isNotNull() & F.col("name").isNotNull()).select(F.col("id").cast("string").alias("id"), "name").distinct(), _forms(1, ["id", "form"]), "id string, form string")
    listed = cut(listed.filter("form != ''").groupBy("form").agg(F.min("id").alias("id")))
    kinds = kind_words(listed)
    tidy = "form string, settled string"
    listed = cut(map_arrow(listed.select("form"), _settled(kinds), tidy).join(listed, "form").groupBy(F.col("settled").alias("form")).agg(F.min("id").alias("id")))
    forms = cut(map_arrow(typed.select("form").distinct().filter("form != ''"), _settled(kinds), tidy))
    equal = forms.join(listed.withColumnRenamed("form", "settled"), "settled").select("form", "id")
    rest = cut(forms.join(listed.select(F.col("form").alias("settled")), "settled", "left_anti"))
    close = similar_forms(rest.select(F.col("settled").alias("form")).distinct(), listed, least, kinds).join(listed.withColumnRenamed("form", "name"), "name")
    found = close.withColumnRenamed("form", "settled").join(rest, "settled")
    best = found.groupBy("form").agg(F.min(F.struct("edits", (-F.col("jaccard")).alias("far"), "id")).alias("b")).select("form", F.col("b.id").alias("id"))
    verdict = cut(equal.select("form", "id").unionByName(best))
    return skew_join(typed, verdict, "form", "left").select("key", F.coalesce("id", F.lit("NIL")).alias("id")).distinct()
