"""Text that was decoded with a wrong character encoding: found and repaired by expectation-maximization.

Every record has a latent encoding chain: none (clean), UTF-8 read as a single-byte charset (once or twice), one
single-byte charset read as another, or characters already lost (U+FFFD). A place of the text that a chain explains is a
site. Its evidence is the likelihood of the restored against the present characters, under character pairs of the clean
corpus. Within a record each site is garbled or not by itself, so that records may be garbled in part.

- Statistics: one scan counts characters and character pairs of all texts (hashed into a fixed number of cells) outside of
  what a multi-byte chain could explain, and the records per pool of sources.
- Candidates: a second scan keeps, per record, the chains that one of its sites at least speaks for, with all their sites. Only this
  small table is read by the rounds.
- Rounds: E gives each record its posterior over the chains, from the sites and the prior of its source and field; M adds
  up the posteriors per source pool (shrunk to the whole corpus, so weak evidence is pooled) and adds the restored characters
  to the clean statistics. Only sums over a fixed number of cells, pools and chains reach the driver.
- A record is garbled if its clean posterior is below one half; its sites are then restored by their own posteriors.

Defined cases: null, empty and pure ASCII texts are clean; null ids are left out; a null source is a source of its own;
sources are hashed into POOLS pools, so that the priors stay bounded; lost characters are reported, and such records are not
restored; repeated rows give one row; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserakg.runtime import cut, drop, map_arrow

#: Charsets as which UTF-8 is read, and (true, read as) pairs of single-byte charsets.
MULTI = ("cp1252", "cp1250", "iso8859-2", "cp1251", "mac_roman", "cp437", "cp866", "koi8-r", "cp850", "cp1253", "cp1254", "iso8859-15")
SINGLE = tuple((u, w) for u in ("cp1251", "koi8-r", "cp866", "cp1250", "cp1252", "mac_roman", "cp437") for w in ("cp1252", "cp1251", "koi8-r", "cp866", "cp1250", "mac_roman", "cp437") if u != w)
CHAINS = ("clean", "lost", *(f"utf-8>{w}" for w in MULTI), *(f"{u}>{w}" for u, w in SINGLE), *(f"utf-8>{w} twice" for w in MULTI))
_TWICE = 2 + len(MULTI) + len(SINGLE)
CELLS, POOLS, ROUNDS = 1 << 18, 1 << 16, 4
#: Records of the whole corpus that a pool's own count is shrunk to; pseudo count of a character; weight of character pairs.
SHRINK, CHAR, PAIR = 20.0, 0.05, 0.95
#: Unseen letters of two scripts side by side are so much less probable.
MIXED = 0.01
#: Runs of characters that a task remembers; bounds memory, changes no result.
REMEMBERED = 200_000
#: Log evidence below which no prior could make a chain win, and that of a lost character.
LEAST, LOST = -12.0, 20.0

_RUNS = re.compile(r"(?s)(.?)([^\x00-\x7f]+)(?=(.?))")


def _high(charset: str) -> dict[int, str]:
    """Characters of the bytes from 0x80; bytes without one stand for themselves, as lenient decoders have it."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(charset)
        except UnicodeDecodeError:
            out[b] = chr(b)
    if charset in ("cp1252", "iso8859-15"):  # latin-1 read text has the control characters
        taken = set(out.values())
        out |= {-b: chr(b) for b in range(0x80, 0xA0) if chr(b) not in taken}
    return out


@lru_cache(None)
def _multi(charset: str):
    """Pattern of UTF-8 sequences in characters of the charset, and bytes of the characters."""
    chars: dict[int, list[str]] = defaultdict(list)
    for b, c in _high(charset).items():
        chars[abs(b)].append(c)
    of = lambda lo, hi: "[" + "".join(re.escape(c) for b in range(lo, hi + 1) for c in chars[b]) + "]"
    tail = of(0x80, 0xBF)
    pattern = f"(?:{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{tail}|{of(0xF0, 0xF4)}{tail}{tail}{tail})+"
    return re.compile(pattern), {c: bytes([b]) for b, cs in chars.items() for c in cs}


@lru_cache(None)
def _single(true: str, read: str):
    """Pattern of runs that may be the true charset read as the other one, and the translation."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            u, w = bytes([b]).decode(true), bytes([b]).decode(read)
        except UnicodeDecodeError:
            continue
        if u != w and u.isprintable():
            table[ord(w)] = u
    return re.compile("[" + "".join(re.escape(chr(c)) for c in table) + "]+"), table


def _unfold(s: str, charset: str) -> str | None:
    """All sequences of the string as UTF-8; None if there is none or it isn't valid."""
    pattern, code = _multi(charset)
    try:
        out, n = pattern.subn(lambda m: b"".join(code[c] for c in m.group()).decode("utf-8"), s)
    except UnicodeDecodeError:
        return None
    return out if n else None


def sites(run: str) -> list[tuple[int, int, int, str]]:
    """(chain, start, end, restored) of all places of a run of non-ASCII characters that a chain explains."""
    out = [(1, m.start(), m.end(), "") for m in re.finditer("�+", run)]
    for k, w in enumerate(MULTI):
        for m in _multi(w)[0].finditer(run):
            if (u := _unfold(m.group(), w)) is not None:
                out.append((2 + k, m.start(), m.end(), u))
                if (twice := _unfold(u, w)) is not None:
                    out.append((_TWICE + k, m.start(), m.end(), twice))
    for k, (u, w) in enumerate(SINGLE):
        pattern, table = _single(u, w)
        # a lone sign or blank tells nothing about single-byte charsets
        out += [(2 + len(MULTI) + k, m.start(), m.end(), m.group().translate(table)) for m in pattern.finditer(run) if any(map(str.isalpha, m.group()))]
    return out


@lru_cache(1 << 16)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def cell(a: str, b: str) -> int:
    return (ord(a) * 1_000_003 ^ ord(b) * 8_191) & (CELLS - 1)


def _fold(s: str) -> str:
    low = s.lower()
    return low if len(low) == len(s) else s


class Language:
    """Character pairs of clean text: log likelihoods with back-off to single characters."""

    def __init__(self, chars: dict[str, float], pairs: dict[int, float], seen: frozenset[str] = frozenset()):
        self.chars, self.pairs, self.total = chars, pairs, sum(chars.values()) + CHAR * (1 << 16)
        self.seen = seen

    def score(self, left: str, s: str, right: str) -> float:
        t, out = _fold(left + s + right), 0.0
        for a, b in zip(t if left else " " + t, t[1:] if left else t):
            single, before = (self.chars.get(b, 0.0) + CHAR) / self.total, self.chars.get(a, 0.0)
            if single and a.isalpha() and b.isalpha() and _script(a) != _script(b):
                single *= MIXED
            out += math.log(PAIR * min(1.0, self.pairs.get(cell(a, b), 0.0) / before) + (1 - PAIR) * single if before else single)
        return out

    def gain(self, chain: int, left: str, s: str, right: str, restored: str) -> float:
        """Log evidence that the site is garbled; none for characters that the corpus never has outside of garbled text."""
        if chain == 1:
            return LOST
        if self.seen and not self.seen.issuperset(_fold(restored)):
            return -LOST
        return self.score(left, restored, right) - self.score(left, s, right)


def mixed(gain: float) -> float:
    """Log likelihood ratio of a site that is garbled or not, with even odds."""
    return math.log(0.5) + (math.log1p(math.exp(gain)) if gain < 30 else gain)


def _multi_sites(run: str) -> list[tuple[int, int, int, str]]:
    """Sites of multi-byte chains, in either case of the letters."""
    upper = run.upper()
    both = sites(run) + (sites(upper) if upper != run and len(upper) == len(run) else [])
    return [x for x in both if 2 <= x[0] < 2 + len(MULTI)]


def _count(shared=None):
    """Sums of characters and pairs: outside of what a multi-byte chain could explain; with clean statistics, the rest of it.

    The rest counts as clean where these statistics prefer the present to all restored characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = None if shared is None else Language(*shared.value)
        chars: Counter[str] = Counter()
        pairs: Counter[int] = Counter()
        for batch in batches:
            runs: Counter[tuple[str, str, str]] = Counter()
            for text in batch.column(0).to_pylist():
                low = _fold(text)
                if language is None:
                    chars.update(low.encode("ascii", "ignore").decode())
                runs.update(_RUNS.findall(low))
            for (left, run, right), n in runs.items():
                t, off = left + run + right, len(left)
                found = _multi_sites(run)
                hidden = {i + off for _, a, b, _ in found for i in range(a, b)}
                if language is None:
                    wanted, near = [i for i in range(off, off + len(run)) if i not in hidden], lambda i: i not in hidden and i + 1 not in hidden  # noqa: E731, B023
                elif hidden:
                    bad = {i + off for c, a, b, u in found if language.gain(c, t[max(0, off + a - 1) : off + a], run[a:b], t[off + b : off + b + 1], u) >= 0 for i in range(a, b)}
                    free = hidden - bad
                    wanted, near = sorted(free), lambda i: (i in free or i + 1 in free) and i not in bad and i + 1 not in bad  # noqa: E731, B023
                else:
                    continue
                for i in wanted:
                    chars[t[i]] += n
                for i in range(len(t) - 1):
                    if near(i):
                        pairs[cell(t[i], t[i + 1])] += n
        yield _rows([(0, ord(c), float(n)) for c, n in chars.items()] + [(1, c, float(n)) for c, n in pairs.items()])

    return run


def _rows(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["kind", "at", "amount"])


def _sums(df: DataFrame) -> list[dict[int, float]]:
    """Amounts by place for each kind: bounded by the characters of Unicode, the cells, or pools times chains."""
    out: list[dict[int, float]] = [{}, {}, {}]
    table = df.groupBy("kind", "at").agg(F.sum("amount").alias("amount")).toArrow()
    for kind, at, amount in zip(*(table.column(c).to_pylist() for c in ("kind", "at", "amount"))):
        out[kind][at] = amount
    return out


def text_sites(text: str, chains: set[int], known: dict[str, list]) -> dict[int, Counter]:
    """By chain asked for: (left, site, right, restored) with their number."""
    out: dict[int, Counter] = defaultdict(Counter)
    for left, run, right in _RUNS.findall(text):
        if run not in known:
            known[run] = sites(run)
        t, off = left + run + right, len(left)
        for chain, a, b, restored in known[run]:
            if chain in chains:
                out[chain][t[max(0, off + a - 1) : off + a], run[a:b], t[off + b : off + b + 1], restored] += 1
    return out


def run_evidence(left: str, run: str, right: str, language: Language, known: dict[str, list]) -> np.ndarray:
    """For each chain, the evidence of its sites in the run, and the best gain of one of them."""
    if run not in known:
        known[run] = sites(run)
    t, off = left + run + right, len(left)
    out = np.zeros((2, len(CHAINS)))
    out[1] = -np.inf
    for chain, a, b, restored in known[run]:
        gain = language.gain(chain, t[max(0, off + a - 1) : off + a], run[a:b], t[off + b : off + b + 1], restored)
        out[0, chain] += mixed(gain)
        out[1, chain] = max(out[1, chain], gain)
    return out


_CANDIDATE = "id long, pool int, chain array<int>, lft array<string>, site array<string>, rgt array<string>, restored array<string>, n array<int>"


def _candidates(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, known, seen = Language(*shared.value), {}, {}
        for batch in batches:
            if len(seen) > REMEMBERED or len(known) > REMEMBERED:
                seen.clear(), known.clear()
            cols: list[list] = [[] for _ in range(8)]
            for key, pool, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text.isascii():
                    continue
                total, best = np.zeros(len(CHAINS)), np.full(len(CHAINS), -np.inf)
                for x in _RUNS.findall(text):
                    if (found := seen.get(x)) is None:
                        found = seen[x] = run_evidence(*x, language, known)
                    total += found[0]
                    np.maximum(best, found[1], out=best)
                rows = []
                chains = set(np.flatnonzero((total > LEAST) & (best > -1)).tolist())
                if chains:
                    for chain, counted in text_sites(text, chains, known).items():
                        rows += [(chain, *site, n) for site, n in counted.items()]
                if rows:
                    for col, value in zip(cols, (key, pool, *map(list, zip(*rows)))):
                        col.append(value)
            s = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int32()), s, s, s, s, pa.list_(pa.int32())))], ["id", "pool", "chain", "lft", "site", "rgt", "restored", "n"])

    return run


def posterior(language: Language, prior, pool: int, rows: list[tuple]) -> tuple[dict[int, float], list[float]]:
    """Posterior of each chain (0: clean), and of each row's site to be garbled given its chain."""
    evidence: dict[int, float] = defaultdict(float)
    own = []
    for chain, left, site, right, restored, n in rows:
        g = language.gain(chain, left, site, right, restored)
        evidence[chain] += n * mixed(g)
        own.append(1 / (1 + math.exp(-max(-500.0, min(500.0, g)))))
    logs = {0: math.log(prior(pool, 0))} | {c: e + math.log(prior(pool, c)) for c, e in evidence.items()}
    top = max(logs.values())
    weights = {c: math.exp(v - top) for c, v in logs.items()}
    total = sum(weights.values())
    return {c: w / total for c, w in weights.items()}, own


class Prior:
    """Share of each chain in a pool of sources, shrunk to its share in the corpus.

    One record is taken off each sum, so that no record is evidence for itself.
    """

    def __init__(self, mass: dict[int, float], records: dict[int, int]):
        k, n = len(CHAINS), max(1, sum(records.values()))
        every = [0.0] * k
        for at, m in mass.items():
            every[at % k] += m
        garbled = [(max(0.0, m - 1) + 0.01) / (n + 0.01 * k) for m in every]
        garbled[0] = max(1e-6, 1 - sum(garbled[1:]))
        self.mass, self.records, self.every = mass, records, garbled

    def __call__(self, pool: int, chain: int) -> float:
        k, n = len(CHAINS), self.records.get(pool, 0)
        own = max(0.0, self.mass.get(pool * k + chain, 0.0) - 1) if chain else max(0.0, n - sum(self.mass.get(pool * k + c, 0.0) for c in range(1, k)))
        return max(1e-9, (own + SHRINK * self.every[chain]) / (n + SHRINK))


def _round(shared, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *statistics, mass, records = shared.value
        language, prior = Language(*statistics), lru_cache(1 << 16)(Prior(mass, records))
        more: list[Counter] = [Counter(), Counter(), Counter()]
        for batch in batches:
            found = []
            for key, pool, *cols in zip(*(c.to_pylist() for c in batch.columns)):
                rows = list(zip(*cols))
                shares, own = posterior(language, prior, pool, rows)
                if last:
                    best = max((c for c in shares if c), key=lambda c: (shares[c], -c))
                    if shares[0] < 0.5:
                        found.append((key, CHAINS[best], shares[best]))
                    continue
                for chain, share in shares.items():
                    if chain and share > 1e-6:
                        more[2][pool * len(CHAINS) + chain] += share
                for (chain, left, _, right, restored, n), q in zip(rows, own):
                    if (amount := shares[chain] * q * n) > 1e-3:
                        t = _fold(left + restored + right)
                        for c in _fold(restored):
                            more[0][ord(c)] += amount
                        for a, b in zip(t, t[1:]):
                            more[1][cell(a, b)] += amount
            if last:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())], ["id", "chain", "share"])
        if not last:
            yield _rows([(k, at, float(n)) for k in range(3) for at, n in more[k].items()])

    return run


def _texts(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    good = documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    return good.select(F.col(key).cast("long").alias("id"), F.pmod(F.xxhash64(source), F.lit(POOLS)).cast("int").alias("pool"), F.col(text).alias("text"))


def garbled(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", rounds: int = ROUNDS) -> DataFrame:
    """``id, chain, share`` of the garbled records: the most probable chain and its posterior."""
    sc, texts = documents.sparkSession.sparkContext, _texts(documents, key, text, source)
    sums = "kind int, at long, amount double"
    base: dict[str, float] = {}
    base_pairs: dict[int, float] = {}

    def add(sums_: list[dict[int, float]], to_chars: dict[str, float], to_pairs: dict[int, float]) -> dict[int, float]:
        for c, n in sums_[0].items():
            to_chars[chr(c)] = to_chars.get(chr(c), 0.0) + n
        for c, n in sums_[1].items():
            to_pairs[c] = to_pairs.get(c, 0.0) + n
        return sums_[2]

    add(_sums(map_arrow(texts.select("text"), _count(), sums)), base, base_pairs)
    add(_sums(map_arrow(texts.select("text"), _count(sc.broadcast((dict(base), dict(base_pairs)))), sums)), base, base_pairs)
    clean = frozenset(c for c, n in base.items() if n >= 2)
    records = {r["pool"]: r["count"] for r in texts.groupBy("pool").count().collect()}  # at most POOLS rows
    seen = cut(map_arrow(texts, _candidates(sc.broadcast((base, base_pairs, clean))), _CANDIDATE))
    chars, pairs, mass = dict(base), dict(base_pairs), {}
    for _ in range(rounds):
        more = _sums(map_arrow(seen, _round(sc.broadcast((chars, pairs, clean, mass, records)), False), sums))
        chars, pairs = dict(base), dict(base_pairs)
        mass = add(more, chars, pairs)
    out = cut(map_arrow(seen, _round(sc.broadcast((chars, pairs, clean, mass, records)), True), "id long, chain string, share double").dropDuplicates(["id"]))
    drop(seen)
    out._language = sc.broadcast((chars, pairs, clean))
    return out


def repair(text: str, chain: str, language: Language) -> str | None:
    """The text with the chain's sites restored where they are more probably garbled; None if characters are lost."""
    if "�" in text or chain == "lost":
        return None
    k = CHAINS.index(chain)

    def fix(m: re.Match) -> str:
        run, out, at = m.group(), [], 0
        for c, a, b, restored in sites(run):
            if c == k:
                left = text[m.start() + a - 1 : m.start() + a] if m.start() + a else ""
                out.append(run[at:a] + (restored if language.gain(c, left, run[a:b], text[m.start() + b : m.start() + b + 1], restored) > 0 else run[a:b]))
                at = b
        return "".join(out) + run[at:]

    return re.sub(r"[^\x00-\x7f]+", fix, text)


def restored(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id, chain, restored`` of the garbled records; restored is null where characters are lost."""
    found = garbled(documents, key, text, source)
    shared = found._language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language = Language(*shared.value)
        for batch in batches:
            ids, chains, texts = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chains, pa.string()), pa.array([repair(t, c, language) for t, c in zip(texts, chains)], pa.string())], ["id", "chain", "restored"])

    joined = found.select("id", "chain").join(_texts(documents, key, text, source).select("id", "text"), "id")
    return map_arrow(joined, run, "id long, chain string, restored string").distinct()
