"""Token ids of a corpus under a public byte-level BPE vocabulary.

Texts are split by the vocabulary's pattern; the distinct new words of an Arrow batch are encoded together over a pair
occurrence index: every mergeable pair maps to all its positions in the batch, the active ranks are applied in
ascending order, each to all its positions from left to right, and every merge updates the lists of its neighbours.
Encoded words are kept for later batches of the partition. Nothing is shuffled.

Defined cases: a null, and an empty, text gives an empty list; blanks, long texts and all scripts are encoded whole;
special tokens' strings are ordinary text; repeated rows stay; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesserakg.runtime import map_arrow

#: Where the vocabulary file is; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a task before it starts afresh; bounds memory, changes no result.
REMEMBERED = 300_000
#: Characters of text whose new words share one occurrence index: a whole partition's batch, bounded in memory.
TOGETHER = 4_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in vocabulary files: itself if visible in Latin-1, else the next from 256."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class Vocabulary:
    """Merge table of a vocabulary: ids of the bytes, and (left id, right id) to (rank, merged id)."""

    def __init__(self, ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]):
        self.ids, self.pairs = ids, pairs

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls([vocab[letters[b]] for b in range(256)], {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Ids of each word; all words share one occurrence index."""
    pairs = vocabulary.pairs
    ids: list[int] = []
    ends: list[int] = []
    for w in words:
        ids += [vocabulary.ids[b] for b in w]
        ends.append(len(ids))
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    start = 0
    for end in ends:
        if end > start:
            before[start], after[end - 1] = -1, -1
        start = end
    index: dict[int, list[int]] = {}
    made: dict[int, tuple[int, int, int]] = {}

    def note(p: int) -> bool:
        """Lists the pair that begins at p; whether its rank is new among the active ones."""
        if (q := after[p]) >= 0 and (found := pairs.get(pair := (ids[p], ids[q]))):
            if found[0] in index:
                index[found[0]].append(p)
                return False
            index[found[0]] = [p]
            made[found[0]] = (*pair, found[1])
            return True
        return False

    for p in range(len(ids)):
        note(p)
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, new = made[rank]
        for p in sorted(index.pop(rank)):
            q = after[p]
            if ids[p] != left or q < 0 or ids[q] != right:
                continue  # one of the two has been merged with another neighbour
            ids[p], ids[q] = new, -1
            after[p] = r = after[q]
            if r >= 0:
                before[r] = p
            for at in (before[p], p):
                if at >= 0 and note(at):
                    heapq.heappush(active, pairs[(ids[at], ids[after[at]])][0])
    out, start = [], 0
    for end in ends:
        out.append([x for x in ids[start:end] if x >= 0])
        start = end
    return out


def encoder(vocabulary: Vocabulary) -> Callable[[list[str | None]], list[list[int]]]:
    """A function from texts to ids that remembers words."""
    split = regex.compile(PATTERN).findall
    known: dict[str, list[int]] = {}

    def encode(texts: list[str | None]) -> list[list[int]]:
        if len(known) > REMEMBERED:
            known.clear()
        split_texts = [split(t) if t else [] for t in texts]
        new = list({w for words in split_texts for w in words if w not in known})
        known.update(zip(new, encode_words([w.encode("utf-8", "replace") for w in new], vocabulary)))
        return [[x for w in words for x in known[w]] for words in split_texts]

    return encode


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key, ids`` of each row. The vocabulary (its size is fixed) is read once and sent to the tasks."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value)
        for batch in batches:
            texts, start, held = batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= TOGETHER or i == len(texts) - 1:
                    ids = encode(texts[start : i + 1])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])
                    start, held = i + 1, 0

    return map_arrow(documents.select(key, text), run, f"`{key}` {kind}, ids array<int>")
