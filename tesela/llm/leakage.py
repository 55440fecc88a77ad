"""Evaluation passages in a corpus, by an edit-to-Hamming embedding and bit-sampling LSH.

Words are the symbols. Windows of as many words as a passage needs are embedded by CGK random walks, read from either
end, which turn edit distance into Hamming distance; tables of sampled positions give candidates, and an exact edit
distance to the stretches of about that length decides. The items' index goes to the executors in blocks of
bounded size; the corpus is read once per block and not shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.runtime import cut, ready_workers

#: Words of items that form one index, at most about 100 MB; more are taken in blocks, each against the whole corpus. Words of a part of an item.
WORDS_PER_BLOCK, PART_WORDS = 200_000, 2_000
#: Words of text whose windows are held at a time.
BLOCK_WORDS = 400_000
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff]+")


def plain(text: str) -> str:
    """``text`` without case and accents."""
    return _MARKS.sub("", unicodedata.normalize("NFD", text.casefold()))


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of ``text``, without case and accents."""
    return _WORD.findall(plain(text)) if text else []


class Vocabulary(dict):
    """Numbers, from 1, of the items' words; 0 for any other. Accented spellings are kept as they are met, up to a bound."""

    def __missing__(self, word: str) -> int:
        if word.isascii():
            return 0
        number = self.get(plain(word), 0)
        if len(self) < 500_000:
            self[word] = number
        return number


def _numbers(text: str, vocabulary: Vocabulary) -> list[int]:
    text = text.lower()
    found = _WORD.findall(plain(text) if _MARKS.search(text) else text)
    return list(map(vocabulary.__getitem__, found))


class PassageIndex:
    """Windows of ``size`` words of the items under random walks over both directions of reading, with bit samples of the walks.

    A walk reads a window from its first word or from its last, so a window that lost or gained a word still agrees with the
    item's from one of its ends up to the edit. ``walks`` walks are taken each way, with ``tables`` samples of ``bits`` positions each.
    Equal windows collide in every table; the recall of windows at ``edits`` edits is measured, kind by kind, in the
    tests. A window that several items share is kept once, with a list of its owners.
    """

    def __init__(self, items: list[tuple[int, list[str]]], size: int, edits: int, walks: int = 4, tables: int = 6, bits: int = 7, seed: int = 20):
        self.size, self.edits = size, edits
        self.vocabulary = Vocabulary()
        for _, w in items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        rows = [np.lib.stride_tricks.sliding_window_view(np.array([self.vocabulary[x] for x in w], np.int32), size) for _, w in items if len(w) >= size]
        every = np.concatenate(rows) if rows else np.zeros((0, size), np.int32)
        owner = np.repeat(np.array([i for i, w in items if len(w) >= size], np.int64), [len(r) for r in rows])
        self.windows, place = np.unique(every, axis=0, return_inverse=True)
        both = np.unique(np.stack([place.reshape(-1), owner], 1), axis=0)
        self.owners, self.owned_from = both[:, 1], np.searchsorted(both[:, 0], np.arange(len(self.windows) + 1))
        rng = np.random.default_rng(seed)
        self.blank = len(self.vocabulary) + 1
        # a walk of n steps has read about n/2 words, so the first 4/3 size steps tell most of a window
        self.length = size * 4 // 3
        self.steps = [rng.integers(0, 2, (self.length, self.blank + 1), dtype=np.int8) for _ in range(2 * walks)]
        self.samples = [[np.sort(rng.choice(self.length, bits, replace=False)) for _ in range(tables)] for _ in range(2 * walks)]
        self.factors = rng.integers(1, 1 << 62, bits, dtype=np.int64) | 1
        self.keys = [[self._sorted(k) for k in self._keys(self.windows[:, ::way], w)] for w, way in self._walks()]

    def _walks(self) -> list[tuple[int, int]]:
        """The walks with their direction of reading, 1 or -1."""
        return [(w, 1 if w < len(self.steps) // 2 else -1) for w in range(len(self.steps))]

    @staticmethod
    def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], order.astype(np.int32)

    def _keys(self, windows: np.ndarray, w: int) -> list[np.ndarray]:
        """The sampled keys of each window under walk ``w``: at each step a coin of the step and the word read says whether to go on to the next word."""
        steps, n = self.steps[w], len(windows)
        flat = np.concatenate([windows, np.full((n, 1), self.blank, windows.dtype)], 1).reshape(-1)
        at = np.arange(n) * (self.size + 1)
        last = at + self.size
        walk = np.empty((self.length, n), np.int32)
        for j in range(self.length):
            walk[j] = flat[at]
            at = np.minimum(at + steps[j, walk[j]], last)
        with np.errstate(over="ignore"):
            return [(walk[s] * self.factors[:, None]).sum(0) for s in self.samples[w]]

    def search(self, symbols: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, item window, distance)``: windows of ``size`` words from ``starts``, lengthened or shortened by up to ``edits`` at either end, that are at most ``edits`` word edits from an item's.

        ``symbols`` has at least ``edits`` foreign ones before and behind every text; ``first`` and ``last`` are the bounds of the text of each start.
        """
        items, found = max(1, len(self.windows)), []
        for way in (1, -1):
            pairs = []
            for w, own in self._walks():
                if own != way:
                    continue
                for keys, (known, order) in zip(self._keys(symbols[starts[:, None] + np.arange(self.size)[::way]], w), self.keys[w]):
                    low = np.searchsorted(known, keys, "left")
                    hit = np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys)
                    low = low[hit]
                    n = np.searchsorted(known, keys[hit], "right") - low
                    pairs.append(np.repeat(hit, n) * items + order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
            at, item = np.divmod(np.unique(np.concatenate(pairs)), items)
            edge = starts[at] if way > 0 else starts[at] + self.size - 1
            room = last[at] - edge if way > 0 else edge - first[at] + 1
            distance = prefix_distances(self.windows[item][:, ::way], symbols, edge, way, room, self.edits)
            good = distance <= self.edits
            found.append((at[good], item[good], distance[good]))
        return tuple(np.concatenate(x) for x in zip(*found))


def prefix_distances(a: np.ndarray, symbols: np.ndarray, edge: np.ndarray, way: int, room: np.ndarray, edits: int) -> np.ndarray:
    """Least word edit distance of each row of ``a`` to the stretches of ``symbols`` that begin at ``edge``, read in direction ``way``, whose
    lengths differ from the row's by up to ``edits`` and don't exceed ``room``; ``edits + 1`` for any greater distance. Only a band of the table is filled."""
    n, width = a.shape[1], 2 * edits + 1
    far = np.full(len(a), edits + 1, np.int16)
    b = [symbols[np.clip(edge + way * j, 0, len(symbols) - 1)] for j in range(n + edits)]
    # band[d] is the table's cell (i, i + d - edits)
    band = [np.full(len(a), max(d - edits, 0), np.int16) if d >= edits else far for d in range(width)]
    for i in range(1, n + 1):
        new: list[np.ndarray] = []
        for d in range(width):
            j = i + d - edits
            if j < 0:
                cell = far
            elif j == 0:
                cell = np.full(len(a), i, np.int16)
            else:
                cell = band[d] + (a[:, i - 1] != b[j - 1])
                if d:
                    cell = np.minimum(cell, new[d - 1] + 1)
                if d + 1 < width:
                    cell = np.minimum(cell, band[d + 1] + 1)
            new.append(np.minimum(cell, edits + 1))
        band = new
    best = far.copy()
    for d in range(width):
        best = np.where(room >= n + d - edits, np.minimum(best, band[d]), best)
    return best.astype(np.int64)


def item_parts(items: DataFrame, size: int) -> DataFrame:
    """``item_id, palabras``: the words of each item in parts of up to PART_WORDS, of which consecutive ones share ``size - 1`` words, so that no window is lost."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, w[k : k + PART_WORDS + size - 1]) for i, t in zip(batch.item_id.tolist(), batch.text.tolist()) for w in [words(t)] for k in range(0, max(1, len(w) - size + 1), PART_WORDS) if len(w) >= size]
            yield pd.DataFrame(out, columns=["item_id", "palabras"])

    return items.select("item_id", "text").where("item_id is not null and text is not null").mapInPandas(run, "item_id bigint, palabras array<string>")


def leaked_items(documents: DataFrame, items: DataFrame, size: int = 12, edits: int = 1) -> DataFrame:
    """``doc_id, item_id, ediciones``: documents with a passage of ``size - edits`` to ``size + edits`` words that is at most ``edits`` word edits (a word put in, left out or replaced) from ``size`` consecutive words of an item, and the least distance.

    Words are runs of letters and digits without case and accents. Null and empty texts and items of fewer words contain and leak
    nothing; repeated texts are reported each. A window is searched unless more than ``edits`` of its words occur in no item,
    when it can't be that close to any. The items' words are counted and taken in blocks of about WORDS_PER_BLOCK, each against all documents.
    """
    spark = documents.sparkSession
    ready_workers(spark)
    parts = cut(item_parts(items, size))
    total = parts.agg(F.coalesce(F.sum(F.size("palabras")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // WORDS_PER_BLOCK))
    corpus = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    out = None
    for block in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item_id", "palabras"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(PassageIndex([(r[0], r[1]) for r in rows], size, edits))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            if not len(index.windows):
                return

            def flush() -> pd.DataFrame:
                symbols = np.array([*foreign, *numbers, *([0] * size)], np.int32)
                # texts lie behind each other with foreign words between; text k ends at last[k]
                last = np.cumsum(np.array(counts) + edits)
                first = last - np.array(counts)
                known = np.concatenate([[0], np.cumsum(symbols > 0)])
                at = np.arange(len(symbols) - size + 1)
                at = at[known[at + size] - known[at] >= size - edits]
                # a window may begin or end up to edits words outside its text
                text = np.minimum(np.searchsorted(last + edits, at + size, "left"), len(docs) - 1)
                inside = (at >= first[text] - edits) & (at + size <= last[text] + edits)
                at, text = at[inside], text[inside]
                if not len(at):
                    return pd.DataFrame({"doc_id": [], "item_id": [], "ediciones": []})
                place, window, distance = index.search(symbols, at, first[text], last[text])
                n = index.owned_from[window + 1] - index.owned_from[window]
                owner = np.repeat(index.owned_from[window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found = pd.DataFrame({"doc_id": np.repeat(np.array(docs, np.int64)[text[place]], n), "item_id": index.owners[owner], "ediciones": np.repeat(distance, n)})
                return found.groupby(["doc_id", "item_id"], as_index=False).ediciones.min()

            docs, counts, numbers, foreign = [], [], [], [0] * edits
            for batch in batches:
                for doc, text in zip(batch.doc_id.tolist(), batch.text.tolist()):
                    own = _numbers(text, index.vocabulary)
                    if len(own) < size - edits:
                        continue
                    docs.append(doc)
                    counts.append(len(own))
                    numbers += own
                    numbers += foreign
                    if len(numbers) >= BLOCK_WORDS:
                        yield flush()
                        docs, counts, numbers = [], [], []
            if docs:
                yield flush()

        found = corpus.mapInPandas(run, "doc_id bigint, item_id bigint, ediciones int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("ediciones").alias("ediciones"))
