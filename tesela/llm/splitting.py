"""Oversized texts into overlapping pieces cut at natural boundaries, by pointer doubling.

All texts of a block are cut together: every boundary is joined, by binary search in the sorted boundaries of
each kind, to its farthest legal successor; squaring the successor table marks all greedy cuts of all texts
in as many steps as the logarithm of the most pieces. Work stays inside a row, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesela.llm.tokens import VOCABULARY, encoder
from tesela.runtime import ready_workers

#: Bytes of text whose boundaries are held at a time.
BLOCK_BYTES = 1_000_000
# What a cut is at, and abbreviations whose stop ends no sentence.
KINDS = ["palabra", "oracion", "linea", "parrafo"]
ABBREVIATIONS = ["Sr", "Sra", "Dr", "Dra", "Ing", "Lic", "Av", "Bv", "Nro", "nro", "pág", "aprox", "cuad", "hs", "art", "Art", "Tel", "vs", "etc", "O.T", "v"]
_STOP = re.compile(b"(?:[.!?]|\xe2\x80\xa6)[\"')\\]\xbb\xc2]*(?=\\s+(?:[\"'(*-]|\xe2\x80\xa2|\xc2\xab|\\s)*(?:[A-Z0-9]|\xc3[\x80-\x9e]|\xc2[\xbf\xa1]))")
_SHORT = re.compile(b"(?:^|[^A-Za-z\x80-\xff.])(?:" + b"|".join(re.escape(a.encode()) for a in ABBREVIATIONS) + b")\\.$")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in ",;:|/)]}>_-"]] = True


def _sentence_ends(raw: bytes) -> list[int]:
    return [m.end() for m in _STOP.finditer(raw) if not _SHORT.search(raw, max(0, m.start() - 8), m.start() + 1)]


def cut_block(texts: list[bytes], tokens: list[np.ndarray], lengths: np.ndarray, capacity: int, overlap: int) -> tuple[np.ndarray, ...]:
    """Pieces of a block of texts as arrays ``text, token from, token to, byte from, byte to, kind``; token and byte numbers count from a text's start, kind is -1 at a cut inside a word and 4 at the end."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size, n_tok = np.array([len(t) for t in texts]), np.array([len(t) for t in tokens])
    byte0, tok0 = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(n_tok)])
    at = np.concatenate([[0], np.cumsum(lengths[np.concatenate(tokens)])])  # byte of each token boundary; boundary i is before token i
    end_of = np.repeat(tok0[1:], n_tok)  # of token i's text
    is_edge = np.zeros(len(at), bool)
    is_edge[tok0] = True
    inner = np.flatnonzero(~is_edge)
    blank = _BLANK[raw]
    here = at[inner]
    whole_char = (raw[here] & 0xC0) != 0x80
    word = blank[here] & ~blank[here - 1]
    solid = np.where(blank, len(raw), np.arange(len(raw)))
    next_solid = np.minimum.accumulate(solid[::-1])[::-1]
    breaks = (raw == 10) | ((raw == 13) & np.append(raw[1:] != 10, True))
    lines = np.concatenate([[0], np.cumsum(breaks)])
    last = byte0[np.searchsorted(tok0, inner, "right")]
    n_breaks = lines[np.minimum(next_solid[here], last)] - lines[here]
    is_stop = np.zeros(len(raw) + 1, bool)
    for text, first in zip(texts, byte0.tolist()):
        is_stop[[first + e for e in _sentence_ends(text)]] = True
    sentence = is_stop[here]
    kind = np.full(len(at), -2, np.int8)  # -2: no place for a cut, -1: between characters, then KINDS
    kind[inner[whole_char]] = -1
    kind[inner[word]] = np.where(n_breaks >= 2, 3, np.where(n_breaks == 1, 2, np.where(sentence, 1, 0)))[word]
    kind[tok0] = 4
    places = np.flatnonzero(kind >= -1)
    floor = places[np.searchsorted(places, np.arange(len(at)), "right") - 1]  # greatest place up to a boundary
    text_of = np.minimum(np.searchsorted(tok0, np.arange(len(at)), "right") - 1, len(texts) - 1)

    def cramped() -> np.ndarray:
        """The boundaries inside a stretch without soft places that is too long to always find one; texts are stretches of their own."""
        soft = np.flatnonzero(kind >= 0)
        long = np.flatnonzero(np.diff(soft) > (capacity - overlap) // 2)
        step = np.zeros(len(kind) + 1, np.int32)
        step[soft[long] + 1] += 1
        step[soft[long + 1]] -= 1
        return np.cumsum(step[:-1]) > 0

    after_sign = np.append(False, _SIGN[raw])[at] & (kind == -1) & cramped()
    kind[after_sign] = 0  # in a stretch without blanks words also end at signs
    is_node = (kind >= 0) | ((kind == -1) & cramped())  # a stretch without signs needs cuts inside words
    nodes = np.flatnonzero(is_node)
    is_start = is_edge[nodes]
    text_end = end_of[np.minimum(nodes, len(end_of) - 1)]
    start = np.where(is_start, nodes, floor[np.maximum(nodes - overlap, 0)])
    start = np.maximum(start, tok0[text_of[nodes]])
    limit = start + capacity
    succ = np.full(len(nodes), -1)
    for k, least in ((3, capacity // 2), (2, capacity // 2), (1, capacity // 2), (0, overlap), (-1, overlap)):
        of_kind = nodes[kind[nodes] >= k] if k <= 0 else nodes[kind[nodes] == k]
        if not len(of_kind):
            continue
        far = of_kind[np.maximum(np.searchsorted(of_kind, np.minimum(limit, text_end), "right") - 1, 0)]
        good = (succ < 0) & (far > np.maximum(nodes, start + least)) & (far <= limit)
        succ[good] = far[good]
    ends_here = limit >= text_end
    succ = np.where(ends_here, text_end, np.where(succ < 0, np.minimum(limit, text_end), succ))
    final = nodes == len(at) - 1
    succ = np.where(final, nodes, succ)
    # a text's end is the next text's start: ends are nodes of their own, behind all others, and point to themselves
    ends = np.arange(len(texts)) + len(nodes)
    jump = np.searchsorted(nodes, succ)
    to_end = succ == text_end
    jump = np.where(to_end, ends[text_of[nodes]], jump)
    jump = np.concatenate([jump, ends])
    reached = np.zeros(len(jump), bool)
    reached[np.searchsorted(nodes, tok0[:-1])] = True
    while True:
        before = reached.sum()
        reached[jump[reached]] = True
        if reached.sum() == before:
            break
        jump = jump[jump]
    begin = np.flatnonzero(reached[: len(nodes)] & ~final)
    a, b = start[begin], succ[begin]
    text = np.searchsorted(tok0, nodes[begin], "right") - 1
    done = b == tok0[text + 1]
    return text, a - tok0[text], b - tok0[text], at[a] - byte0[text], at[b] - byte0[text], np.where(done, 4, kind[b])


def split_documents(documents: DataFrame, capacity: int, overlap: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, pieza, tok_ini, tok_fin, corte, texto`` for the pieces of every text of more than ``capacity`` tokens.

    A piece has at most ``capacity`` tokens; each but a text's first begins ``overlap`` tokens before the end of the one before it,
    or as many more as keep a character whole. It ends at the farthest paragraph end in its second half, else line
    end, else sentence end, else at its farthest word end, and only inside a word that alone exceeds the room
    (``corte`` names which, ``final`` is the text's end). Where blanks lie more than half of the room apart, words between them
    also end at signs; this holds for that stretch alone, so no cut depends on what follows behind it. Null, empty and short texts give no rows; repeated texts and ids
    are cut each for itself. Tokens are those of the whole text.
    """
    if not 0 <= overlap <= capacity // 2 or capacity < 16:
        raise ValueError("capacity must be at least 16 tokens and overlap at most half of it")
    ready_workers(documents.sparkSession)
    names = np.array([*KINDS, "final", "caracter"], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = encoder(vocabulary)

        def flush() -> pd.DataFrame:
            text, a, b, x, y, kind = cut_block([t for _, t, _ in held], [k for _, _, k in held], lengths, capacity, overlap)
            number = np.arange(len(text)) - np.searchsorted(text, text)
            pieces = [held[t][1][i:j].decode() for t, i, j in zip(text.tolist(), x.tolist(), y.tolist())]
            return pd.DataFrame({"doc_id": np.array([held[t][0] for t in text.tolist()], np.int64), "pieza": number.astype(np.int32), "tok_ini": a.astype(np.int32), "tok_fin": b.astype(np.int32), "corte": names[kind], "texto": pieces})

        held, weight = [], 0
        for batch in batches:
            for doc, text in zip(batch.doc_id.tolist(), batch.text.tolist()):
                raw = text.encode() if text else b""
                if len(raw) <= capacity:
                    continue
                tokens = encoding.encode_ordinary(text)
                if len(tokens) <= capacity:
                    continue
                held.append((doc, raw, np.array(tokens, np.int64)))
                weight += len(raw)
                if weight >= BLOCK_BYTES:
                    yield flush()
                    held, weight = [], 0
        if held:
            yield flush()

    return documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(run, "doc_id bigint, pieza int, tok_ini int, tok_fin int, corte string, texto string")


def piece_checks(pieces: DataFrame, documents: DataFrame, capacity: int, overlap: int) -> DataFrame:
    """``control, valor``: pieces beyond ``capacity``, pieces that don't share ``overlap`` tokens (up to three more) with the one before, texts that don't begin or end with their document, and texts that aren't part of it."""
    along = Window.partitionBy("doc_id").orderBy("pieza")  # a document's pieces, which one row held before
    shared = F.lag("tok_fin").over(along) - F.col("tok_ini")
    rows = pieces.select("*", shared.alias("_shared"), F.lead("pieza").over(along).isNull().alias("_last")).join(documents.select("doc_id", "text"), "doc_id", "left")
    whole = F.coalesce(F.instr("text", F.col("texto")) > 0, F.lit(False))
    ends = F.when(F.col("pieza") == 0, F.startswith("text", "texto")).otherwise(True) & F.when(F.col("_last"), F.endswith("text", "texto")).otherwise(True)
    checks = {"excedidas": F.col("tok_fin") - F.col("tok_ini") > capacity, "solapes_distintos": (F.col("pieza") > 0) & ~F.col("_shared").between(overlap, overlap + 3), "sin_principio_o_fin": ~F.coalesce(ends, F.lit(False)), "ajenas": ~whole}
    one = rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "control", "valor")
