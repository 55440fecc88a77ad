"""Packing, splitting and leakage: invariants, round trips, brute force and recall."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tesela.llm import leakage, packing
from tesela.llm.leakage import PassageIndex, leaked_items, prefix_distances, words
from tesela.llm.packing import container_fill, pack_documents
from tesela.llm.splitting import cut_block, split_documents
from tesela.llm.tokens import VOCABULARY, encoder

DOCS = "doc_id bigint, text string, ventana bigint"


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    vocab = ["línea", "poste", "medidor", "N° 12,5", "revisó", "•", "el", "la", "tablero", "año", "𝄞", "Sr. Gómez", "3.249", "équipe"]
    texts = []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            t = "\r\n\r\n".join(". ".join(" ".join(rng.choices(vocab, k=rng.randrange(3, 30))).capitalize() for _ in range(rng.randrange(1, 6))) + "." for _ in range(rng.randrange(1, 12)))
        elif kind == 1:
            t = " ".join(rng.choices(vocab, k=rng.randrange(1, 900)))
        elif kind == 2:
            t = "".join(rng.choices("abcdefé;0123", k=rng.randrange(1, 4000)))
        elif kind == 3:
            t = "\n".join("- " + " ".join(rng.choices(vocab, k=9)) for _ in range(rng.randrange(1, 120)))
        else:
            t = "漢字" * rng.randrange(1, 900)
        texts.append(t)
    return [(i, t, 5) for i, t in enumerate(texts)] + [(1000, None, 5), (1001, "", 5), (1002, texts[0], 5), (1003, " \n\n ", 5), (1004, "x" * 300_000, 5), (None, "sin id", 5)]


@pytest.mark.parametrize("capacity,together", [(256, 20_000), (64, 20)])
def test_packing(spark, monkeypatch, capacity, together):
    monkeypatch.setattr(packing, "MERGED_TOGETHER", together)
    data, enc = corpus(), encoder(VOCABULARY)[0]
    df = spark.createDataFrame(data, DOCS).repartition(5)
    out = pack_documents(df, capacity, open_windows=4)
    pieces, used = defaultdict(list), defaultdict(int)
    for r in out.collect():
        pieces[r.doc_id].append((r.pieza, r.tok_ini, r.tok_fin))
        used[r.contenedor] += r.tok_fin - r.tok_ini
    assert set(pieces) == {d for d, _, _ in data if d is not None}
    assert max(used.values()) <= capacity
    for d, t, _ in data:
        if d is None:
            continue
        own, n = sorted(pieces[d]), len(enc.encode_ordinary(t or ""))
        assert own[0][1] == 0 and own[-1][2] == n and all(a[2] == b[1] for a, b in zip(own, own[1:]))
        assert len(own) == 1 or n > capacity
    assert container_fill(out, capacity).collect()[0].libre < 0.25
    assert pack_documents(df.limit(0), capacity).count() == 0


def test_merging_leaves_little_room(spark):
    rng = random.Random(4)
    data = [(i, "palabra " * rng.randrange(1, 200), 0) for i in range(2000)]
    fill = container_fill(pack_documents(spark.createDataFrame(data, DOCS).repartition(8), 512), 512).collect()[0]
    assert fill.mayor <= 512 and fill.libre < 0.05


@pytest.mark.parametrize("capacity,overlap", [(64, 8), (128, 0), (512, 64)])
def test_splitting(spark, capacity, overlap):
    data, enc = corpus(2), encoder(VOCABULARY)[0]
    out = defaultdict(list)
    for r in split_documents(spark.createDataFrame(data, DOCS), capacity, overlap).collect():
        out[r.doc_id].append(r)
    for d, t, _ in data:
        if d is None:
            continue
        tokens = enc.encode_ordinary(t or "")
        if len(tokens) <= capacity:
            assert d not in out
            continue
        own = sorted(out[d], key=lambda r: r.pieza)
        assert [r.pieza for r in own] == list(range(len(own)))
        assert own[0].tok_ini == 0 and own[-1].tok_fin == len(tokens) and own[-1].corte == "final"
        raw = [enc.decode_single_token_bytes(x) for x in tokens]
        for r in own:
            assert 0 < r.tok_fin - r.tok_ini <= capacity
            assert b"".join(raw[r.tok_ini : r.tok_fin]).decode() == r.texto
            assert len(enc.encode_ordinary(r.texto)) <= capacity
        for a, b in zip(own, own[1:]):
            assert overlap <= a.tok_fin - b.tok_ini <= overlap + 4 and b.tok_fin > a.tok_fin
            if a.corte in ("parrafo", "linea"):
                assert t.encode()[len(b"".join(raw[: a.tok_fin])) :].lstrip(b" \t")[:1] in (b"\n", b"\r")
    assert split_documents(spark.createDataFrame(data, DOCS).limit(0), 64, 8).count() == 0


def test_sentences_end_where_they_end(spark):
    text = " ".join(f"El Sr. Gómez revisó la O.T. nro. {i} (v. 2.{i}) a las 16.02 hs. en la pág. 18." for i in range(60))
    pieces = split_documents(spark.createDataFrame([(1, text, 0)], DOCS), 64, 0).collect()
    assert all(p.texto.endswith("18.") for p in pieces if p.corte == "oracion") and any(p.corte == "oracion" for p in pieces)


BEFORE = ["word,word " * 12, "linea uno\n" * 40, "Una frase. Otra frase corta. " * 20, "a;b" * 90 + " fin. ", "x" * 120 + " y,z " * 30]
AFTER = ["x" * 60, "y,z" * 200, "palabra " * 90, "漢字" * 80, "."]


@pytest.mark.parametrize("before", BEFORE)
def test_what_follows_a_paragraph_does_not_move_its_cuts(before):
    encoding, lengths = encoder(VOCABULARY)

    def cuts(text):
        tokens = np.array(encoding.encode_ordinary(text))
        return cut_block([text.encode()], [tokens], lengths, 40, 4)[4].tolist()

    plain = cuts(before + "\n\n" + "fin " * 40)
    kept = [c for c in plain if c < len(before.encode()) - 200]
    for after in AFTER:
        assert cuts(before + "\n\n" + after + " fin" * 40)[: len(kept)] == kept
    together = cut_block([t.encode() for t in (before, AFTER[0], before)], [np.array(encoding.encode_ordinary(t)) for t in (before, AFTER[0], before)], lengths, 40, 4)
    assert together[4][together[0] == 0].tolist() == together[4][together[0] == 2].tolist() == cuts(before)


def brute_leaks(docs, items, size=12):
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - size + 1):
            grams[tuple(w[k : k + size])].add(i)
    out = set()
    for d, t, _ in docs:
        w = words(t)
        for k in range(len(w) - size + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + size]), ())}
    return {x for x in out if x[0] is not None}


def leak_data():
    rng = random.Random(9)
    vocab = [f"pal{i}" for i in range(300)] + ["Según", "ÁREA", "niño", "4401"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(8, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "corto")]
    items.append((93, items[0][1]))
    docs = []
    for d in range(200):
        w = rng.choices(vocab + [f"otra{k}" for k in range(500)], k=rng.randrange(5, 200))
        if d % 2:
            src = items[rng.randrange(40)][1].split()
            a = rng.randrange(max(1, len(src) - 5))
            part = src[a : a + rng.randrange(8, 20)]
            k = rng.randrange(len(w))
            w[k:k] = part
        text = rng.choice([" ", "\n", ", ", " - "]).join(w)
        docs.append((d, rng.choice([str, str.upper])(text), 0))
    decomposed = __import__("unicodedata").normalize("NFD", items[3][1])
    return docs + [(500, None, 0), (501, "", 0), (None, items[2][1], 0), (502, decomposed, 0), (503, items[0][1], 0), (503, items[0][1], 0)], items


def test_leaks_against_brute_force(spark, monkeypatch):
    docs, items = leak_data()
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in leaked_items(d, i).where("ediciones = 0").collect()} == want and len(want) > 30
    monkeypatch.setattr(leakage, "WORDS_PER_BLOCK", 300)
    monkeypatch.setattr(leakage, "PART_WORDS", 7)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 500)
    assert {(r.doc_id, r.item_id) for r in leaked_items(d, i).where("ediciones = 0").collect()} == want
    assert leaked_items(d, i.limit(0)).count() == 0 and leaked_items(d.limit(0), i).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_near(docs, items, size=12):
    # one edit leaves half of the window as it was, at one end or the other
    halves, out = defaultdict(set), {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            halves[g[:6]].add((i, g))
            halves[g[-6:]].add((i, g))
    for d, t in docs:
        w = words(t)
        for n in (size - 1, size, size + 1):
            for k in range(len(w) - n + 1):
                own = w[k : k + n]
                for i, g in halves[tuple(own[:6])] | halves[tuple(own[-6:])]:
                    e = distance(own, g)
                    if e <= 1:
                        out[d, i] = min(e, out.get((d, i), 1))
    return out


def edited(rng, passage, kind):
    k, out = rng.randrange(1, len(passage) - 1), list(passage)
    if kind == "substitution":
        out[k] = "ajena"
    elif kind == "insertion":
        out.insert(k, rng.choice(["ajena", passage[k]]))
    else:
        del out[k]
    return out


@pytest.mark.parametrize("kind", ["substitution", "insertion", "deletion"])
def test_recall_in_running_text(spark, kind):
    rng = random.Random(17)
    vocab = [f"pal{i}" for i in range(400)]
    items = [(i, rng.choices(vocab, k=40)) for i in range(60)]
    docs = []
    for d in range(400):
        source = items[rng.randrange(60)][1]
        a = rng.randrange(len(source) - 12)
        part = edited(rng, source[a : a + 12], kind)
        around = rng.choices([*vocab, *(f"otra{k}" for k in range(400))], k=rng.randrange(0, 60))
        k = rng.randrange(len(around) + 1)
        docs.append((d, " ".join(around[:k] + part + around[k:])))
    truth = brute_near(docs, [(i, " ".join(w)) for i, w in items])
    assert len(truth) >= 400
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], DOCS).repartition(4)
    got = {(r.doc_id, r.item_id): r.ediciones for r in leaked_items(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()}
    assert got.items() <= truth.items()
    assert len(got) >= 0.95 * len(truth)


def test_near_passages_at_the_rims_of_texts(spark):
    passage = [f"p{k}" for k in range(12)]
    docs = [(1, passage), (2, passage[1:]), (3, passage[:-1]), (4, passage[1:-1]), (5, passage[:5] + ["x"] + passage[5:]), (6, passage[:5] + ["x", "y"] + passage[5:]), (7, passage[:-1] + ["x"]), (8, ["z"]), (9, passage[6:]), (10, passage[:6])]
    got = {r.doc_id: r.ediciones for r in leaked_items(spark.createDataFrame([(d, " ".join(w), 0) for d, w in docs], DOCS).coalesce(1), spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 5: 1, 7: 1}


def test_windows_of_many_owners_are_kept_once():
    same = [f"w{k}" for k in range(14)]
    index = PassageIndex([(i, same) for i in range(50)], 12, 1)
    assert len(index.windows) == 3 and len(index.owners) == 150


def test_prefix_distances():
    rng = np.random.default_rng(1)
    for edits in (0, 1, 2):
        symbols = rng.integers(0, 3, 400)
        edge, way = rng.integers(20, 380, 200), 1
        for way in (1, -1):
            room = rng.integers(5, 12, 200)
            a = np.stack([symbols[e : e + way * 8 : way] for e in edge])
            a[np.arange(200), rng.integers(0, 8, 200)] = rng.integers(0, 3, 200)
            got = prefix_distances(a, symbols, edge, way, room, edits)
            for row, e, r, g in zip(a.tolist(), edge.tolist(), room.tolist(), got.tolist()):
                lengths = [n for n in range(8 - edits, 9 + edits) if n <= r]
                assert g == min([edits + 1, *(distance(row, symbols[e : e + way * n : way].tolist()) for n in lengths)])
