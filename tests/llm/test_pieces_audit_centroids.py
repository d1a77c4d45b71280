"""SentencePiece, the filter audit and centroid clustering against the library and plain Python."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from data import docs, odd_rows, prose

from boardwalk.llm import centroids, filter_audit, pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return pieces.load(PIECES)


# --- SentencePiece --------------------------------------------------------------------------------

def _texts(library, seed, count):
    draw = random.Random(seed)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, len(library))]
    odd = ["a", " ", "  ", "   ", "\n", "\t", "\0", "é", "漢", "字", "ﬁ", "①", "😀", "▁", "<0x0A>", "<s>", "</s>",
           "<unk>", "12", "aaaa", "lll", "http://", "ing", "Straße", "привет", "‍", "﻿", "⁇", "�", "            "]
    kinds = [lambda: draw.choice(names), lambda: draw.choice(odd), lambda: draw.choice(names).strip(),
             lambda: draw.choice("abcdefghijklmnopqrstuvwxyz"), lambda: chr(draw.choice([draw.randrange(32, 0x3000), draw.randrange(0x1F300, 0x1F700)]))]
    return ["".join(kinds[k % len(kinds)]() for _ in range(draw.randrange(60))) for k in range(count)]


def test_pieces_encode_and_decode_as_the_library(library, model):
    texts = ["", " ", "   ", "\n", *_texts(library, 5, 3000)]
    ids, border = model.encode(texts)
    for k, text in enumerate(texts):
        own = ids[border[k]:border[k + 1]]
        assert own.tolist() == library.encode(text), text
        assert model.decode(own).decode() == library.decode(own.tolist()), text


def test_pieces_decode_any_ids_as_the_library(library, model):
    draw = random.Random(6)
    for k in range(2000):
        ids = [draw.randrange(300 if k % 2 else len(library)) for _ in range(draw.randrange(12))]
        parts = [np.array(ids[:k % 5], np.int64), np.array(ids[k % 5:], np.int64)]
        assert model.decode(np.array(ids, np.int64)).decode() == library.decode(ids), ids
        assert b"".join(model.decode_parts(parts)).decode() == library.decode(ids), ids


@pytest.mark.parametrize("text", [" " * 3000, "a" * 3000, "ab" * 2000 + " " * 40 + "漢字" * 900, "x" + " \n" * 1500, "é" * 2000])
def test_long_runs_and_cut_texts(library, model, text):
    assert model.encode([text])[0].tolist() == library.encode(text)
    parts = model.cut(text, 100)
    assert "".join(parts) == text
    assert model.encode(parts, [k == 0 for k in range(len(parts))])[0].tolist() == library.encode(text)


def test_only_models_of_the_known_kind_are_taken():
    class Other:
        def encode(self, text, out_type=int):
            return ["▁two"]

        def decode(self, ids):
            return "two"

    with pytest.raises(ValueError):
        pieces.Model._refuse_other_kinds(Other())


def _expected(library, text):
    ids = library.encode(text or "")
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_query_on_odd_rows(spark, library):
    rows = odd_rows()
    table = docs(spark, rows, extra="n_tokens")
    expected = sorted(((i, *_expected(library, t)) for i, t in rows), key=str)
    for parts in (1, 5):
        got = pieces.digests(table.repartition(parts), PIECES)
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == expected
    assert pieces.digests(table.limit(0), PIECES).count() == 0
    encoded = pieces.encode(table, PIECES)
    assert sorted(map(tuple, pieces.decode(encoded, PIECES).collect()), key=str) == sorted(
        ((i, library.decode(library.encode(t or ""))) for i, t in rows), key=str)


def test_blocks_do_not_show(library, model, monkeypatch):
    texts = [prose(k, 400) for k in range(6)] + ["", "x" * 700]
    monkeypatch.setattr(pieces, "BLOCK", 500)
    monkeypatch.setattr(pieces.Model, "cut", lambda self, text, size=500, cut=pieces.Model.cut: cut(self, text, size))
    rows = list(pieces._by_row(pieces._encoded(model, texts), len(texts)))
    assert [pieces._digest(model, parts) for parts in rows] == [_expected(library, t) for t in texts]


# --- filter audit ---------------------------------------------------------------------------------

def _plain_audit(rows, marks):
    """(part, order, step) -> counts, by running every order over every row."""
    good = {i for i, quality, _ in marks if quality == 1 and i is not None}  # a null id has no label
    toxic = {i for i, _, toxic in marks if toxic == 1 and i is not None}
    texts = [(i, t or "", s or "") for i, t, s in rows]
    masks = []
    for i, text, part in texts:
        words = WORD.findall(text)
        masks.append({
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": bool(set(text) & set("#$%&*|")),
            "E": i is not None and any(j is not None and j < i and t == text for j, t, _ in texts)})
    out, shapley = {}, {}
    for part in {p for _, _, p in texts}:
        own = [(i, m) for (i, _, p), m in zip(texts, masks) if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if m[f]]
                left = [(i, m) for i, m in left if not m[f]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), sum(m[f] for _, m in own) - len(gone),
                    sum(m[f] and sum(m.values()) == 1 for _, m in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _odd_documents():
    draw = random.Random(4)
    rows = []
    for k in range(60):
        text = " ".join(f"w{draw.randrange(draw.choice([20, 500]))}" for _ in range(draw.choice([10, 49, 50, 51, 200])))
        text = text.upper() if draw.random() < 0.2 else text
        rows.append((k, text + draw.choice(["", "", " #", "|"]), draw.choice(["a", "b", "", None])))
    rows += [(100 + k, rows[draw.randrange(20)][1], draw.choice(["a", "c"])) for k in range(25)]
    rows += [(7, rows[7][1], "a"), (7, rows[7][1], "c"), (None, rows[3][1], "a"), (None, None, None), (200, None, "a"),
             (201, "", "a"), (202, " \n\t", "b"), (203, "x " * 5000, "c"), (204, "ÀÉ" * 30, "c"), (-5, rows[9][1], "d")]
    marks = [(k, k % 2, (k // 2) % 2) for k in range(0, 120, 3)] + [(6, 0, 1), (9, None, None), (None, 1, 1), (999, 1, 1)]
    return rows, marks


def _tables(spark, rows, marks):
    documents = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mask int")
    return documents, spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, part string")


def test_audit_matches_running_every_order(spark):
    rows, marks = _odd_documents()
    expected = _plain_audit(rows, marks)
    documents, labels = _tables(spark, rows, marks)
    for parts in (1, 6):
        got = filter_audit.audit(documents.repartition(parts), labels.repartition(parts)).collect()
        assert {tuple(r[:3]): tuple(r[3:]) for r in got} == expected and len(got) == len(expected)


def test_audit_of_empty_tables(spark):
    rows, marks = _odd_documents()
    documents, labels = _tables(spark, rows, marks)
    assert filter_audit.audit(documents.limit(0), labels).count() == 0
    got = filter_audit.audit(documents, labels.limit(0)).collect()
    assert len(got) == 600 * len({s or "" for _, _, s in rows}) and not any(r.good_lost or r.toxic_lost for r in got)


def test_swaps_meet_every_order_and_keep_the_counts():
    draw = random.Random(2)
    masks = {m: (draw.randrange(4), draw.randrange(3), 0) for m in range(32) if draw.random() < 0.6}
    diagram = filter_audit.Diagram(5, masks, 3)
    met = {tuple(diagram.order)}
    whole = diagram.weight[diagram.root]
    for level in filter_audit._neighbour_swaps(5):
        diagram.swap(level)
        met.add(tuple(diagram.order))
        assert diagram.weight[diagram.root] == whole
        fresh = {}
        for mask, counts in masks.items():
            passed = [k for k in diagram.order if mask >> k & 1]
            first = passed[0] if passed else None
            fresh[first] = fresh.get(first, 0) + counts[0]
        assert {k: removed[0] for k, _, removed, _ in diagram.passes()} == {k: fresh.get(k, 0) for k in diagram.order}
    assert len(met) == math.factorial(5)


def test_equal_subgraphs_are_one_node():
    same = filter_audit.Diagram(5, {m: (1, 0, 0) for m in range(32)}, 3)
    assert len(same.nodes) == 6  # a leaf and one node a level


# --- centroids ------------------------------------------------------------------------------------

def _nearest(vectors, centers):
    apart = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers] for v in vectors]
    return [(min(d), d.index(min(d))) for d in apart]


@pytest.mark.parametrize("seed", range(12))
def test_orchard_finds_the_nearest_and_the_smallest_of_equals(seed):
    draw = np.random.default_rng(seed)
    size = int(draw.integers(1, 5))
    centers = draw.integers(-4, 5, (int(draw.integers(1, 12)), size))  # many ties and equal centroids
    vectors = draw.integers(-6, 7, (400, size))
    best, distance = centroids.Orchard(centers).nearest(vectors)
    assert list(zip(distance.tolist(), best.tolist())) == _nearest(vectors.tolist(), centers.tolist())


def test_orchard_leaves_far_centroids_out():
    draw = np.random.default_rng(1)
    centers = draw.integers(-1000, 1000, (40, 3))
    vectors = centers[draw.integers(0, 40, 2000)] + draw.integers(-5, 6, (2000, 3))
    orchard = centroids.Orchard(centers)
    best, distance = orchard.nearest(vectors)
    assert list(zip(distance.tolist(), best.tolist())) == _nearest(vectors.tolist(), centers.tolist())
    assert orchard.computed < 2000 * 40 / 3


def _plain_clusters(rows, count=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]

    def key(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest(), row[1])

    centers = [v for _, v in sorted(kept, key=key)[:count]]
    for _ in range(rounds):
        near = [c for _, c in _nearest([v for _, v in kept], centers)]
        for c in range(len(centers)):
            own = [v for (_, v), n in zip(kept, near) if n == c]
            if own:
                centers[c] = [sum(x) // len(own) for x in zip(*own)]
    near = _nearest([v for _, v in kept], centers)
    per = {}
    for d, c in near:
        per[c] = per.get(c, 0) + d
    return sorted((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest())
                  for (i, _), (d, c) in zip(kept, near) if i is not None)


def _vectors(count, seed=3):
    draw = random.Random(seed)
    return [(k, [float(np.float32(draw.gauss(0, 0.2) + (k % 7) * 0.1)) for _ in range(64)]) for k in range(count)]


VECTORS = "vec_id long, embedding array<float>, label int, cluster string"


def test_clusters_match_plain_python(spark):
    rows = _vectors(150)
    rows += [(500, rows[3][1]), (7, rows[7][1]), (501, None), (502, []), (503, [0.1] * 63), (504, [0.1] * 65),
             (505, [None] + [0.1] * 63), (506, [float("nan")] + [0.1] * 63), (507, [float("-inf")] + [0.1] * 63),
             (508, [0.0] * 64), (509, [-0.0] * 64), (510, [-1e-9] * 64), (None, rows[5][1])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    expected = _plain_clusters(rows)
    for parts in (1, 7):
        got = centroids.cluster(table.repartition(parts))
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        found = [tuple(r) for r in got.collect()]
        assert sorted(r for r in found if r[0] is not None) == expected
        assert sum(r[0] is None for r in found) == 1


def test_few_vectors_and_none(spark):
    rows = _vectors(3) + [(9, [0.5] * 64), (9, [0.5] * 64)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    assert sorted(map(tuple, centroids.cluster(table).collect())) == _plain_clusters(rows)
    empty = centroids.cluster(table.limit(0))
    assert empty.count() == 0 and empty.columns[-1] == "centroid_sha256"


def test_components_beyond_exact_sums_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30] + [0.0] * 63, 1, "x")], VECTORS)
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(table).count()
