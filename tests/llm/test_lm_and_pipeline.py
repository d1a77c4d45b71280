"""The language model, and the pipeline as a whole."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from data import docs, edited, odd_rows, prose

import corpus_pipeline
from boardwalk.llm import lm_score

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(rows):
    """Base scores by plain Python: n_tokens, n_known, N, score."""
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    words = [WORD.findall((t or "").translate(lower)) + [None] for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = collections.Counter(w for ws, held in zip(words, out) if not held for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    return [(held, len(ws), sum(counts[w] > 0 for w in ws), total,
             sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)) for ws, held in zip(words, out)]


def test_base_scores_match_plain_python_with_and_without_a_hot_list(spark, monkeypatch):
    rows = odd_rows() + [(100 + k, prose(k, 60) + " ÀÉ Ab AB") for k in range(60)]
    expected = sorted(str((i, *x[:4], round(x[4], 6))) for (i, _), x in zip(rows, plain_base(rows)))
    scores = []
    for hot in (1 << 18, 5):
        monkeypatch.setattr(lm_score, "HOT", hot)
        got = lm_score.score(docs(spark, rows, extra="row"), RANKS, PATTERN).collect()
        assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == expected
        scores.append(sorted((str(r.doc_id), r.score) for r in got))
    # where a word's count comes from does not matter
    assert np.allclose([s for _, s in scores[0]], [s for _, s in scores[1]], rtol=1e-4)
    assert all(np.isfinite(s) and s <= 0 for _, s in scores[0])
    assert lm_score.score(docs(spark, []), RANKS, PATTERN).collect() == []


def test_model_beats_the_base_on_held_out_texts(spark):
    languages = [[f"{a}{w}{a}" for w in range(40)] for a in ("ka", "lo", "mi", "ru")]
    draw = np.random.default_rng(1)
    rows = [(k, " ".join(draw.choice(languages[k % 4], 60))) for k in range(500)]
    held = [r for r in lm_score.score(docs(spark, rows), RANKS, PATTERN).collect() if r.held_out]
    assert len(held) > 40
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)


def small_model(classes=12):
    draw = np.random.default_rng(3)
    model = {n: p + 0.1 * draw.normal(size=p.shape).astype(np.float32) for n, p in lm_score.initial(classes).items()}
    bigram = np.log(draw.dirichlet(np.ones(classes), classes)).astype(np.float32)
    return model, bigram, draw


def test_gradient_matches_differences():
    model, bigram, draw = small_model()
    before = draw.integers(0, 12, (3, lm_score.WINDOW))
    after = draw.integers(-1, 12, (3, lm_score.WINDOW))
    _, grad = lm_score.gradient(model, bigram, before, after)
    for name in lm_score.NAMES:
        wide = {n: p.astype(np.float64) for n, p in model.items()}
        at = tuple(int(draw.integers(0, s)) for s in model[name].shape)
        ends = []
        for step in (1e-3, -1e-3):
            moved = {n: p.copy() for n, p in wide.items()}
            moved[name][at] += step
            ends.append(lm_score.gradient(moved, bigram.astype(np.float64), before, after)[0])
        assert abs((ends[0] - ends[1]) / 2e-3 - grad[name][at]) < 1e-4


def test_attention_is_causal_and_each_id_is_scored_once():
    model, bigram, draw = small_model()
    vocabulary = type("V", (), {"end": 0, "starts": np.arange(12) < 6})()
    classes = draw.integers(0, 12, 200)
    bounds = np.array([0, 1, 33, 33, 90, 200])
    first, start = lm_score.score_ids(classes, bounds, model, bigram, vocabulary)
    assert (first < 0).all() and (start <= 1e-6).all()
    changed = classes.copy()
    changed[150:] = draw.integers(0, 12, 50)
    again, _ = lm_score.score_ids(changed, bounds, model, bigram, vocabulary)
    assert np.allclose(first[:150], again[:150])
    # one text alone scores as it does among others
    alone, _ = lm_score.score_ids(classes[33:90], np.array([0, 57]), model, bigram, vocabulary)
    assert np.allclose(alone, first[33:90], atol=1e-5)


def test_every_id_depends_on_the_eight_before_it():
    model, bigram, draw = small_model()
    vocabulary = type("V", (), {"end": 0, "starts": np.arange(12) < 6})()
    classes = draw.integers(0, 12, 200)
    bounds = np.array([0, 200])
    first, _ = lm_score.score_ids(classes, bounds, model, bigram, vocabulary)
    for place in range(8, 200):
        changed = classes.copy()
        changed[place - 8] = (changed[place - 8] + 1 + draw.integers(0, 11)) % 12
        again, _ = lm_score.score_ids(changed, bounds, model, bigram, vocabulary)
        assert again[place] != first[place]


def test_windows_hold_every_id_of_every_training_text(spark, monkeypatch):
    seen = []
    fit = lm_score.fit_model
    monkeypatch.setattr(lm_score, "fit_model", lambda windows, size: seen.append((windows, size)) or fit(windows, size))
    made = []
    vocabulary = lm_score.Vocabulary
    monkeypatch.setattr(lm_score, "Vocabulary", lambda *args: made.append(vocabulary(*args)) or made[-1])
    rows = odd_rows() + [(100 + k, prose(k, 1 + 7 * k, vocabulary=4000)) for k in range(40)]
    lm_score.score(docs(spark, rows), RANKS, PATTERN)
    (windows, size), of = seen[0], made[0].of
    subwords = lm_score.Subwords(RANKS, PATTERN)
    expected, pairs = collections.Counter(), collections.Counter()
    for name, text in rows:
        if name is None or zlib.crc32(str(name).encode()) % 7 != 2:
            ids = [i for w in lm_score.words_of(text) for i in subwords(w)] + [subwords.end]
            known = of[ids].tolist()
            expected.update(known)
            pairs.update(zip([made[0].end, *known], known))
    got = np.concatenate([lm_score._as_windows(pa.array([r[0]], pa.binary())) for r in windows.collect()])
    assert collections.Counter(got[:, 1:][got[:, 1:] >= 0].tolist()) == expected
    counted = windows.mapInArrow(lm_score._pairs(size), "pair long, n long").groupBy("pair").sum("n").collect()
    assert {divmod(r[0], size): r[1] for r in counted} == dict(pairs)


def write(spark, folder, rows, known):
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    clean = [(k, prose(k, 120, vocabulary=3000)) for k in range(150)]
    toxic = [(1000 + k, prose(1000 + k, 60) + " snarkface") for k in range(30)]
    junk = [(2000 + k, " ".join(w + "%%%" for w in prose(2000 + k, 60).split())) for k in range(20)]
    near = [(3000 + k, edited(clean[k][1], k, 1)) for k in range(5)]
    known = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic] + [(i, 0, 0) for i, _ in junk]
    folder = write(spark, tmp_path, clean + toxic + junk + near + [(4000, None), (None, None)], known)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    table = spark.read.parquet(f"{folder}/documents.parquet")
    left = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left
        left = stage(spark, before, folder)
        assert left.schema == table.schema
        ids = {r.doc_id for r in left.collect()}
        assert {i for i, _ in clean} <= ids
        if name == "toxicity":
            assert not ids & {i for i, _ in toxic}
        if name == "quality_rules":
            assert not ids & {i for i, _ in junk}
    near_left = corpus_pipeline.STAGES[3][1](spark, docs(spark, clean + near), folder)
    assert {r.doc_id for r in near_left.collect()} == {i for i, _ in clean}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {i for i, _ in clean} <= {r.doc_id for r in packed}


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    folder = write(spark, tmp_path / "odd", odd_rows(), [(4, 1, 0), (None, 0, 1)])
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} <= {4, 5, 8}
    folder = write(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
