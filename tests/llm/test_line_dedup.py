"""Line chunks: what must go, what must stay."""

import random

from data import docs, odd_rows, prose
from pyspark.sql import functions as F

from boardwalk.llm import line_dedup


def cut(spark, rows):
    return {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}


def test_passages_go_from_all_but_the_first_document(spark):
    passages = [prose(k, n, line=w) for k, (n, w) in enumerate([(55, 55), (56, 28), (60, 12), (70, 7), (200, 9)])]
    rows = []
    for k, passage in enumerate(passages):
        for copy in range(3):
            rows.append((10 * k + copy, "\n".join([prose(1000 + 10 * k + copy, 40), passage, prose(2000 + 10 * k + copy, 40)])))
    got = cut(spark, rows)
    for k, passage in enumerate(passages):
        assert passage in got[10 * k].text and got[10 * k]["_n_removed"] == 0
        for copy in (1, 2):
            name = 10 * k + copy
            assert got[name].text == "\n".join([prose(1000 + name, 40), prose(2000 + name, 40)])


def test_clean_documents_and_short_repeats_stay(spark):
    rows = [(k, "All rights reserved.\n" + prose(k, 80, vocabulary=4000)) for k in range(30)]
    assert all(r.text == dict(rows)[i] and r["_n_removed"] == 0 for i, r in cut(spark, rows).items())


def test_repeats_within_one_document_stay(spark):
    text = "\n".join([prose(1, 60)] * 3)
    assert cut(spark, [(1, text)])[1].text == text


def test_every_removed_line_is_still_held_somewhere(spark, sf):
    before = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    after = line_dedup.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    held = {line for r in after for line in r.text.split("\n")}
    assert len(after) == len(before)
    assert all(line in held for r in before for line in r.text.split("\n") if line)


def test_odd_rows(spark):
    table = docs(spark, odd_rows(), extra="spans")
    out = line_dedup.without_repeats(table)
    assert out.columns == table.columns and out.schema == table.schema
    rows = sorted(((str(r.doc_id), r.text, r.n_chars) for r in out.collect()), key=str)
    assert len(rows) == len(odd_rows())
    texts = dict((i, t) for i, t, _ in rows)
    assert texts["1"] is None and texts["2"] == "" and texts["3"] == " \n\t " and texts["5"] == "" and texts["4"]
    assert all(n == (None if t is None else len(t)) for _, t, n in rows)
    assert line_dedup.without_repeats(docs(spark, [])).collect() == []


def test_repeated_passages_over_short_lines_go_whatever_their_words(spark):
    shapes = [(n, w) for n in range(51, 71) for w in range(5, 20)]
    rows, wanted = [], {}
    for k, (n, w) in enumerate(shapes):
        passage = prose(10 * k, n, vocabulary=4000, line=w)
        for copy in range(2):
            ends = [prose(10 * k + 2 * copy + e, 40, vocabulary=4000) for e in (1, 2)]
            rows.append((2 * k + copy, "\n".join([ends[0], passage, ends[1]])))
            wanted[2 * k + copy] = "\n".join(ends) if copy else rows[-1][1]
    got = cut(spark, rows)
    assert [i for i in wanted if got[i].text != wanted[i]] == []


def test_long_ends_of_passages_go_and_what_only_later_copies_share(spark):
    # lines of one or two words: the nearest chunk can be many lines from the end of a passage
    rows, wanted = [], {}
    for k in range(40):
        passage, tail = prose(100 * k, 60, vocabulary=4000, line=1 + k % 2), prose(100 * k + 1, 60, vocabulary=4000, line=1 + k % 2)
        for copy in range(3):
            own = [prose(100 * k + 10 * copy + e, 40, vocabulary=4000) for e in (2, 3)]
            shared = [passage, tail] if copy else [passage]
            name = 3 * k + copy
            rows.append((name, "\n".join([own[0], *shared, own[1]])))
            wanted[name] = "\n".join([[own[0], passage, own[1]], [own[0], tail, own[1]], own][copy])
    got = cut(spark, rows)
    assert [i for i in wanted if got[i].text != wanted[i]] == []


def _common_runs(one, other):
    """Of lines with words: all maximal common runs, as (begin, end) in ``one``, by dynamic programming."""
    length = [[0] * (len(other) + 1) for _ in range(len(one) + 1)]
    for i, a in enumerate(one):
        for j, b in enumerate(other):
            length[i + 1][j + 1] = length[i][j] + 1 if a == b else 0
    return [(i - n, i) for i in range(1, len(one) + 1) for j in range(1, len(other) + 1)
            if (n := length[i][j]) and not (i < len(one) and j < len(other) and length[i + 1][j + 1])]


def test_against_all_common_runs_of_lines(spark):
    draw = random.Random(5)

    def lines(words, most):
        out = []
        while words > 0:
            size = min(words, draw.randint(1, most))
            out.append(" ".join(f"v{draw.randrange(10 ** 7)}" for _ in range(size)))
            words -= size
        return out

    passages = [lines(draw.randint(51, 130), draw.choice([1, 2, 3, 5, 8, 14, 20, 45, 60, 130])) for _ in range(70)]
    short = [lines(draw.randint(2, 19), draw.choice([2, 6, 20])) for _ in range(15)] + [lines(30, 1)[:1] for _ in range(3)]
    lone = [[" ".join(f"l{k}x{j}" for j in range(40))] for k in range(5)]
    texts = {}
    for name in range(160):
        text = lines(draw.randint(0, 60), 15)
        for _ in range(draw.randint(0, 4)):
            text += draw.choice([*passages, *passages, *short, *lone]) + lines(draw.choice([0, 5, 40]), 15)
        blanks = [x for line in text for x in [line, *[draw.choice(["", " \t"])] * (draw.random() < 0.1)]]
        texts[name] = "\n".join(blanks)
    full = {i: [x for x in t.split("\n") if x.strip()] for i, t in texts.items()}
    got = {i: [x for x in r.text.split("\n") if x.strip()] for i, r in cut(spark, list(texts.items())).items()}
    for name, own in full.items():
        must, may = set(), set()
        for other in full:
            if other == name:
                continue
            for begin, end in _common_runs(own, full[other]):
                words = sum(len(x.split()) for x in own[begin:end])
                if words >= line_dedup.MIN_WORDS and (end - begin > 1 or words > line_dedup.LONE_WORDS):
                    may |= set(own[begin:end])
                    if words > 50 and other < name:
                        must |= set(own[begin:end])
        left = set(got[name])
        assert not must & left, (name, must & left)
        assert set(own) - left <= may
        assert got[name] == [x for x in own if x in left]


def test_single_lines_count_from_fifty_one_words_on(spark):
    words = [f"s{k}" for k in range(51)]
    rows = [(k, f"own {k}\n" + " ".join(words[:50 + k // 2]) + f"\nend {k}") for k in range(4)]
    got = cut(spark, rows)
    assert [got[k]["_n_removed"] for k in range(4)] == [0, 0, 0, 1]
    assert got[3].text == "own 3\nend 3"


def test_columns_may_have_any_names(spark):
    passage = prose(1, 60)
    names = ["hash", "spans", "_hash", "_spans", "_doc_id", "row_key", "_n_lines", "n_removed", "c0", "a b"]
    frame = docs(spark, [(1, passage), (2, passage + "\nmore"), (3, None)])
    for k, name in enumerate(names):
        frame = frame.withColumn(name, F.lit(k))
    out = line_dedup.without_repeats(frame)
    assert out.columns == frame.columns and out.dtypes == frame.dtypes
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in (1, 2, 3)] == [passage, "more", None]
    assert all(got[i][name] == k for i in got for k, name in enumerate(names))
    both = line_dedup.dedup_lines(frame)
    assert both.columns == [*frame.columns, "_n_lines", "_n_removed"] and both.count() == 3


def test_rows_that_lost_nearly_all_their_words_may_go(spark):
    passage = prose(1, 60)
    rows = [(1, passage), (2, passage), (3, passage + "\n" + prose(2, 9, line=9)), (4, passage + "\n" + prose(3, 10, line=5)),
            (5, "few words"), (6, ""), (7, None)]
    out = line_dedup.without_repeats(docs(spark, rows), least_words=10)
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 5, 6, 7]
