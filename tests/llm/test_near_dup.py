"""Order MinHash classes against all pairs by brute force."""

import random

import numpy as np
import pyarrow as pa
from data import docs, edited, odd_rows, prose

from boardwalk.llm import near_dup
from boardwalk.llm.common import text_parts


def sequences(texts):
    return [s for _, _, part in text_parts(pa.array(texts)) for s in near_dup.shingles(part)]


def lcs(x, y):
    row = np.zeros(len(y) + 1, int)
    for a in x:
        old, row = row, row.copy()
        for j, b in enumerate(y):
            row[j + 1] = old[j] + 1 if a == b else max(old[j + 1], row[j])
    return int(row[-1])


def brute_classes(rows):
    own = dict(zip([i for i, _ in rows], sequences([t for _, t in rows])))
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in own:
        for b in own:
            if a < b and len(own[a]) and len(own[b]):
                s = lcs(own[a].tolist(), own[b].tolist())
                if s >= 0.8 * (len(own[a]) + len(own[b]) - s):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in own}


def test_banded_alignment_is_the_longest_common_subsequence_where_it_links():
    draw = random.Random(1)
    for _ in range(200):
        x = [draw.randrange(30) for _ in range(draw.randrange(1, 60))]
        y = list(x)
        for _ in range(draw.randrange(0, 8)):
            k = draw.randrange(len(y) + 1)
            y[k:k + draw.randrange(2)] = [draw.randrange(30)] * draw.randrange(2)
        true = lcs(x, y)
        banded = near_dup.matched(np.array(x, np.uint64), np.array(y, np.uint64))
        assert banded <= true
        if 9 * true >= 4 * (len(x) + len(y)):
            assert banded == true


def test_order_counts():
    a = [prose(k, 40) for k in range(8)]
    x, y = sequences(["\n".join(a), "\n".join(a[::-1])])
    assert len(np.setxor1d(x, y)) * 9 <= len(x) + len(y) + 9 * 70
    assert not near_dup.linked(x, y)


def test_classes_match_brute_force_in_small_and_large_buckets(spark):
    base = prose(3, 150)
    # distances around the threshold from a common origin, some sharing edits that the origin lacks
    rows = [(0, base)] + [(k, edited(base, k, k % 9)) for k in range(1, 28)]
    far = edited(base, 1000, 4)
    rows += [(100 + k, edited(far, 2000 + k, k % 3)) for k in range(8)]
    # shorter ones than the origin
    rows += [(120 + k, edited(base, 3000 + k, k % 5).rsplit(" ", 1 + k % 12)[0]) for k in range(10)]
    rows += [(200 + k, prose(500 + k, 80)) for k in range(6)] + [(300, prose(500, 80))]
    expected = brute_classes(rows)
    for small in (3, 16):
        got = {r.doc_id: r.class_id for r in near_dup.classes(docs(spark, rows), small=small).collect()}
        assert got == expected


def test_odd_rows(spark):
    got = near_dup.classes(docs(spark, odd_rows(), extra="class_id")).collect()
    assert len(got) == len(odd_rows())
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.class_id, r.kept))
    assert by_id[None] == [(None, True)] * 2
    for alone in (1, 2, 3, 9):
        assert by_id[alone] == [(alone, True)]
    assert by_id[5] == [(4, False)] and by_id[7] == [(6, False)] and by_id[8] == [(8, True)] * 2
    assert near_dup.classes(docs(spark, [])).collect() == []


def test_keep_one_returns_its_columns(spark):
    table = docs(spark, odd_rows(), extra="kept")
    kept = near_dup.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "None", "1", "2", "3", "4", "6", "8", "9"])


def test_short_texts_link_as_by_brute_force(spark):
    draw = random.Random(4)
    texts = []
    for k in range(40):
        for size in (7, 8, 9, 10, 11):
            words = [f"w{draw.randrange(10 ** 6)}" for _ in range(size)]
            texts += [words, [*words, "behind"] if k % 2 else ["before", *words]]
    # a crowd around one text, whose members link with nothing else
    words = [f"c{j}" for j in range(8)]
    texts += [words] + [[f"b{j}", *words] for j in range(30)] + [[*words, f"e{j}"] for j in range(30)]
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    sizes = [len(words) for words in texts]
    truth = brute_classes(rows)
    assert {(sizes[k], sizes[k - 1]) for k in range(1, 400, 2) if truth[k] == truth[k - 1]} == {(9, 8), (10, 9), (11, 10), (12, 11)}
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs(spark, rows)).collect()}
    assert got == truth


def test_members_are_not_dealt_by_what_no_other_text_holds(spark, monkeypatch):
    """Far copies of one text: what each has of its own is no key, and dealt leaders are not dealt again."""
    base = prose(7, 150)
    rows = [(0, base)] + [(k, edited(base, k, 6)) for k in range(1, 40)] + [(100 + k, edited(base, 900 + k, 2)) for k in range(6)]
    dealt = []
    by_difference = near_dup._by_difference

    def seen(placed, number):
        dealt.append(placed.selectExpr("sum(size(added)) AS n", "count(*) AS c").first())
        out = by_difference(placed, number)
        # a leader without a new member has no part in this round
        assert by_difference(placed.filter(f"round < {number}"), number).isEmpty()
        return out

    monkeypatch.setattr(near_dup, "_by_difference", seen)
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs(spark, rows), small=1).collect()}
    assert got == brute_classes(rows)
    # a member has some 60 shingles the leader lacks, of which 37 are in the prefix
    assert dealt and sum(d.n or 0 for d in dealt) <= 20 * sum(d.c for d in dealt)


def test_buckets_with_the_same_members_are_one(spark):
    rows = [(key, i, 20, i) for key in range(50) for i in (1, 2, 3)] + [(60, 1, 20, 1), (60, 4, 20, 4)]
    buckets = spark.createDataFrame(rows, "key long, id long, n long, root long")
    stored, seen = near_dup.stored, []
    near_dup.stored = lambda df: seen.append(stored(df)) or seen[-1]
    try:
        pairs = {(r.a, r.b) for r in near_dup._candidates(buckets, 8).collect()}
    finally:
        near_dup.stored = stored
    assert pairs == {(1, 2), (1, 3), (2, 3), (1, 4)}
    assert seen[0].count() == 5


def test_differences_are_exact_values():
    counts = np.full(near_dup.SLOTS, 9, np.uint8)
    leader = np.arange(100, dtype=np.uint64) + np.uint64(2**63)
    for kept in (40, 98):  # far from the leader, and near enough to be the same in another order
        own = np.append(leader[:kept], np.arange(100 - kept, dtype=np.uint64) + np.uint64(2**62 + 1))
        added, _ = near_dup.differences(leader, own, False, 80, counts)
        assert set(added.tolist()) - {near_dup._REORDERED} <= set(own[kept:].tolist())


def test_texts_that_may_link_share_a_rare_key_within_each_others_reach():
    draw = random.Random(6)
    common = {v: 2 + v % 50 for v in range(2000)}
    keys = lambda own: dict(zip(*(a.tolist() for a in near_dup.rare_keys(
        np.array(own, np.uint64), np.array([common[v] for v in own])))))
    close = 0
    for _ in range(3000):
        x = draw.sample(range(2000), draw.randrange(1, 120))
        left = draw.sample(x, len(x) - draw.randrange(len(x) // 4 + 1))
        y = left + draw.sample([v for v in range(2000) if v not in x], draw.randrange(len(x) // 8 + 1))
        if y and 9 * len({*x} & {*y}) >= 4 * (len(x) + len(y)):
            close += 1
            a, b = keys(x), keys(y)
            assert any(a[k] >= len(y) and b[k] >= len(x) for k in a.keys() & b.keys())
    assert close > 300
    # a text whose own shingles take most of its prefix cannot link with texts of its size
    own = list(range(146))
    common |= {v: 1 for v in range(18)}
    assert max(keys(own).values()) < 143


def test_far_copies_of_one_size_are_not_dealt(spark):
    """Copies of one text, each with edits of its own that keep it apart from all others."""
    base = prose(11, 150, vocabulary=3000)
    own = [(k, edited(base, 50 + k, 7)) for k in range(40)]
    texts = spark.createDataFrame([(i, t, True) for i, t in own], "id long, text string, open boolean")
    roots = spark.createDataFrame([], "id long, root long")
    assert len(set(brute_classes(own).values())) == 40
    assert near_dup._by_rarity(texts, near_dup._counts(texts), roots).count() <= 40


def test_texts_that_may_link_share_a_difference_within_each_others_bounds():
    draw = random.Random(8)
    counts = np.full(near_dup.SLOTS, 9, np.uint8)
    leader = list(range(200))

    def keys(own):
        added, added_at, missing, missing_at = near_dup.placed_differences(
            np.array(leader, np.uint64), np.array(own, np.uint64), False, 0, counts)
        n = len(own)
        return ({v: (-(-4 * n // 5), (5 * n - 9 * p) // 4) for v, p in zip(added.tolist(), added_at.tolist()) if v}
                | {("missing", v): (-(-(4 * n + 9 * p) // 5), 5 * n // 4) for v, p in zip(missing.tolist(), missing_at.tolist())})

    close = 0
    for _ in range(1500):
        x = draw.sample(range(200), draw.randrange(100, 150)) + draw.sample(range(300, 2000), draw.randrange(30, 90))
        left = draw.sample(x, len(x) - draw.randrange(len(x) // 8))
        y = left + draw.sample([v for v in range(2000) if v not in x], draw.randrange(len(x) // 8))
        if 9 * len({*x} & {*y}) >= 4 * (len(x) + len(y)):
            close += 1
            a, b = keys(x), keys(y)
            assert any(a[k][0] <= len(y) <= a[k][1] and b[k][0] <= len(x) <= b[k][1] for k in a.keys() & b.keys())
    assert close > 300


def test_pairs_beyond_the_bounds_of_all_their_keys_are_not_verified(spark):
    """30 texts share 40 keys, so far behind in their order that none can link; 3 share a near one besides."""
    rows = [(key, i, 100, 97, 80, i) for key in range(40) for i in range(30)] + [(90, i, 100, 110, 80, i) for i in range(3)]
    # buckets with the same members are one, with the widest bounds of any
    rows += [(key, i, 100, 97 if key == 95 else 110, 80, i) for key in (95, 96) for i in (50, 51)]
    buckets = spark.createDataFrame(rows, "key long, id long, n long, reach long, least long, root long")
    assert {(r.a, r.b) for r in near_dup._candidates(buckets, 40).collect()} == {(0, 1), (0, 2), (1, 2), (50, 51)}
    assert near_dup._candidates(buckets.drop("reach", "least"), 40).count() == 30 * 29 / 2 + 1
