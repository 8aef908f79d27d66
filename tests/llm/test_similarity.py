import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelens.llm import embedding_dedup as E, jaccard_join as J, suffix_dedup as D
from tests.llm.helpers import documents, odd_rows, words


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_jaccard(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    label = components(links, {i for i, _ in rows if i is not None})
    return sorted(((i, len(s), label.get(i)) for i, s in sets), key=repr)


def edited(seed, text, n):
    rnd = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(w)


def family_rows():
    """Groups of edited copies around the threshold, a passage in many documents, short documents."""
    rows = odd_rows()
    for g in range(4):
        base = " ".join(words(100 + g, 60 + 90 * g))
        rows += [(100 + 40 * g + k, edited(g * 100 + k, base, k % 7)) for k in range(30)]
    passage = " ".join(words(200, 40))
    rows += [(400 + k, " ".join(words(300 + k, 20 + k)) + " " + passage) for k in range(40)]
    rows += [(500 + k, " ".join(words(7, 8)[: 3 + k % 6])) for k in range(20)]
    return rows


def test_jaccard_join_hot_sets(spark, monkeypatch):
    """Sets of more than SPREAD rows, some of one doc_id, are dealt among tasks and keep their component."""
    monkeypatch.setattr(J, "SPREAD", 3)
    near = " ".join(words(900, 80))
    rows = family_rows() + [(700 + k, near) for k in range(20)] + [(650, edited(1, near, 1)), (None, near), (720, near), (720, near), (720, "alone in here")]
    out = J.similar_documents(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute_jaccard(rows)
    assert {r.component_id for r in out if r.doc_id is not None and 700 <= r.doc_id < 720} == {650}


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = family_rows()
    got = J.similar_documents(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_jaccard(rows)


def test_jaccard_join_without_broadcast_and_empty(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    rows = family_rows()[:60]
    got = J.similar_documents(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_jaccard(rows)
    assert J.similar_documents(documents(spark, rows).limit(0)).count() == 0


def test_crowded_sets_meet(spark, monkeypatch):
    monkeypatch.setattr(J.Bands, "blocks", lambda self, band: 2)  # so few blocks that sets crowd
    rows = family_rows()[:80]
    got = J.similar_documents(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_jaccard(rows)


def test_parity_distance_is_a_lower_bound():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        pool = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
        x, y = np.unique(pool[: rnd.integers(1, 200)]), np.unique(pool[rnd.integers(0, 100) :])
        d = J.distance(np.frombuffer(J.parity(x), np.uint8), np.frombuffer(J.parity(y), np.uint8))
        assert d <= len(np.setxor1d(x, y))


def brute_removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        if (i, b) in out:
            continue
        cover, own = bytearray(len(b)), []
        for q in range(len(b) - length + 1):
            g = b[q : q + length]
            if g in seen or g in own:
                cover[q : q + length] = b"\1" * length
            else:
                own.append(g)
        seen.update(own)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i, b] = (i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return sorted((out[i, (t or "").encode()] for i, t in rows), key=repr)


def test_suffix_dedup(spark):
    rnd = random.Random(8)
    rows = [r for r in odd_rows() if r[0] is not None] + [(None, " ".join(words(1, 120)))]
    base = " ".join(words(50, 300))
    for k in range(25):
        a, b = sorted(rnd.sample(range(len(base)), 2))
        rows.append((600 + k, " ".join(words(60 + k, rnd.randint(0, 30))) + base[a:b] + " ".join(words(90 + k, rnd.randint(0, 30)))))
    rows += [(700, "ab" * 400), (701, "ba" * 90), (702, base[:99]), (703, base[:100])]
    got = D.remove_repeats(documents(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_removed(rows, 100)
    assert D.remove_repeats(documents(spark, rows).limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("leaf", F.lit(1)).withColumn("rep", F.lit(2))


def brute_links(rows):
    good = {(i, tuple(np.float32(v).tolist()), y) for i, v, y in rows if i is not None and y is not None and v and all(c is not None and np.isfinite(np.float32(c)) for c in v) and any(v)}
    good = sorted(good)
    x = [np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum()) for _, v, _ in good]
    links = [(a, b) for a in range(len(good)) for b in range(a) if good[a][2] == good[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.98]
    n = {k: 0 for k in range(len(good))}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    label = components([(good[a][0], good[b][0]) for a, b in links], {g[0] for g in good})
    by = {g[0]: (n[k], label[g[0]]) for k, g in enumerate(good)}
    return by


@pytest.mark.parametrize("kw", [{}, {"leaf": 64, "block": 16}, {"leaf": 16, "sample": 40, "block": 16}])
def test_embedding_dedup_recall(spark, monkeypatch, kw):
    if "sample" in kw:
        monkeypatch.setattr(E, "BROADCAST_LEAVES", 0)
    rnd = np.random.default_rng(4)
    rows = []
    for g in range(60):
        c = rnd.standard_normal(32)
        for k in range(rnd.integers(1, 12)):
            rows.append((len(rows), (c + rnd.standard_normal(32) * 0.12 * rnd.random()).astype(np.float32).tolist(), g % 3))
    hot = rnd.standard_normal(32).astype(np.float32).tolist()
    rows += [(1000 + k, hot, 1) for k in range(40)] + [(1000, hot, 1)]
    rows += [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [None] + [1.0] * 31, 1), (2003, [float("nan")] * 32, 1), (2004, [], 0), (2005, hot, None), (None, hot, 1), (2006, hot[:16], 1)]
    want = brute_links(rows)
    got = E.near_duplicates(vectors(spark, rows), **kw).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got if r.vec_id in want)
    total = sum(want[r.vec_id][0] for r in got if r.vec_id in want)
    assert all(r.n_links <= want[r.vec_id][0] for r in got if r.vec_id in want) and found >= 0.99 * total
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        elif r.vec_id not in want:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert r.kept == (r.vec_id == r.component_id)
    assert E.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_large_leaves_are_split_over_all_rows(spark):
    rnd = np.random.default_rng(5)
    x = rnd.standard_normal((3000, 32))
    near = rnd.standard_normal(32) + rnd.standard_normal((300, 32)) * 0.01  # too close to part
    first, second = 1 << 32, (1 << 32) + 1
    rows = [(0, first, k, 1, v.tolist(), [first]) for k, v in enumerate(x)] + [(1, second, 9000 + k, 1, v.tolist(), [second]) for k, v in enumerate(near)]
    placed = spark.createDataFrame(rows, "label long, leaf long, rep long, mult long, embedding array<float>, leaves array<long>")
    got = E.split(placed, 32, 100, 0.98).select("label", "leaf", "rep", "leaves").collect()
    of, members = {}, {}
    for r in got:
        of.setdefault(r.rep, []).append(r.leaf)
        members.setdefault((r.label, r.leaf), []).append(r.rep)
    assert sorted(of) == sorted([*range(3000), *range(9000, 9300)])
    assert all(sorted(r.leaves) == sorted(of[r.rep]) == sorted(set(of[r.rep])) for r in got)
    assert sorted(members.pop((1, second))) == list(range(9000, 9300)) and all(k[0] == 0 for k in members)
    assert max(map(len, members.values())) <= 200
