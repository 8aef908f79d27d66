"""Spelling variants, archives and manifests against brute force, and their odd cases."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations, groupby, pairwise

import pytest

from placelens.llm import merkle_manifest, queries, spelling_variants, warc_archive
from tests.llm.helpers import documents, odd_rows

LOWER = {65 + k: 97 + k for k in range(26)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def variants(rows, least=5, count=3, ratio=2):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                seen[run] += 1
    n = {w: k for w, k in seen.items() if k >= count}
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: b if b and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def misspelt(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abéñx") for _ in range(rnd.randint(5, 8))) for _ in range(25)]
    rows = []
    for k in range(n):
        word = list(base[min(24, int(rnd.paretovariate(0.7)) - 1)])
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(word))
            word[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "É", "X", "b"])
        rows.append((k % 40 if k % 11 else None, "".join(word) + rnd.choice([" ", "1", "\n"]) + "".join(word)))
    return rows


@pytest.mark.parametrize("rows", [odd_rows(), misspelt(1, 400), misspelt(2, 400)], ids=["odd", "few letters", "again"])
def test_variants_are_those_of_all_pairs(spark, rows):
    got = spelling_variants.spelling_variants(documents(spark, rows)).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == variants(rows)


@pytest.mark.parametrize("replaced", [(2, 1, 3), (2, 1, 6), (2, 2, 2), (2, 2, 4), (2, 3, 1), (2, 3, 2)])
def test_every_choice_of_parts_finds_all_pairs(replaced):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("aabcdé") for _ in range(rnd.randint(5, 7))) for _ in range(250)})
    every = spelling_variants.keys(words, spelling_variants.Scheme(*replaced), spelling_variants.Scheme(1, 1, 2))
    met = set()
    for role, of in ((2, 2), (0, 1)):
        a = {(k, w) for r, key in every if r == role for k, w in zip(key.tolist(), words)}
        b = {(k, w) for r, key in every if r == of for k, w in zip(key.tolist(), words)}
        by_key = {}
        for k, w in b:
            by_key.setdefault(k, []).append(w)
        met |= {tuple(sorted((w, o))) for k, w in a for o in by_key.get(k, ()) if one_edit(w, o)}
    assert met == {p for p in combinations(words, 2) if one_edit(*p)}


def test_scheme_needs_more_subparts_than_a_part_may_differ_in():
    with pytest.raises(ValueError):
        spelling_variants.Scheme(2, 1, 2).signatures()


def test_links_are_followed_to_the_last(spark):
    forms = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "d"), ("g", None)], "word string, form string")
    assert {r.word: r.root for r in spelling_variants.with_roots(forms).collect()} == dict.fromkeys("abcdef", "a") | {"g": "g"}


def test_words_are_not_broadcast(spark, monkeypatch):
    """Small files of words may hold millions of signatures, which the driver cannot gather."""
    plans, met = [], spelling_variants.materialize
    monkeypatch.setattr(spelling_variants, "materialize", lambda df, tag: (plans.append(df), met(df, tag))[1])
    plans.append(spelling_variants.spelling_variants(documents(spark, misspelt(1, 400))))
    every = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert sum("SortMergeJoin" in p for p in every) >= 3 and not any("Broadcast" in p for p in every)


def test_no_documents_no_variants(spark):
    assert spelling_variants.spelling_variants(documents(spark, [])).collect() == []


PAGES = "page_id long, url string, html string, payload string, first long, run string"


def pages(spark, rows):
    """Pages with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], PAGES)


ODD_PAGES = [
    (1, "http://A.b/x", "hi"), (2, "http://a.B/x#f", "hi"), (2, "http://a.b/y?q", ""), (None, None, None), (3, "nourl\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\r\n"),
    (4, "http://é.com", "hi"), (4, "http://é.com", "hi"), (0, "http://z", "ü" * 50_000), (5, "http://a.b/x", None), (None, "http://a.b/x", "hi"), (6, "", "\x00"), (7, "http://q/", "lone"),
]


def expected_pages(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        one = first.get(html or "")
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page, len(body), digest, "response" if one == page else "revisit", None if one == page else one))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("archive_bytes", "range_rows", "compression"), [(16_000_000, 200_000, "none"), (700, 2, "gzip"), (1, 1, "none")])
def test_archives_say_what_the_pages_said(spark, archive_bytes, range_rows, compression):
    path = warc_archive.archive_pages(pages(spark, ODD_PAGES).repartition(3), compression=compression, archive_bytes=archive_bytes)
    got = warc_archive.index_of(spark, path, range_rows).orderBy("position").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected_pages(ODD_PAGES)
    assert [r.position for r in got] == list(range(len(ODD_PAGES)))
    keys = [warc_archive.order_of(tuple(r)[1:]) for r in got]
    assert keys == sorted(keys)
    files = {f.path.rpartition("/")[2]: bytes(f.content) for f in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()}
    whole = {k: gzip.decompress(v) if k.endswith(".gz") else v for k, v in files.items()}
    texts = {(page, (html or "").encode()) for page, _, html in ODD_PAGES}
    for r in got:  # offsets and lengths lead to the record
        record = whole[r.archive][r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            assert (r.page_id, record[:-4].split(b"\r\n\r\n", 2)[2]) in texts


@pytest.mark.parametrize("limit", [0, 200_000])
def test_many_payload_groups_join_as_few_do(spark, limit):
    rows = [(k, f"http://h/{k}", f"page {k % 40}" if k % 3 else "hot") for k in range(3000)]
    got = warc_archive.with_first(warc_archive.captures(pages(spark, rows)), broadcast_groups=limit).collect()
    least = {}
    for page, _, html in rows:
        least[html] = min(page, least.get(html, page))
    assert len(got) == len(rows) and all(r["first"] == least[bytes(r.payload).decode()] for r in got)


def test_short_payloads_are_all_responses(spark):
    found = warc_archive.with_first(warc_archive.captures(pages(spark, [(1, "", "ab"), (2, "", "ab"), (3, "", "abc"), (4, "", "abc")])), least_bytes=3)
    assert sorted((r.page_id, r["first"]) for r in found.select("page_id", "first").where("first is not null").collect()) == [(3, 3), (4, 3)]


def test_damage_is_found():
    one = warc_archive.record(1, "http://a", 0, b"payload", hashlib.sha1(b"payload").hexdigest(), None) + warc_archive.END
    assert len(list(warc_archive.captures_of("a", one))) == 1
    for broken in (one.replace(b"payload", b"paYload"), one[:-5], b"x" + one):
        with pytest.raises(ValueError):
            list(warc_archive.captures_of("a", broken))


@pytest.mark.parametrize("lists", [[], [[]], [[1]], [[], [2], []], [[1, 4], [1, 2, 3], [], [0, 9]], [[k % 7 for _ in range(5)] for k in range(23)]])
def test_loser_tree_merges(lists):
    lists = [sorted(x) for x in lists]
    out = [v for k, a, b in warc_archive.LoserTree(lists) for v in lists[k][a:b]]
    assert out == sorted(v for x in lists for v in x)


def test_random_merges():
    rnd = random.Random(3)
    for _ in range(200):
        lists = [sorted(rnd.randrange(30) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(1, 12))]
        got = [(k, x) for k, a, b in warc_archive.LoserTree(lists) for x in lists[k][a:b]]
        assert [x for _, x in got] == sorted(x for part in lists for x in part)


def test_index_is_written_in_order(spark, tmp_path):
    index = warc_archive.index_of(spark, warc_archive.archive_pages(pages(spark, ODD_PAGES)), 3)
    warc_archive.write_index(index, f"{tmp_path}/index", 3)
    lines = [line for f in sorted((tmp_path / "index").glob("part-*")) for line in f.read_text().splitlines()]
    assert [x.split(" ")[0] for x in lines] == [r.url_key for r in index.orderBy("position").collect()]


def test_no_pages_no_archive(spark):
    assert warc_archive.index_of(spark, warc_archive.archive_pages(pages(spark, []))).collect() == []


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(now):
    """Root and, for each leaf, its (run, slot) on the way up."""
    paths, at = [[] for _ in now], list(range(len(now)))
    while len(now) > 1:
        runs = [now[k : k + 16] for k in range(0, len(now), 16)]
        for path, k in zip(paths, at):
            path.append((runs[k // 16], k % 16))
        at, now = [k // 16 for k in at], [H("".join(r)) for r in runs]
    return now[0], paths


def proofs(rows):
    order = sorted((r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r), r) for r in rows)
    trees = [(*tree([x[4] for x in g]), g) for g in (list(g) for _, g in groupby(order, key=lambda x: x[:2]))]
    root, above = tree([sub for sub, _, _ in trees])
    for (sub, paths, group), top in zip(trees, above):
        for x, path in zip(group, paths):
            r = x[5]
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            fold, proof = leaf((*r[:4], r[4].translate(LOWER)) if touched else r), ""
            for run, k in path + top:
                fold = H("".join(run[:k]) + fold + "".join(run[k + 1 :]))
                proof += "".join(run[:k] + run[k + 1 :])
            yield r[0], x[4], sub, root, H(proof), fold, fold == root


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string, level int, slot int, children string"
TABLES = {
    "one": [(1, "a", "en", 3, "Ab")],
    "one source": [(k, "a", "en", k, f"Text {k}") for k in range(300)],
    "lone leaves": [(k, f"s{k}", None, 3, "AB") for k in range(40)],
    "odd": [(1, "a", "en", 3, "Ab")] * 3 + [(None, None, None, None, None), (2, "", "é", 2, ""), (None, "a", "x", 1, "É" * 9000), (5, None, None, -7, None)] + [(k % 9, "hot", "d", k % 4, "T") for k in range(290)],
}


@pytest.mark.parametrize("name", TABLES)
@pytest.mark.parametrize("block", [16, 512])
def test_proofs_are_those_of_the_whole_tree(spark, name, block):
    rows = TABLES[name]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], MANIFEST).repartition(3)
    got = merkle_manifest.manifest(df, block=block)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(proofs(rows), key=repr)


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], MANIFEST)).collect() == []


def test_recursion_limit_is_put_back(spark):
    before = spark.conf.get(merkle_manifest.ROW_LIMIT)
    merkle_manifest.manifest(spark.createDataFrame([(*TABLES["one"][0], 1, 2, "c")], MANIFEST)).collect()
    assert spark.conf.get(merkle_manifest.ROW_LIMIT) == before


def test_equal_rows_number_without_gaps(spark):
    rows = spark.createDataFrame([("a",)] * 500 + [("b",)] * 3 + [(None,)] * 7, "k string").repartition(5)
    got = merkle_manifest.numbered(rows, ["k"], "k").orderBy("number").collect()
    assert [r.number for r in got] == list(range(510)) and [r.k for r in got] == [None] * 7 + ["a"] * 500 + ["b"] * 3
    assert all(b.place == (a.place + 1 if a.k == b.k else 0) for a, b in pairwise(got)) and {(r.k, r.of) for r in got} == {("a", 500), ("b", 3), (None, 7)}


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_warc", "op13_merkle_manifest"])
def test_queries_say_what_sql_says(spark, sf, name):
    import duckdb

    from tests.test_queries import rows

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())

