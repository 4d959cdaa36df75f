import random
from collections import Counter

import numpy as np
import pytest

from loomlake.llm import graph, jaccard, suffix
from loomlake.llm.embeddings import near_vectors

WORDS = [f"w{i}" for i in range(400)]


def closure(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        while root[root[i]] != root[i]:
            root[i] = root[root[i]]
    return root


def corpus(seed=1, groups=14, size=9):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, size)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            texts.append(" ".join(t))
    texts += ["", None, "  ", "One two", "one TWO", "three", "a b c d e", texts[0]]
    return texts


def shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def test_jaccard_matches_brute_force(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    count, root = Counter(x for p in links for x in p), closure(len(sets), links)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n string, root string")
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(df).collect()}
    assert {i: (r["n_links"], r["class_id"], r["kept"]) for i, r in got.items()} == {i: (count[i], root[i], root[i] == i) for i in range(len(sets))}
    assert all(sets[r["copy_id"]] == sets[i] for i, r in got.items())


def test_jaccard_crowd_is_tiled(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(200)]
    texts = []
    for i in range(90):
        t = list(base)
        t[rng.randrange(200)] = f"n{i}"
        texts.append(" ".join(t))
    monkeypatch.setattr(jaccard, "TILE", 16)
    got = jaccard.jaccard_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [shingles(t) for t in texts]
    want = {i: sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for s in sets) - 1 for i in range(90)}
    assert {r["doc_id"]: r["n_links"] for r in got} == want and {r["class_id"] for r in got} == {0}


def test_jaccard_empty_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_classes(none).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, "z"), (None, "z")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_links"]) for r in jaccard.jaccard_classes(df).collect()) == [(1, 2), (1, 2), (2, 2), (3, 0)]
    assert sorted(r["doc_id"] for r in jaccard.drop_near_copies(df.filter("doc_id is not null")).collect()) == [1, 3]


def test_near_copies_of_one_id(spark):
    """Of rows with one doc_id only those go whose own text is a near copy."""
    x, y = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [("s", 3, x), ("t", 5, x), ("u", 5, y), ("v", 5, None), ("w", 7, y), ("z", 8, x)]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string")
    left = jaccard.drop_near_copies(df)
    assert left.columns == df.columns and sorted(tuple(r) for r in left.collect()) == [rows[0], rows[2], rows[3]]
    near = y.split()
    near[3] = "other"
    odd = [(1, y, {"a": 1}, 5), (1, " ".join(near), {"a": 2}, 6), (1, x, None, 7), (1, x, {"b": 3}, 8), (2, x, {}, 9), (None, x, {}, 1), (3, None, {}, 2), (3, "", {}, 3)]
    got = jaccard.drop_near_copies(spark.createDataFrame(odd, "doc_id long, text string, cls map<string,int>, root int"))
    out = sorted(r["root"] for r in got.collect())
    assert got.columns == ["doc_id", "text", "cls", "root"] and out in ([1, 2, 3, a, b] for a in (5, 6) for b in (7, 8))
    assert jaccard.drop_near_copies(df.limit(0)).count() == 0


def test_posterior_never_drops_likely_pairs():
    least = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(0)
    hits = (rng.random((20000, jaccard.HASHES)) < 0.8).cumsum(axis=1)
    assert all((hits[:, n - 1] >= m).mean() > 0.9995 for n, m in least.items())


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, x) for x in range(501, 560)]
    root = closure(600, links)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links + links[:9], "u long, v long")).collect()}
    assert got == {i: root[i] for i in {x for p in links for x in p if p[0] != p[1]}}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed,tile", [(0, 32), (1, 8), (2, 4096)])
def test_vectors_match_brute_force(spark, seed, tile):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((40, 24))
    rows = []
    for i in range(260):
        v = base[rng.integers(40)] + rng.standard_normal(24) * rng.choice([0, 0.02, 0.05, 0.12])
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 3)], int(rng.integers(3))))
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, rows[0][1], None), (304, rows[0][1], rows[0][2]), (305, [1.0, None], 1), (306, [1.0, 0.0], 1), (307, [2.0, 0.0], 1), (308, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    at = {r[0]: i for i, r in enumerate(good)}
    unit = [np.array(r[1], np.float32).astype(float) for r in good]
    links = [(i, j) for i in range(len(good)) for j in range(i) if good[i][2] == good[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98 * np.linalg.norm(unit[i]) * np.linalg.norm(unit[j])]
    count, root = Counter(x for p in links for x in p), closure(len(good), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, tile=tile).collect()}
    want = {r[0]: (count[at[r[0]]], good[root[at[r[0]]]][0], good[root[at[r[0]]]][0] == r[0]) if r[0] in at else (0, r[0], True) for r in rows}
    assert got == want and len(links) > 50
    assert near_vectors(df.limit(0)).count() == 0


def repeats(texts, length=50):
    """(removed bytes, spans, kept) by the plain definition; texts: (doc_id, text)."""
    data = [(i, (t or "").encode()) for i, t in texts]
    first = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), b"".join(b[k : k + 1] for k in range(len(b)) if not gone[k])))
    return out


@pytest.mark.parametrize("pieces", [{}, {"size": 200, "piece": 300}])
def test_suffix_matches_brute_force(spark, pieces):
    import hashlib

    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 80, 200, 700)]
    rows = []
    for i in range(40):
        t = say(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            t += rng.choice(shared) + say(rng.randint(0, 60))
        rows.append((i * 3, t))
    rows += [(200, None), (201, ""), (202, "x" * 5000), (203, "x" * 4000), (204, rows[3][1] + "!"), (9, rows[0][1]), (9, shared[4]), (9, shared[4])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, doc int")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.dedup_report(df, **pieces).collect())
    assert got == sorted((i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in repeats(rows))
    kept = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    left = sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in suffix.drop_repeats(kept).collect() if r["text"] is not None)
    assert all(n == len(t) for _, t, n in left) and len(left) == len(rows) - 1
    assert suffix.dedup_report(df.limit(0)).count() == 0


def test_suffix_keeps_all_columns_and_rows_without_id(spark):
    """Names that a join might use, null ids, a null text and repeated rows: nothing of them changes or goes."""
    t = "".join(random.Random(3).choice("abcdefg ") for _ in range(90))
    rows = [(1, None, 7, {"a": 1}, 5, t), (1, None, 7, {"a": 1}, 5, t), (None, 3, 8, None, 6, t), (4, 4, 9, {}, 7, t + "é"), (5, 5, 5, None, 8, None)]
    df = spark.createDataFrame(rows, "doc_id long, block long, _key int, spans map<string,int>, data int, text string")
    got = suffix.drop_repeats(df)
    assert got.columns == df.columns and got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [*rows[:3], (4, 4, 9, {}, 7, "é"), rows[4]]))
    assert suffix.drop_repeats(df.limit(0)).count() == 0


def test_suffix_in_a_text_of_over_16_mib(spark):
    rng = np.random.default_rng(9)
    say = lambda n: rng.integers(97, 123, n, np.uint8).tobytes().decode()
    passages = [say(int(n)) for n in rng.integers(50, 81, 300)]
    short = "".join(p + say(20) for p in passages)
    head = say((1 << 24) - 5000)
    long = head + "".join(say(40) + p for p in passages) + say(100)
    df = spark.createDataFrame([(1, short), (2, long)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix.dedup_report(df).collect()}
    starts = {short[p : p + 50] for p in range(len(short) - 49)}
    gone = np.zeros(len(long), bool)
    for p in range(len(head) - 49, len(long) - 49):
        if long[p : p + 50] in starts:
            gone[p : p + 50] = True
    assert got == {1: 0, 2: int(gone.sum())} and gone.sum() >= sum(map(len, passages))


def test_chiefs_in_blocks(monkeypatch):
    name = np.random.default_rng(4).integers(0, 1 << 64, 1000, np.uint64)
    name[100:400] = name[100]
    monkeypatch.setattr(suffix, "PLACE", 6)
    want = [p + int(np.argmin(name[p : p + 26] >> np.uint64(6))) for p in range(975)]
    assert suffix.chiefs(name, 26).tolist() == want


@pytest.mark.parametrize("shared", [False, True])
def test_runs_in_any_order(shared):
    rng = np.random.default_rng(2)
    key, doc = rng.integers(0, 50, 3000).astype(np.uint64), rng.integers(0, 40, 3000)
    key[2900:] = np.arange(1000, 1100)
    runs, got = suffix.Runs(1, shared), []
    for at in range(0, 3000, 171):
        cols = [key[at : at + 171], doc[at : at + 171], np.zeros(len(key[at : at + 171]), np.int32), np.arange(at, min(3000, at + 171))]
        for out in runs.add(cols):
            got += out[1].tolist()
        for out in runs.sort():
            got += out[1].tolist()
    least = {k: doc[key == k].min() for k in set(key)}
    want = [i for i in range(3000) if (len(set(doc[key == key[i]])) > 1 if shared else doc[i] > least[key[i]])]
    assert sorted(got) == want


def test_packing_of_columns():
    cols = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.arange(5, dtype=np.int32) - 2, np.array([-(1 << 63), (1 << 63) - 1, 0, -7, 7])]
    back = suffix.unpacked(suffix.packed(cols), 5, [np.uint64, np.int32, np.int64])
    assert all((a == b).all() for a, b in zip(cols, back, strict=True))


def test_vectors_keep_labels_as_they_are(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1.2), (2, v, 1.7), (3, v, 1.2)]
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")).collect()}
    assert got == {1: 1, 2: 0, 3: 1}
    names = [(1, v, "a"), (2, v, "b"), (3, v, "a"), (4, v, "")]
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(spark.createDataFrame(names, "vec_id long, embedding array<float>, label string")).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0}


def test_vector_join_prunes():
    """Comparisons over all blocks, of random vectors in one task: well below all pairs, and fewer than n to the power 1.5 more."""
    from loomlake.llm import embeddings as E

    done = []
    for n in (1000, 4000):
        x = np.random.default_rng(1).standard_normal((n, 64))
        ids, one = np.arange(n), np.zeros(n, np.int64)
        done.append(sum(E.join_group(k, (0, 0), one, one == 0, ids, x, 0.98, 0.04, 4)[2] for k in range(4)))
    assert done[1] < 0.1 * 4000 * 3999 / 2 and done[1] < 8 * done[0]


def test_leaves_hold_all_near_pairs():
    from loomlake.llm import embeddings as E

    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[300:] = x[:300] + rng.standard_normal((300, 8)) * 0.1
    tree, depth = E.split_tree(x[:200], 6), rng.integers(0, 2, 600) * 6
    depth[300:] = depth[:300]
    row, leaf, home = E.visits(x, tree, depth, 0.09)
    assert sorted(row[home]) == list(range(600))
    at = {int(r): int(w) for r, w in zip(row[home], leaf[home], strict=True)}
    seen = set(zip(row.tolist(), leaf.tolist(), strict=True))
    near = [(i, j) for i in range(600) for j in range(600) if depth[i] == depth[j] and ((x[i] - x[j]) ** 2).sum() <= 0.09]
    assert len(near) > 700 and all((i, at[j]) in seen for i, j in near) and len(row) < 600 * 20


def test_texts_of_megabytes(spark):
    """Two near copies of some 3 MB, and one text of 2 MB alone, in the near-copy, toxicity and fingerprint operators."""
    from loomlake.llm import fingerprint, toxicity

    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400_000)]
    other = list(words)
    for _ in range(2000):
        other[rng.randrange(len(other))] = "changed"
    texts = [" ".join(words), " ".join(other), "z. " * 700_000 + "you grobble. " + "z. " * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.jaccard_classes(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2)}
    model = toxicity.Model(-20.0, {"grobble": 23.0})
    scored = {r["doc_id"]: r for r in toxicity.score_documents(df, model).collect()}
    assert scored[2]["predicted"] == 1 and "grobble" in texts[2][scored[2]["worst_start"] : scored[2]["worst_stop"]] and scored[0]["predicted"] == 0
    assert [r["doc_id"] for r in toxicity.drop_toxic(df, model).orderBy("doc_id").collect()] == [0, 1]
    prints = {r["doc_id"]: r for r in fingerprint.compare_edited(df).collect()}
    assert prints[0]["near_next"] > 0.9 and prints[0]["n_chars"] == len(texts[0]) and prints[1]["near_next"] < 0.1


def test_repetitive_texts(spark):
    """Texts that repeat within themselves cost few rows and give what brute force gives; 20 MB of one letter and of one line stay small."""
    import hashlib
    import resource

    import pyarrow as pa

    from loomlake.llm import suffix

    texts = ["a" * 400, "b" * 60 + "a" * 300, "ab" * 150, "x" + "ab" * 100 + "a" * 49, "one line of text that comes again and again\n" * 12, "again\n" + "one line of text that comes again and again\n" * 3, "", "a" * 49, "c" + "a" * 50]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts)]
    got = suffix.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in repeats(rows))
    rank, live = np.array([7, 7, 7, 8, 8, 7, 7, 7], np.uint64), np.array([1, 1, 1, 1, 0, 1, 1, 1], bool)
    assert [x.tolist() for x in suffix.stretched(rank, live, np.array([0, 2, 6]))] == [[0, 2, 3, 5, 6], [2, 1, 1, 1, 2]]
    assert [x.tolist() for x in suffix.stretched(np.zeros(10_000, np.uint64), np.ones(10_000, bool), np.array([0]))] == [[0, 4095, 8190], [4095, 4095, 1810]]
    big = spark.sql("select 1L as doc_id, repeat('a', 20000000) as text union all select 2L, repeat('a', 60) union all select 3L, repeat('a line of some fifty bytes that is there very often\\n', 400000) union all select 4L, 'a line of some fifty bytes that is there very often\\na line'")
    out = {r["doc_id"]: r for r in suffix.dedup_report(big).collect()}
    assert (out[1]["n_removed"], out[2]["n_removed"], out[3]["n_removed"], out[4]["n_removed"]) == (0, 60, 0, out[4]["n_bytes"])

    def peak(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], names=["mb"])

    found = max(r["mb"] for r in spark.range(0, 64, 1, 64).mapInArrow(peak, "mb long").collect())
    assert found < 1000, found
