"""Source divergence, personal data and token alignment against plain definitions."""

import re
from collections import Counter, defaultdict

KINDS = "doc_id long, text string, lang string, source string"


def plain_divergence(rows):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    share = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    for lang in {x for x, _ in groups}:
        kept = sorted(w for w, k in docs[lang].items() if k >= 3)
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        n = {s: sum(c[w] for w in kept) for s, c in mine.items()}
        p = {s: {w: share(c[w], n[s], len(kept)) for w in kept} for s, c in mine.items()}
        whole = sum(mine.values(), Counter())
        q = {w: share(whole[w], sum(n.values()), len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in mine.items():
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), "pair") for t in mine if t != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), "term") for w in kept if c[w] and p[s][w] > q[w]]
            for part in (sorted(pairs), sorted(terms)[:200]):
                out |= {(lang, s, x[2], x[1].decode(), -x[0], k + 1) for k, x in enumerate(part)}
    return out


def divergence(spark, rows):
    from loomlake.llm.divergence import source_divergence

    got = [tuple(r) for r in source_divergence(spark.createDataFrame(rows, KINDS)).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence_of_odd_rows(spark):
    """Nulls, empty texts, groups without terms, ties, repeated rows, other scripts, zero bytes, one source alone."""
    rows = [(1, "A b c", "en", "x"), (2, "a B d", "en", "y"), (3, "a-b_c", "en", "x"), (3, "a-b_c", "en", "x"), (4, None, "en", "z"), (5, "", None, None), (6, "a b", None, "q"), (7, "über é 漢字 a\0b", "de", "x")]
    rows += [(8, "über É é 漢字", "de", "y"), (9, "ÜBER é 漢字 b", "de", "y"), (None, "c c c d d", "en", "z"), (10, "zz zz zz", "fr", "only"), (11, "zz", "fr", "only"), (12, "zz y", "fr", "only"), (13, "a", "e\0n", "a\0"), (14, "!!", "e\0n", "b")]
    rows += [(20 + i, f"t{'abcdefgh'[i % 8]} common", "ties", f"s{i % 3}") for i in range(48)]
    assert divergence(spark, rows) == plain_divergence(rows)
    assert divergence(spark, []) == set()


def test_divergence_over_many_ranges_and_blocks(spark, monkeypatch):
    """Tries that are cut, passed on and merged over and over, sources in several blocks, counts beyond 64 bits of products."""
    import numpy as np
    import pyarrow as pa

    from loomlake.llm import divergence as d

    rows = [(r["doc_id"], r["text"][:3000], r["lang"], r["source"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = plain_divergence(rows)
    assert divergence(spark, rows) == want
    for name, value in (("HELD", 700), ("LEAVES", 37), ("RANGE", 50), ("BLOCK", 3), ("SLICE", 9000), ("PREFIX", 5)):
        monkeypatch.setattr(d, name, value)
    tables = [d.added_up([d.count_terms(["en"] * 3, ["a", "b", "a"], pa.array(["x y longer" + "e" * 50, "x", "z " * k + "longer" + "e" * 60]))]) for k in (1, 2)]
    both = d.Trie.of(d.added_up(tables))
    again = d.Trie.unpack(both.pack())
    assert again.rows().equals(both.rows()) and both.rows().to_pylist()[-1]["count"] == 3
    assert d.share(np.array([1 << 40]), 1 << 41, 5)[0] == 1 + 10**9 * ((1 << 40) + 1) // ((1 << 41) + 5)
    one = [d.count_terms([r[2]], [r[3]], pa.array([r[1]])) for r in rows[:40]]
    held = d.Counting()
    passed = [t for x in one for t in held.add(x)] + list(held.out())
    assert len(passed) > 3 and d.added_up([t.rows() for t in passed]).equals(d.added_up(one))
    assert divergence(spark, rows) == want


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    from loomlake.llm.queries import PIECES, vocabulary

    left = Tokenizer.from_file(vocabulary())
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))


def plain_alignment(rows):
    """Encoded whole by both libraries; overlaps token by token; groups by a walk over the ends."""
    from loomlake.llm.bpe import printable_bytes

    left, right = tokenizers()
    byte_of = printable_bytes()
    spans, counts = [], Counter()
    for doc, text in rows:
        a, b, data = [], [], (" " + (text or "")).encode()
        if text:
            a = left.encode(" " + text, add_special_tokens=False).ids
            b = right.encode(text)
        x = [bytes(byte_of[c] for c in left.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(right.id_to_piece, b)]
        if b"".join(x) != data or b"".join(y) != data:
            spans.append((doc, [], [], [], []))
            continue
        links, groups, i, j, ends = [], [], 0, 0, [0, 0]
        ends = [len(x[0]), len(y[0])]
        now = [[0], [0]]
        while True:
            links.append((a[i], b[j]))
            step = ends[0] <= ends[1], ends[1] <= ends[0]
            if all(step):
                groups.append(now)
                now = [[], []]
            i, j = i + step[0], j + step[1]
            if i == len(x) and j == len(y):
                break
            for k, (n, toks) in enumerate(((i, x), (j, y))):
                if step[k]:
                    ends[k] += len(toks[n])
                    now[k].append(n)
        counts.update(links)
        spans.append((doc, a, b, links, groups))
    top = defaultdict(int)
    for (_, r), n in counts.items():
        top[r] = max(top[r], n)
    out = []
    for doc, a, b, links, groups in spans:
        said = ";".join(",".join(str(a[i]) for i in p) + "|" + ",".join(str(b[j]) for j in q) for p, q in groups)
        sha = __import__("hashlib").sha256(said.encode()).hexdigest() if links else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=repr)


def alignment(spark, rows):
    from loomlake.llm.alignment import align_tokens
    from loomlake.llm.queries import PIECES, vocabulary

    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, block int, pairs string")
    got = align_tokens(df, vocabulary(), vocabulary(PIECES))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_alignment_against_both_libraries(spark, monkeypatch):
    """Nulls, empty, blanks, the model's own mark, special strings, control bytes, other scripts, repeated rows; then real texts in small blocks."""
    from loomlake.llm import alignment as m

    odd = [None, "", " ", "  ", "a", " a", "a ", "a  b   c", "\n\n a\t\tb \n", "x▁y", "<|endoftext|> <s> </s> <unk> <0x41>", "\0\x01\x7f", "漢字かな交じり 👩‍👩‍👧 é ﬁ Ａ", "don't I'll we've 123456 12.5%", "a" * 700, " " * 300, "é" * 300, "-" * 200, "\r\n" * 9]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, "same id"), (3, "same id"), (None, "no id")]
    assert alignment(spark, rows) == plain_alignment(rows)
    assert alignment(spark, []) == []
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = plain_alignment(rows)
    assert alignment(spark, rows) == want
    for name, value in (("BLOCK", 20_000), ("CACHE", 300_000)):
        monkeypatch.setattr(m, name, value)
    assert alignment(spark, rows) == want


def test_alignment_of_segments(monkeypatch):
    """Segments that are encoded apart give the tokens of the whole; union-find gives the same groups as common ends."""
    import numpy as np

    from loomlake.llm import alignment as m
    from loomlake.llm.queries import PIECES, vocabulary

    with open(vocabulary(PIECES), "rb") as f:
        known = m.Aligner(m.read_spec(vocabulary()), f.read())
    left, right = tokenizers()
    texts = ["Thhe  quick, brown\n fox's 12 34 jumps\t  over é漢字. !\x1c x \xa0 y\u2003z\r\n\n q " * 30, "x" * 100_000, "\n" * 5000 + "a\tb", "a ▁b"]
    monkeypatch.setattr(m, "CACHE", 4000)
    for _ in (0, 1):
        for text, (n_a, n_b, *_) in zip(texts, known.align(texts), strict=True):
            segments = m.SEGMENT(" " + text)
            assert "".join(segments) == " " + text
            fine = "▁" not in text
            assert n_a == (len(left.encode(" " + text, add_special_tokens=False).ids) if fine else 0) and n_b == (len(right.encode(text)) if fine else 0)
            if fine:
                assert np.frombuffer(b"".join(known.right.encode(segments)), np.uint32).tolist() == right.encode(text)
        assert len(list(known.align(["other words " + "y" * 9000]))) == 1
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        ends = [np.unique(np.r_[rng.integers(1, 3 * n + 1, n), 3 * n]) for _ in (0, 1)]
        left, right = m.linked(*ends)
        cuts = np.union1d(*ends)
        assert left.tolist() == [int((ends[0] < e).sum()) for e in cuts] and right.tolist() == [int((ends[1] < e).sum()) for e in cuts]
        both = np.isin(cuts, np.intersect1d(*ends))
        want = np.r_[0, np.cumsum(both)[:-1]]
        assert (np.unique(m.components(left, right), return_inverse=True)[1] == want).all()
    # One component of very many tokens: no token ends where one of the other side does.
    left, right = m.linked(np.r_[np.arange(1, 200_000, 2), 200_001], np.r_[np.arange(2, 200_000, 2), 200_001])
    assert not m.components(left, right).any()


def plain_base(text):
    """The patterns as they are written, by the re module alone."""
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and double % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), m.end(), kind))
    return out


def test_base_patterns_on_random_texts():
    import random

    from loomlake.llm.pii import base_spans

    r = random.Random(5)
    for signs, count in (("a1.@-+ ", 4000), ("0123.  -", 4000), ("+1 23().-é", 3000), ("55 4-", 2000), ("@@a..b%_", 2000)):
        for _ in range(count):
            text = "".join(r.choice(signs) for _ in range(r.randrange(1, 60)))
            assert base_spans(text) == plain_base(text), text
    cards = "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112, 378282246310005"
    assert base_spans(cards) == plain_base(cards)
    for text in ("1" * 300_000, "1." * 200_000, "1 " * 200_000, "@a." * 100_000, "a" * 300_000 + "@", "+1" + " " * 300_000, "+1(" * 100_000, "a@" * 100_000):
        assert len(base_spans(text)) < 200_000  # linear, or this would not end


def paths(score, moves):
    """Scores of all label paths that start and end outside."""
    from itertools import product

    n, k = score.shape
    return {y: moves[0, y[0]] + sum(score[t, y[t]] for t in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:])) + moves[y[-1], 0] for y in product(range(k), repeat=n)}


def test_field_recursions_by_hand():
    """Likelihood, expected counts and best paths against all paths of short sequences."""
    import numpy as np

    from loomlake.llm import pii

    rng = np.random.default_rng(4)
    k, sizes = 3, np.array([4, 1, 3, 2])
    score, moves = rng.normal(size=(4, 4, k)) * 2, rng.normal(size=(k, k))
    total, p, expected = pii.forward_backward(score, moves, sizes)
    best = pii.viterbi(score, moves, sizes)
    seen = np.zeros((k, k))
    for i, n in enumerate(sizes):
        found = paths(score[i, :n], moves)
        weight = np.array(list(found.values()))
        assert np.isclose(total[i], np.log(np.exp(weight).sum()))
        assert tuple(best[i, :n]) == max(found, key=found.get)
        for y, w in found.items():
            share = np.exp(w - total[i])
            np.add.at(seen, (np.r_[0, y], np.r_[y, 0]), share)
            for t in range(n):
                p[i, t, y[t]] -= share
    assert np.allclose(p, 0) and np.allclose(seen, expected)


def test_pruned_decoding_is_the_best_path():
    """Lines decoded in cut stretches give what Viterbi over whole lines gives; batches and slices make no difference."""
    import numpy as np
    import pyarrow as pa

    from loomlake.llm import pii

    field = pii.fit(pii.labelled_rows(2), steps=60)
    scores = pii.Scores(field)
    texts = [t for t, _ in pii.labelled_rows(1, 7)] + ["one\ntwo 555-123-4567\r\n\ncall 12", "", "\n", "é 10.0.0.1\n\n" * 3, "x " * 50 + "tom (at) home (dot) com"]
    texts.append("\n".join(texts[:40]))
    rows = list(pii.decoded(scores, pa.array(texts)))
    for text, got in zip(texts, rows, strict=True):
        want = []
        at = 0
        for line in re.split("[\n\r]", text):
            t = pii.tokens_of(pa.array([line]))
            codes = [-1, -1, *pii.codes_of(t, field.words).tolist(), -1, -1]
            if len(t.begin):
                score = np.array([[sum(scores.rows[codes[i + d], d] for d in range(5))] for i in range(len(t.begin))], np.float64).transpose(1, 0, 2)
                y = pii.viterbi(score, field.moves, np.array([len(t.begin)]))[0]
                for i, label in enumerate(y):
                    if label % 2:
                        stop = next((j for j in range(i + 1, len(y)) if y[j] != label + 1), len(y))
                        want.append((at + int(t.begin[i]), at + int(t.end[stop - 1]), (int(label) - 1) // 2))
            at += len(line.encode()) + 1
        assert got == want, text
        assert next(iter(pii.decoded(scores, pa.array([text])))) == want
    gain = np.array([1.0, -3, 2, 2, -1, 5, -9, 1])
    new = np.array([1, 0, 0, 1, 0, 0, 0, 1], bool)
    assert pii.best_runs(gain, new).tolist() == [max(sum(gain[i : j + 1]) for i in range(max(k for k in range(j + 1) if new[k]), j + 1)) for j in range(8)]


def test_personal_data(spark, monkeypatch):
    """Held-out rows of the labelled table, clean texts, the contract's digests over real texts, odd rows, long texts in lines."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    from loomlake.llm import pii

    field = pii.train(pii.labelled_table(spark))
    assert field is pii.train(pii.labelled_table(spark))
    scores = pii.Scores(field)
    rows = pii.labelled_rows(2, 99)
    found = [{(x, y, pii.KINDS[k]) for x, y, k in z if pii.valid(pii.KINDS[k], t[x:y])} for (t, _), z in zip(rows, pii.decoded(scores, pa.array([t for t, _ in rows])), strict=True)]
    right = sum(len(a & set(b)) for a, (_, b) in zip(found, rows, strict=True))
    assert right >= 0.9 * sum(map(len, found)) and right >= 0.9 * sum(len(b) for _, b in rows)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [(-1, None), (-2, ""), (-3, "write to a.b@c.de or +1 (017) 555-7713 10.0.0.1, é tom (at) home (dot) org"), (None, "10.0.0.1"), (-4, "4111111111111111 4111111111111111"), (-5, "4111111111111111 4111111111111111")]
    df = spark.createDataFrame([(*x, "s", 1) for x in docs + odd], "doc_id long, text string, spans string, n_email int")
    got = pii.find_spans(df, field).toPandas()
    assert len(got) == len(docs) + len(odd)
    by_id = {None if np.isnan(r.doc_id) else int(r.doc_id): r for r in got.itertuples()}
    for i, t in docs + odd:
        base = sorted(plain_base(t or ""), key=lambda x: (x[0], pii.KINDS.index(x[2])))
        said = [f"{k}:{s}:{e}" for s, e, k in base]
        r = by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in pii.KINDS]
        every = r.spans.split(",") if r.spans else []
        assert set(said) <= set(every) and len(every) == len(said) + r.n_added
        assert every == sorted(every, key=lambda x: (int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])))
    assert by_id[-3].spans == "email:9:17,phone:21:38,ip:39:47,email:51:74" and by_id[-3].n_added == 2
    assert by_id[-4].spans == "card:0:16,card:17:33" == by_id[-5].spans
    assert sum(by_id[i].n_added for i, _ in docs) <= 2
    text = "é clean line\nring 555-123-4567 now\n" * 300
    whole = next(iter(pii.decoded(scores, pa.array([text]))))
    monkeypatch.setattr(pii, "SLICE", 500)
    assert next(iter(pii.decoded(scores, pa.array([text])))) == whole and len(whole) == 300
    assert pii.find_spans(df.limit(0), field).count() == 0
    assert pii.fit([]).names == () or pii.decode(pii.Scores(pii.fit([])), pa.array(["a 1"]))[0].size == 0
