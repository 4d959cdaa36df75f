import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import database, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomlake.llm import bpe, chat, fingerprint, hmm, packing, sharding, toxicity
from loomlake.llm.queries import ORACLES, QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "Ünïcödé 🙂 <|endoftext|> x", "~1<[INST]>]~", "x" * 3000, "the the the\n\n", "1234567", "\x00\x1c\x85"]


@pytest.fixture(scope="module")
def auto():
    return bpe.MergeAutomaton(bpe.read_spec(PATH))


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


PIECES = ["a", "aa", "the", "ing", " ", "  ", "\n", "é", "ß", "日本", "🙂", "'s", "'ll", "12", "-", "…", "<|endoftext|>", "\t", "\x1c", "\x85", "İ", "٣", "½", "====", "\x00", "​"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=15).map("".join)))
def test_automaton_equals_library(auto, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert auto.encode(text) == ",".join(map(str, ids))
    assert np.frombuffer(auto.encode_packed(text), "<u4").tolist() == ids
    assert auto.decode(auto.encode(text)) == theirs.decode(ids, skip_special_tokens=False)


def test_small_automaton_by_gadgets():
    """With few merges every string's path is the one that applying the merges in order gives."""
    import itertools
    import json

    chars = {b: c for c, b in bpe.printable_bytes().items()}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "aa"), ("ab", "ab"), ("b", "b")]
    names = [chars[i] for i in range(256)] + ["".join(m) for m in merges]
    spec = json.dumps({"model": {"vocab": {n: i for i, n in enumerate(names)}, "merges": [" ".join(m) for m in merges]}})
    auto = bpe.MergeAutomaton(spec)
    for n in range(1, 9):
        for word in itertools.product("ab", repeat=n):
            parts = list(word)
            for a, b in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (a, b):
                        parts[i : i + 2] = [a + b]
                    i += 1
            assert [auto.labels[i].decode() for i in auto.path("".join(word).encode())] == parts


@pytest.mark.parametrize("seed", range(4))
def test_arcs_equal_whole_gadget_construction(seed):
    """Every arc of random vocabularies against the automaton that all gadgets, one after another, make."""
    import json

    rng = random.Random(seed)
    chars = {b: c for c, b in bpe.printable_bytes().items()}
    names, merges = [chars[b] for b in b"abc"], []
    while len(merges) < 60:
        rows = bpe.gadget_rows([0, 1, 2], merges)
        a = rng.randrange(len(names))
        b = rng.choice(sorted(rows[a]) or [0])
        if b in rows[a] and names[a] + names[b] not in names:
            merges.append((a, b, len(names)))
            names.append(names[a] + names[b])
    auto = bpe.MergeAutomaton(json.dumps({"model": {"vocab": {n: i for i, n in enumerate(names)}, "merges": [[names[a], names[b]] for a, b, _ in merges]}}))
    rows = bpe.gadget_rows([0, 1, 2], merges)
    assert all(auto.arc(x, y) == (y in rows[x]) for x in rows for y in rows)


def test_other_vocabulary_files_are_refused():
    with pytest.raises(ValueError, match="normalizer"):
        bpe.MergeAutomaton(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json")))


def test_bpe_query(spark, theirs):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a", "x"), (1, "", "x")], "doc_id long, text string, ids string")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest_documents(df, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in [*enumerate(ODD), (None, "a")]:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    assert got == want
    assert all(r["decoded"] == (ODD[r["doc_id"]] or "") for r in bpe.encode_documents(df.filter("doc_id is not null").limit(10), PATH).collect())
    assert bpe.digest_documents(df.limit(0), PATH).count() == 0


def test_packing(spark, theirs):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    ids = {r["doc_id"]: np.array(theirs.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    got = packing.pack_documents(docs.repartition(3, "doc_id"), PATH).toPandas()
    for i, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i]) and zlib.crc32(ids[i][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids[i])
    assert set(got.doc_id) == set(ids)
    padding = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        total = int(g.length.sum())
        assert (g.offset.to_numpy() == np.cumsum(g.length.to_numpy()) - g.length.to_numpy()).all() and total <= 1024
        padding += 0 if total & (total - 1) == 0 else 1024 - total
    assert padding < 0.02 * sum(map(len, ids.values()))
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


@given(st.integers(1, 5000))
def test_harmonic_cuts(total):
    cuts = packing.harmonic_cuts(total, 1024, 16, 0.04)
    assert sum(n for n, _ in cuts) == total and all(n * k <= 1024 for n, k in cuts)


def test_fingerprints(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(n))
    texts = [say(300) for _ in range(20)] + [None, "", "é", "ab", say(5000)]
    data = [(i * 7 - 20, t) for i, t in enumerate(texts)] + [(900, texts[0]), (900, texts[0])]
    got = sorted((r.asDict() for r in fingerprint.compare_edited(spark.createDataFrame([(*d, "z") for d in data] + [(None, "q", "z")], "doc_id long, text string, block string")).collect()), key=lambda r: r["doc_id"])
    assert len(got) == len(data)
    for i, r in enumerate(got):
        a, b = data[i][1] or "", data[(i + 1) % len(data)][1] or ""
        k = len(a) // 4
        edited = a[: len(a) - k] + b[:k]
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        first, second, third = fingerprint.chunk_sets([a.encode(), edited.encode(), b.encode()])
        assert r["fingerprint"] == fingerprint.spelled(first) and r["edited_fingerprint"] == fingerprint.spelled(second)
        assert r["near_edited"] == fingerprint.containment(first, second) and r["near_next"] == fingerprint.containment(first, third)
    assert min(r["near_edited"] for r in got if r["n_chars"] > 500) > 0.5
    assert fingerprint.compare_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = fingerprint.compare_edited(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1 and alone["n_chars"] == 8


def plain_chunks(data):
    """Boundaries, digests and lengths byte by byte."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    gear = [0 if b == 0 else mixed(((b + 1) * 0x9E3779B97F4A7C15 + 1) & mask) & 0xFFFFFFFF for b in range(256)]
    words = [mixed(((b + 1) * 0x9E3779B97F4A7C15 + 2) & mask) for b in range(256)]
    found, at = set(), 0
    while at < len(data):
        end = min(at + 192, len(data))
        for stop in range(at + 12, end):
            h = 0
            for back in range(min(32, stop)):
                h = h + (gear[data[stop - 1 - back]] << back) & 0xFFFFFFFF
            if h >> 32 - (7 if stop < at + 32 else 4) == 0:
                end = stop
                break
        value = sum(words[b] * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(data[at:end]))
        found.add((mixed(value + (end - at) * 0xD6E8FEB86659FD93 & mask) >> 16, end - at))
        at = end
    return found


def test_chunks_against_plain_definition():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc de\x00\xc3") for _ in range(n)) for n in (0, 1, 11, 12, 13, 31, 200, 1500, 3000)] + [b"z" * 700]
    made = fingerprint.chunk_sets(texts)
    plain = [plain_chunks(t) for t in texts]
    assert [{(int(v) >> 16, int(v) & 0xFFFF) for v in x} for x in made] == plain
    for i in (6, 7, 8):
        for j in (6, 7, 8):
            want = sum(n for d, n in plain[i] & plain[j]) / sum(n for _, n in plain[i])
            assert fingerprint.containment(made[i], made[j]) == pytest.approx(want)


def test_chunks_resist_shifts():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 123, 20000, dtype=np.uint8))
    a, b = fingerprint.chunk_sets([data, b"shift " + data])
    assert fingerprint.containment(a, b) > 0.99


def placed(df, **options):
    out = sharding.shard_by_size(df, **options).toPandas()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    return out


def test_sharding(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["hot text" * 3] * 1200 + [None, ""] * 20 + ["é" * 40]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, shard string, k int")
    out = placed(df)
    assert sorted(out.doc_id) == list(range(len(texts))) and set(out["shard"]) <= set(range(16)) and (out.law == "bytes").all() and out.grown_shard.isna().all()
    for r in out.itertuples():
        b = (texts[r.doc_id] or "").encode()
        assert r.size == len(b) + 1 and r.text_crc32 == zlib.crc32(b)
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.02 * sizes.mean()
    small = out[out.doc_id < 1500].assign(text=[texts[i] for i in out[out.doc_id < 1500].doc_id])
    assert (small.groupby("text")["shard"].nunique() == 1).all()
    assert placed(df.limit(0)).empty and len(placed(df.limit(1))) == 1
    twice = placed(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string"))
    assert len(twice) == 3


def test_sharding_with_large_records(spark):
    texts = ["x" * (50_000 if i % 40 == 0 else 100 + i % 900) for i in range(800)]
    out = placed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=4)
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.01 * sizes.mean()


def test_room_ends():
    assert sharding.room_ends([0, 0], 10) == [5, 10] and sharding.room_ends([6, 0], 4) == [0, 4] and sharding.room_ends([1, 0], 4)[-1] == 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(database(FOLDER).sql(ORACLES[name]).df())


def test_chat_layouts(spark):
    import json

    said = [("user", "hi <b>"), ("assistant", "~0 [ok] </s>")]
    layouts = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in said]},
        "conversations": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}[r], "value": t} for r, t in said]},
        "prompt": {"prompt": said[0][1], "response": said[1][1]},
        "completion": {"prompt": said[0][1], "completion": said[1][1]},
        "instruction": {"instruction": said[0][1], "output": said[1][1]},
        "question": {"question": said[0][1], "answer": said[1][1]},
        "rows": {"rows": [{"turn": 1, "role": said[1][0], "text": said[1][1]}, {"turn": 0, "role": said[0][0], "text": said[0][1]}]},
    }
    data = [(k, json.dumps(v)) for k, v in layouts.items()] + [("none", None), ("none", "not json"), ("none", '{"odd": 1}'), ("none", "[]")]
    out = chat.format_turns(chat.canonical_turns(spark.createDataFrame([(*d, "x") for d in data], "name string, payload string, formatted0 string"), "payload")).withColumn("back", chat.read_turns(F.col("formatted"))).collect()
    assert len(out) == len(data)
    for r in out:
        assert (r["layout"] or "none") == r["name"]
        if r["layout"]:
            assert [tuple(t) for t in r["turns"]] == said == [tuple(t) for t in r["back"]]
            spans = [r["formatted"][a:b] for a, b in r["loss_mask"]]
            assert len(spans) == 1 and spans[0].replace("~4", "]").replace("~3", ">").replace("~2", "[").replace("~1", "<").replace("~0", "~") == said[1][1]
            assert "</s>" not in r["formatted"] and "[ok]" not in r["formatted"]
    whole = next(r for r in out if r["name"] == "messages")
    two = spark.createDataFrame([('{"instruction": "a", "input": "b", "output": "c"}',), ('{"system": "s", "prompt": "a", "response": null}',)], "p string")
    turns = [[tuple(t) for t in r["turns"]] for r in chat.canonical_turns(two, "p").collect()]
    assert turns == [[("user", "a\n\nb"), ("assistant", "c")], [("system", "s"), ("user", "a"), ("assistant", "")]] and whole["schema_fingerprint"]


def test_chat_names(spark):
    df = spark.createDataFrame([('{"prompt": "a", "response": "b"}', 1, "s")], "p string, v int, shape string")
    r = chat.canonical_turns(df, "p").first()
    assert (r["v"], r["shape"], r["layout"], len(r["turns"])) == (1, "s", "prompt", 2)
    with pytest.raises(ValueError, match="turns"):
        chat.canonical_turns(df.withColumn("turns", F.lit(1)), "p")


def test_chat_rows_with_gaps(spark):
    data = [(1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 5, "user", ODD[5]), (None, 1, "user", "x")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 0 and out[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[2]["turns_sha256"] == hashlib.sha256(f"user\n{ODD[5]}\n".encode()).hexdigest() and None in out
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_loss_follows_the_mask(spark, monkeypatch):
    """What is under the mask is digested: all assistant texts over several blocks of turns, and less if the mask has less."""
    said = {c: [(("user", "assistant", "assistant", "tool")[(i * c) % 4], (ODD[i % len(ODD)] or "") + str(i)) for i in range(n)] for c, n in ((1, 1), (3, 256), (5, 257), (7, 1500))}
    rows = spark.createDataFrame([(c, i, r, t) for c, turns in said.items() for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    loss = {c: [t for r, t in turns if r == "assistant"] for c, turns in said.items()}
    got = {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.format_conversations(rows).collect()}
    digested = lambda texts: (len("".join(texts)), hashlib.sha256("".join(texts).encode()).hexdigest())
    assert got == {c: digested(texts) for c, texts in loss.items()}
    whole = chat.format_turns
    monkeypatch.setattr(chat, "format_turns", lambda df: whole(df).withColumn("loss_mask", F.slice("loss_mask", 2, 1 << 30)))
    less = {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.format_conversations(rows).collect()}
    assert less == {c: digested(texts[1:]) for c, texts in loss.items()} and less != got


def test_chat_long_conversations(spark):
    """Over 20,000,000 characters in one turn, and over 128 MiB in one conversation, are beyond the JSON parser."""
    few = spark.sql("select 1L as conv_id, 0L as turn, 'user' as role, repeat('ab', 10500000) as text union all select 1L, 1L, 'assistant', 'yes'")
    many = spark.sql("select cast(null as long) as conv_id, id as turn, 'user' as role, repeat('x', 10000000) as text from range(14)")
    out = {r["conv_id"]: r for r in chat.format_conversations(few).select("conv_id", "n_turns", "loss_chars", "formatted_chars", "turns_sha256").collect()}
    said = hashlib.sha256(b"user\n" + b"ab" * 10_500_000 + b"\nassistant\nyes\n").hexdigest()
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["turns_sha256"]) == (2, 3, said)
    made = chat.canonical_columns(chat.in_layouts(chat.gather_rows(many)), chat.PAYLOAD).select("layout", F.size("turns").alias("n"), F.expr("aggregate(turns, 0L, (a, t) -> a + length(t.text))").alias("chars")).first()
    assert tuple(made) == ("rows", 14, 140_000_000)
    payload = F.concat(F.lit('{"prompt": "'), F.expr("repeat('x', 21000000)"), F.lit('", "response": "y"}'))
    longest = chat.canonical_turns(spark.range(1).select(payload.alias("p")), "p").select(F.size("turns"), "error", "layout").first()
    assert longest[0] == 0 and longest["error"].startswith("not parsed: too long or no JSON") and longest["layout"] is None


def test_chat_layouts_of_columns(spark):
    """Paths that are there in a row select its mapping; another field, a missing one or no payload select none or another one."""
    kinds = "k string, rows array<struct<turn:int,role:string,text:string>>, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, response string, system string"
    table = spark.createDataFrame([
        ("rows", [(2, "assistant", "b"), (None, "user", "a"), (1, None, None)], None, None, None, None, None), ("messages", None, [("user", "a"), ("assistant", None)], None, None, None, None), ("conversations", None, None, [("human", "a"), ("gpt", "b"), ("x", "c")], None, None, None),
        ("prompt", None, None, None, "a", "b", None), ("system_prompt", None, None, None, "a", "b", "s"), ("none", None, None, None, "a", None, None), ("none", None, [("user", "a")], None, "a", "b", None), ("none", None, None, None, None, None, None), ("messages", None, [], None, None, None, None),
    ], kinds)
    payload = [c for c in table.columns if c != "k"]
    got = chat.canonical_columns(table, payload).collect()
    assert [r["layout"] or "none" for r in got] == [r["k"] for r in got]
    turns = [[tuple(t) for t in r["turns"]] for r in got]
    assert turns[:5] == [[("user", "a"), ("", ""), ("assistant", "b")], [("user", "a"), ("assistant", "")], [("user", "a"), ("assistant", "b"), ("x", "c")], [("user", "a"), ("assistant", "b")], [("system", "s"), ("user", "a"), ("assistant", "b")]] and not any(turns[5:])
    prints = {r["k"]: r["schema_fingerprint"] for r in got if r["layout"]}
    assert len(set(prints.values())) == len(prints) == 5 and prints["prompt"] == hashlib.sha256(b"prompt,response").hexdigest()
    wider = table.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(1).alias("weight"))))
    again = chat.canonical_columns(wider, payload).filter("k = 'messages'").first()
    assert again["layout"] is None and again["schema_fingerprint"] != prints["messages"]
    own = chat.Mapping("weighed", ("messages[].role", "messages[].content", "messages[].weight"), turn=("role", "content"))
    assert chat.canonical_columns(wider, payload, mappings=(own,)).filter("k = 'messages'").first()["layout"] == "weighed"
    renamed = chat.canonical_columns(table.withColumnRenamed("response", "completion"), [c if c != "response" else "completion" for c in payload]).filter("k = 'prompt'").first()
    assert renamed["layout"] == "completion" and [tuple(t) for t in renamed["turns"]] == turns[3]
    with pytest.raises(ValueError, match="layout"):
        chat.canonical_columns(table.withColumn("layout", F.lit(1)), payload)
    assert chat.canonical_columns(table.limit(0), payload).count() == 0


def test_native_operators_run_no_python(spark):
    for name in ("op3_sharding", "op10_chat_formatting"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_toxicity(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["tree", "house", "river", "stone", "cloud", "green"]) for _ in range(n))
    texts, labels = [], []
    for i in range(400):
        parts = [say(6) for _ in range(rng.randint(1, 8))]
        if i % 4 == 0:
            at = rng.randrange(len(parts))
            parts[at] = f"you {rng.choice(['grobble', 'grobbler', 'fnarg'])} {parts[at]}"
        texts.append(". ".join(parts) + ".")
        labels.append(int(i % 4 == 0))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(500, None), (501, ""), (502, "you fnarg"), (1, texts[1])], "doc_id long, text string").withColumn("score", F.lit("taken"))
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, sample=300)
    got = toxicity.score_documents(docs, model).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(got) == len(texts) + 4 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    for r in held:
        if r["predicted"]:
            worst = texts[r["doc_id"]][r["worst_start"] : r["worst_stop"]]
            assert "grobble" in worst or "fnarg" in worst
    empty = {r["doc_id"]: r for r in got if r["doc_id"] >= 500}
    assert empty[500]["score"] == empty[501]["score"] == pytest.approx(model.prior) and empty[502]["predicted"] == 1
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] < 0.5}
    one = toxicity.fit(["a. b.", "c"], [0, 0])
    assert toxicity.Scorer(one).score("z. y")[0] < 0.5


def test_noisy_or_by_hand(spark):
    """Scores and the slopes of the likelihood against the plain definition, one sentence after another."""
    model = toxicity.Model(-2.0, 0.05, {"bad": 1.5, "badl~": 0.5, "ugly": 2.0})
    texts = ["bad day. fine. ugly bad bad!", "fine", "Badly. badly\nok", ""]
    hits = {"bad": 1.5, "badly": 0.5, "ugly": 2.0}
    logistic = lambda z: 1 / (1 + np.exp(-z))
    sentence = lambda s: (logistic(-2.0 + sum(hits.get(w, 0) for w in s.split())) - logistic(-2.0)) / (1 - logistic(-2.0))
    parts = [["bad day", "fine", "ugly bad bad"], ["fine"], ["badly", "badly", "ok"], []]
    want = [1 - 0.95 * np.prod([1 - sentence(s) for s in p]) for p in parts]
    assert [toxicity.Scorer(model).score(t)[0] for t in texts] == pytest.approx(want)
    got = toxicity.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["score"] for r in got] == pytest.approx(want)
    assert got[0]["worst_score"] == pytest.approx(sentence("ugly bad bad")) and got[0]["n_offending"] == 1 and got[1]["worst_score"] is None
    keep = ["bad", "ugly"]
    bags = toxicity.arrays([toxicity.bag_of(t, {"bad": 0, "ugly": 1}) for t in texts[:3]])
    y, each, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5]), np.array([0.7, 0.2])

    def value(w, b, prior):
        m, out = toxicity.Scorer(toxicity.Model(b, -np.expm1(-prior), dict(zip(keep, w, strict=True)))), 0.0
        for t, label, e in zip(texts, y, each, strict=False):
            p = m.score(t)[0]
            out += e * np.log(p if label else 1 - p)
        return out

    at, gw, gb, gp = toxicity.gradient(bags, y, each, w, -2.0, 0.1)
    eps = 1e-6
    assert at == pytest.approx(value(w, -2.0, 0.1)) and gb == pytest.approx((value(w, -2.0 + eps, 0.1) - at) / eps, rel=1e-3)
    assert gp == pytest.approx((value(w, -2.0, 0.1 + eps) - at) / eps, rel=1e-3)
    assert gw == pytest.approx([(value(w + eps * np.eye(2)[k], -2.0, 0.1) - at) / eps for k in range(2)], rel=1e-3)


def test_length_is_no_evidence(spark):
    """One score for 1 to 50,000 plain sentences, which drop_toxic keeps; held-out recall and precision over the real labels."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    plain = [(k, line * n) for k, (line, n) in enumerate((line, n) for line in ("the sky is blue. ", "a = 1\n") for n in (1, 15, 5000, 50_000))]
    table = spark.createDataFrame(plain, "doc_id long, text string")
    scores = {r["score"] for r in toxicity.score_documents(table, model).collect()}
    assert scores == {model.prior} and model.prior <= toxicity.PRIOR
    assert toxicity.drop_toxic(table, model).count() == len(plain)
    held = toxicity.score_documents(docs, model).filter("held_out").join(labels.filter("toxic is not null"), "doc_id").collect()
    both = sum(r["predicted"] and r["toxic"] for r in held)
    assert both >= 0.9 * sum(r["toxic"] for r in held) and both >= 0.9 * sum(r["predicted"] for r in held)


def likelihood(model, symbols):
    """The forward recursion without vectors."""
    state, out = model.start * model.emit[symbols[0]], 0.0
    for s in symbols[1:]:
        out, state = out + np.log10(state.sum()), state / state.sum()
        state = (state @ model.move) * model.emit[s]
    return out + np.log10(state.sum())


def test_hmm_recursions():
    rng = np.random.default_rng(6)
    k, m = 3, 7
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0))
    seqs = [rng.integers(0, m, n) for n in (1, 5, 12, 2, 12)]
    flat, sizes = np.concatenate(seqs), np.array([len(s) for s in seqs])
    assert model.forward(flat, sizes) == pytest.approx([likelihood(model, s) for s in seqs])
    counts = hmm.Counts(m, k)
    model.expect(flat, sizes, counts)
    assert counts.emit.sum() == pytest.approx(len(flat), rel=1e-4) and counts.start.sum() == pytest.approx(len(seqs), rel=1e-4) and counts.move.sum() == pytest.approx(len(flat) - len(seqs), rel=1e-4)
    eps, s = 1e-6, np.array([1, 4, 4, 2])
    alone = hmm.Counts(m, k)
    model.expect(s, np.array([4]), alone)
    up = hmm.Hmm(model.start, model.move, model.emit.copy())
    up.emit[4, 1] *= 1 + eps
    slope = (likelihood(up, s) - likelihood(model, s)) / eps * np.log(10)
    assert alone.emit[4, 1] == pytest.approx(slope, rel=1e-3)


def test_hmm_forward_of_ended_and_empty_sequences():
    rng = np.random.default_rng(3)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(50), 3).T)
    for order in (range(13), range(12, -1, -1)):
        seqs = [rng.integers(0, 50, n).tolist() for n in order]
        flat, sizes = np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs])
        assert model.forward(flat, sizes) == pytest.approx([likelihood(model, s) if s else 0.0 for s in seqs])
    assert len(model.forward(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    assert hmm.token_slices(np.array([3, 3, 9, 1, 1]), 6) == [(0, 2), (2, 3), (3, 5)] and hmm.token_slices(np.zeros(0, np.int64), 6) == []


def test_hmm_expects_over_runs():
    """Expected counts of texts over several runs against the plain recursions over whole texts."""
    rng = np.random.default_rng(8)
    k, m = 3, 7
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    model = hmm.Hmm(norm(rng.random(k), 0), norm(rng.random((k, k)) + 4 * np.eye(k), 1), norm(rng.random((m, k)), 0))
    seqs = [rng.integers(0, m, n) for n in (300, 5, 256, 257, 512, 1500, 1)]
    got, want = hmm.Counts(m, k), hmm.Counts(m, k)
    model.expect(np.concatenate(seqs), np.array([len(s) for s in seqs]), got)
    for s in seqs:
        a, b = [norm(model.start * model.emit[s[0]], 0)], [np.ones(k)]
        for x in s[1:]:
            a.append(norm(a[-1] @ model.move * model.emit[x], 0))
        for x in s[:0:-1]:
            b.insert(0, norm(model.move @ (model.emit[x] * b[0]), 0))
        for t, x in enumerate(s):
            want.emit[x] += norm(a[t] * b[t], 0)
            if t:
                both = a[t - 1][:, None] * model.move * (model.emit[x] * b[t])[None, :]
                want.move += both / both.sum()
        want.start += norm(a[0] * b[0], 0)
    for x, y in ((got.emit, want.emit), (got.move, want.move), (got.start, want.start)):
        np.testing.assert_allclose(x, y, rtol=1e-4)


def test_hmm_scores(spark):
    import math
    import re
    from collections import Counter

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(ODD)] + [(2000, None)], "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    seen = Counter(w for i, t in texts if not held(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    got = hmm.score_documents(docs, words=500, classes=64, states=4, rounds=2, sample=60, first_rounds=4).collect()
    want = sorted((i, held(i), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 5)) for i, t in texts)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    known = hmm.train(docs, words=500, classes=64, states=4, rounds=2, sample=60, first_rounds=4)
    scores = {}
    for i, t in texts:
        symbols, share = [], 0.0
        for w in tokens(t)[:-1]:
            b = w.encode("utf-8", "surrogatepass")
            symbols.append(known.top.get(b, len(known.top) + zlib.crc32(b[-3:]) % 64))
            if b not in known.top:
                share += math.log10(hmm.within(seen[w], *known.sizes.get(zlib.crc32(b[-3:]) % 64, (0, 0))))
        scores.setdefault(i, []).append(round(likelihood(known.model, [*symbols, len(known.top) + 64]) + share, 4))
    assert {r["doc_id"]: 1 for r in got}.keys() == scores.keys()
    assert all(min(abs(r["score"] - x) for x in scores[r["doc_id"]]) < 1e-3 for r in got)
    for total, kinds in known.sizes.values():  # shares of a class sum to 1
        assert total - hmm.DISCOUNT * kinds + (kinds + 1) * hmm.within(0, total, kinds) * (total + 1) == pytest.approx(total + 1)
    assert hmm.score_documents(docs.limit(0)).count() == 0
    alone = hmm.score_documents(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").filter("doc_id = 2")).first()
    assert alone["n_tokens"] == 1


def test_vocabulary_is_found():
    assert vocabulary().endswith(".json")
