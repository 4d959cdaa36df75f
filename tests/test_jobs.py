import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F
from test_records import record

from loomlake.operators import prompts
from loomlake.plans import clients, jobs
from loomlake.sources import files, seeds


@pytest.fixture
def frame(spark, tmp_path):
    rows = [record(i, images=[{"path": f"r{i}_0.webp", "sha256": "h", "idx": 0, "width": 8, "height": 8, "seed": 1}]) for i in range(4)] + [record(9)]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return files.read_jsonl(spark, str(tmp_path / "r.jsonl"))


def test_evaluate(frame, tmp_path):
    def scorer():
        def work(row):
            if row["id"] == "r3":
                raise RuntimeError("no model")
            return {"clip_score": 0.1 if row["id"] == "r1" else 0.4, "nsfw": 0.0, "phash": {"r0": 5, "r1": 1 << 60 | 0xFFFF00, "r2": 4}[row["id"]]}

        return work

    got = {r["id"]: r["dataset"] for r in jobs.evaluate(frame, scorer, str(tmp_path / "scores")).collect()}
    assert set(got) == {"r0", "r1", "r2", "r3"}
    assert {k: v["quality"]["gate_reasons"] for k, v in got.items()} == {"r0": [], "r1": ["low_clip"], "r2": ["duplicate"], "r3": ["eval_failed"]}
    assert got["r0"]["license"] == "cc0" and got["r0"]["split"] in ("train", "val", "test") and got["r2"]["safety"]["is_duplicate"]


def test_pack_and_examples(spark, frame, tmp_path):
    made = jobs.pack(frame, str(tmp_path / "p"), name="demo", size=2)
    assert made["n_samples"] == 5 and made["shards"] == ["shard-00000.tar", "shard-00001.tar", "shard-00002.tar"]
    assert json.loads((tmp_path / "p" / "manifest.json").read_text())["splits"]["train"] == 5 and "cc0" in (tmp_path / "p" / "README.md").read_text()
    assert spark.read.json(str(tmp_path / "p" / "index")).count() == 5
    assert len(jobs.pack(frame, str(tmp_path / "q"), name="demo", only_passed=True)["shards"]) == 1
    assert jobs.training_examples(frame, str(tmp_path / "e")) == 5 and jobs.training_examples(frame, str(tmp_path / "t"), form="tokens") == 5
    with pytest.raises(ValueError):
        jobs.training_examples(frame, "x", form="verse")


def test_generate(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, prompt string")
    out = jobs.generate(df, lambda: lambda row: {"text": row["prompt"] * 2, "used": row["seed"]}, "text string, used long", str(tmp_path / "g")).orderBy("id").collect()
    assert [r["text"] for r in out] == ["xx", "yy"] and out[0]["used"] != out[1]["used"] and out[0]["error"] is None


def test_seed_vocabulary(spark):
    curated, subjects, contexts, air = seeds.tables(spark)
    got = [r["prompt"] for r in prompts.generate(curated, subjects, contexts, air, 600, seed=2).orderBy("pos").collect()]
    assert len(set(got)) == 600 and got[:36] == [r["prompt"] for r in curated.orderBy("pos").collect()]
    genre = {s: g for g, (names, _) in seeds.GENRES.items() for s in names}
    share = [sum(p.startswith(s) for p in got[36:336] for s in names) for names, _ in seeds.GENRES.values()]
    assert len(genre) == 84 and max(share) - min(share) <= 4
    assert subjects.filter(F.col("subject").isNull()).count() == 0


def test_http_client():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": asked["messages"][1]["content"].upper()}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = clients.HttpClient(f"http://127.0.0.1:{server.server_port}/v1", "m")
        assert client.complete("s", "hi") == ("HI", 3, 2)
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(RuntimeError):
        clients.HttpClient("http://127.0.0.1:9", "m", timeout=2).complete("s", "u")


def test_readings(tmp_path):
    (tmp_path / "cpu.stat").write_text("usage_usec 2500000\nuser_usec 1\n")
    (tmp_path / "memory.peak").write_text(str(3 << 30))
    assert clients.cpu_core_seconds(str(tmp_path)) == 2.5 and clients.memory_peak_gib(str(tmp_path)) == 3
    assert clients.cpu_core_seconds(str(tmp_path / "none")) is None and clients.code_version(str(tmp_path / "none")) == "unknown"


ANSWERS = {
    "semantic_plan": {"subject": "a", "environment": "b", "camera": "c", "mood": "d", "dominant_elements": ["x"], "more": 1},
    "layout": {"entities": [{"id": "e", "kind": "object", "bbox": ["0.1", 0, 0.5, 1]}], "relations": [{"subject": "e", "predicate": " In_Front", "object": "floor"}]},
    "composition": {"lens": "35mm", "rule_of_thirds": "true", "subject_scale": "0.4", "leading_lines": 0, "symmetry": "No"},
    "lighting": {"key_light": "k", "fill_light": "low", "rim_light": 1.0, "contrast": "high"},
    "materials": {"materials": {"glass": "wet"}},
    "color_script": {"primary_palette": ["#A1b2C3"], "temperature": " Cool", "saturation": "VIVID"},
}


def test_answers_are_read_leniently():
    from loomlake.plans.checks import STAGES

    got = {s: STAGES[s](a) for s, a in ANSWERS.items()}
    assert got["layout"] == {"canvas": [1024, 1024], "entities": [{"id": "e", "kind": "object", "bbox": [0.1, 0.0, 0.5, 1.0], "z": 0}], "relations": [{"subject": "e", "predicate": "in_front_of", "object": "floor"}]}
    assert got["composition"] == {"lens": "35mm", "rule_of_thirds": True, "subject_scale": 0.4, "leading_lines": False, "symmetry": False}
    assert got["color_script"]["temperature"] == "cold" and got["color_script"]["saturation"] == "high" and got["lighting"]["rim_light"] is True and "more" not in got["semantic_plan"]


@pytest.mark.parametrize(
    "stage,change,said",
    [
        ("semantic_plan", {"mood": ""}, "mood"), ("semantic_plan", {"dominant_elements": []}, "1 or more"), ("composition", {"symmetry": "maybe"}, "true or false"), ("composition", {"subject_scale": 1.5}, "0 to 1"),
        ("lighting", {"contrast": "High"}, "one of"), ("materials", {"materials": {"a": " "}}, "blank"), ("color_script", {"primary_palette": ["red"]}, "RRGGBB"), ("layout", {"canvas": [1, 2.5]}, "whole"),
        ("layout", {"entities": [{"id": "e", "kind": "object", "bbox": [0, 0, 1, 1]}]}, "background"), ("layout", {"entities": [{"id": "e", "kind": "object", "bbox": [0.5, 0, 0.5, 1]}]}, "extent"),
        ("layout", {"entities": [ANSWERS["layout"]["entities"][0]] * 2}, "repeat"), ("layout", {"relations": [{"subject": "e", "predicate": "on", "object": "ghost"}]}, "ghost"), ("layout", {"relations": [{"subject": "e", "predicate": "beside", "object": "e"}]}, "predicate"),
    ],
)
def test_wrong_answers(stage, change, said):
    from loomlake.plans.checks import STAGES

    with pytest.raises(ValueError, match=said):
        STAGES[stage](ANSWERS[stage] | change)


def test_one_sample(spark, tmp_path):
    from loomlake.plans.produce import LocalClient, Meter, scored

    turns = iter([json.dumps(a) for a in ANSWERS.values()])
    clock = iter([0.0, 10.0])
    client = LocalClient(lambda system, user: next(turns), lambda text: len(text.split()))
    got = jobs.one_sample("a lamp", client, lambda prompt, key: {"telemetry": {"projected_cost_usd": 0.5}, "images": [b"one", b"two"]}, str(tmp_path), spark, meter=Meter("T4", lambda: None, lambda: None, lambda: next(clock)), rate=0.001)
    assert got["cost"]["marginal_usd"] >= 0.5 and got["cost"]["real_to_marginal"] == pytest.approx(got["cost"]["real_usd"] / got["cost"]["marginal_usd"])
    assert (tmp_path / f"{got['id']}_1.webp").read_bytes() == b"two" and json.loads((tmp_path / f"{got['id']}.full.json").read_text())["lighting"]["rim_light"] is True
    assert json.loads((tmp_path / "runs" / f"{got['id']}.json").read_text())["status"] == "ok"
    assert scored(lambda row: 1 / row["x"])({"x": 3}) == 0.3333 and scored(lambda row: 1 / row["x"])({"x": 0}) is None


def test_image_files_and_costs(spark, tmp_path):
    from loomlake.functions import evaluation as E
    from loomlake.functions import scalars as X

    df = spark.createDataFrame([("r_1", 0, b"ab"), ("r_1", 1, b"c")], "id string, idx int, content binary")
    assert sorted(tuple(r) for r in files.write_images(df, str(tmp_path / "im")).collect()) == [("r_1_0.webp", 2), ("r_1_1.webp", 1)]
    assert sorted((r["id"], r["idx"], bytes(r["content"])) for r in files.image_contents(spark, str(tmp_path / "im")).collect()) == [("r_1", 0, b"ab"), ("r_1", 1, b"c")]
    assert tuple(spark.range(1).select(E.cost_per_image(F.lit(1.0), F.lit(3)), E.cost_per_image(F.lit(1.0), F.lit(0)), X.known_gpu_rate(F.lit("t4"))).first()) == (0.33333333, 0.0, 0.000164)
    with pytest.raises(Exception, match="unknown GPU"):
        spark.range(1).select(X.known_gpu_rate(F.lit("abacus"))).collect()


def test_commands(spark, frame, tmp_path, capsys):
    from loomlake.cli import main

    rows = str(tmp_path / "r.jsonl")
    (tmp_path / "runs.jsonl").write_text('{"kind": "render", "started_at": "2024-01-02", "total_cost_usd": 1.5, "status": "ok"}\n{"kind": "plan", "started_at": "2024-01-01"}\n')
    assert main(["report", rows, str(tmp_path / "rep"), "--runs", str(tmp_path / "runs.jsonl"), "--containers", str(tmp_path / "none.jsonl")]) == 0
    at = capsys.readouterr().out.strip().splitlines()[-1]
    lines = [x for f in (tmp_path / "rep").glob("*/runs.csv/*.csv") for x in f.read_text().splitlines()]
    assert at and lines[0].startswith("started_at,kind,model") and lines[1].startswith("2024-01-01,plan") and lines[2].split(",")[5] == "1.5"
    assert main(["quality", rows]) == 0 and "passed the gate" in capsys.readouterr().out
    assert main(["export", rows, str(tmp_path / "ex")]) == 0 and "5 examples" in capsys.readouterr().out
    assert main(["sheet", rows, str(tmp_path / "sheet"), "--n", "3"]) == 0
    sheet = next((tmp_path / "sheet").glob("*.csv"))
    lines = sheet.read_text().splitlines()
    assert len(lines) == 4
    done = tmp_path / "done.csv"
    done.write_text("\n".join([lines[0], *(x[: x.rindex(",") + 1] + str(i % 2) for i, x in enumerate(lines[1:]))]))
    assert main(["calibrate", str(done)]) == 0 and "clip_score" in capsys.readouterr().out
    assert main(["pack", rows, str(tmp_path / "pk"), "--shard-size", "3"]) == 0 and "5 records in 2 archives" in capsys.readouterr().out
    (tmp_path / "tr").mkdir()
    (tmp_path / "tr" / "r0.trace.json").write_text(json.dumps(record(0)))
    (tmp_path / "renders.jsonl").write_text(json.dumps({"id": "r0", "prompt": "new", "meta": {"seed": 4}, "telemetry": {"render": {"compute_s": 1.0, "cost_usd": 0.2}}, "images": []}) + "\n")
    assert main(["assemble", str(tmp_path / "renders.jsonl"), str(tmp_path / "tr"), str(tmp_path / "ds"), "--license", "cc0"]) == 0 and "1 records" in capsys.readouterr().out
    out = json.loads(next((tmp_path / "ds").glob("*.json")).read_text())
    assert out["dataset"]["stratum"] == "unknown" and out["enriched_prompt"] == "new"
    trace = record(0) | {"prompt": "A Copper Kettle on the sill"}
    (tmp_path / "tr" / "r0.trace.json").write_text(json.dumps(trace))
    assert main(["assemble", str(tmp_path / "renders.jsonl"), str(tmp_path / "tr"), str(tmp_path / "ds2")]) == 0
    (tmp_path / "own.csv").write_text("subject,stratum\na copper,metal\na copper kettle on,pots\n")
    assert main(["assemble", str(tmp_path / "renders.jsonl"), str(tmp_path / "tr"), str(tmp_path / "ds3"), "--subjects", str(tmp_path / "own.csv")]) == 0
    assert [json.loads(next((tmp_path / d).glob("*.json")).read_text())["dataset"]["stratum"] for d in ("ds2", "ds3")] == ["kitchen", "pots"]


def test_producer_commands(spark, frame, tmp_path, capsys):
    from loomlake.cli import main

    rows, own = str(tmp_path / "r.jsonl"), tmp_path / "own_models.py"
    own.write_text("def writer():\n    return lambda row: {'text': row['prompt'].upper()}\n\n\ndef scores():\n    return lambda row: {'clip_score': 0.3, 'aesthetic': 6.0, 'faithfulness': 0.9, 'nsfw': 0.01, 'phash': int(row['id'][1:]) * 0x0F0F0F0F0F}\n")
    (tmp_path / "prompts.txt").write_text("one\n\ntwo\nthree\n")
    assert main(["generate", str(tmp_path / "prompts.txt"), str(tmp_path / "g"), "--make", f"{own}:writer", "--outputs", "text string", "--in-flight", "2", "--limit", "2"]) == 0
    assert "2 made, 0 failed" in capsys.readouterr().out
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "g")).collect()) == ["ONE", "TWO"]
    assert main(["evaluate", rows, str(tmp_path / "s"), "--make", f"{own}:scores", "--out", str(tmp_path / "ev")]) == 0
    assert spark.read.json(str(tmp_path / "ev")).count() > 0 and spark.read.parquet(str(tmp_path / "s")).filter("clip_score = 0.3").count() > 0


def test_producing_again_asks_for_what_is_missing(spark, tmp_path):
    """A failed or killed run's results count; requests of a partition are in flight together; nulls, lists and wrong types."""
    import threading
    import time

    from loomlake.plans.produce import produce, produce_into

    folder, asked = str(tmp_path / "table"), str(tmp_path / "asked")
    (tmp_path / "asked").mkdir()

    def make(bad):
        def work(row):
            with open(f"{asked}/{row['id']}-{time.time_ns()}", "w"):
                pass
            if row["id"] in bad:
                raise ValueError("not now")
            return {"n": row["k"], "size": len(row["tags"] or [])}

        return lambda: work

    df = spark.createDataFrame([(f"a{i}", i if i % 2 else None, ["x"] * i) for i in range(6)], "id string, k long, tags array<string>")
    kinds = "n long, size int"
    first = {r["id"]: r for r in produce_into(df, make({"a2", "a3"}), kinds, folder, key="id").collect()}
    assert first["a2"]["error"] == "ValueError: not now" and first["a0"]["n"] is None and first["a5"]["size"] == 5
    for f in (tmp_path / "table").glob("_SUCCESS"):
        f.unlink()  # as a killed run leaves it
    second = {r["id"]: r for r in produce_into(df, make({"a3"}), kinds, folder, key="id").collect()}
    assert second["a2"]["error"] is None and second["a3"]["error"] == "ValueError: not now" and second["a5"]["size"] == 5
    counts = {i: len(list((tmp_path / "asked").glob(f"a{i}-*"))) for i in range(6)}
    assert counts == {0: 1, 1: 1, 2: 2, 3: 2, 4: 1, 5: 1}

    def together():
        gate = threading.Barrier(4)
        return lambda row: {"n": gate.wait(60) * 0 + row["id"]}

    got = produce(spark.range(0, 8, 1, 1), together, "n long", key="id", in_flight=4).collect()
    assert [r["n"] for r in got] == list(range(8)) and not any(r["error"] for r in got)
    odd = produce(spark.range(3), lambda: lambda row: {"n": "text" if row["id"] == 1 else 5}, "n long", key="id").orderBy("id").collect()
    assert [r["n"] for r in odd] == [5, None, 5] and odd[1]["error"]


def test_totals_come_from_the_job_that_writes(spark, frame, tmp_path):
    """One job a write: counts, images and costs are observed in it."""
    group = "totals"
    spark.sparkContext.setJobGroup(group, "")
    try:
        n = jobs.training_examples(frame, str(tmp_path / "ex"))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1 and n == spark.read.json(str(tmp_path / "ex")).count() == 5
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert jobs.written(spark.range(0), str(tmp_path / "none"), total=F.sum("id")) == {"rows": 0, "total": 0}


def test_api_key_is_sent(monkeypatch):
    import http.server
    import threading

    from loomlake.plans import clients

    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            seen.append(self.headers.get("Authorization"))
            self.rfile.read(int(self.headers["Content-Length"]))
            body = json.dumps({"choices": [{"message": {"content": "{}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1"
    monkeypatch.delenv(clients.KEY_VARIABLE, raising=False)
    assert clients.HttpClient(url, "m").complete("s", "u") == ("{}", 3, 2)
    monkeypatch.setenv(clients.KEY_VARIABLE, "from-env")
    assert "from-env" not in repr(clients.HttpClient(url, "m"))
    clients.HttpClient(url, "m").complete("s", "u")
    clients.HttpClient(url, "m", api_key="given").complete("s", "u")
    server.shutdown()
    assert seen == [None, "Bearer from-env", "Bearer given"]


def test_stratum_of_many_subjects(spark):
    """5,000 subjects of 400 lengths, nested and short ones; the longest wins; columns keep whatever names they have."""
    import random
    import time

    from loomlake.operators import assemble

    r = random.Random(8)
    say = lambda n: "".join(r.choice("abc ") for _ in range(n))
    subjects = {say(1 + i % 400): f"g{i % 7}" for i in range(5000)} | {"": "all"}
    whole = say(300)
    subjects |= {whole[:n]: f"n{n}" for n in (1, 2, 5, 90, 299)}
    texts = [s[: r.randrange(len(s) + 1)].upper() + say(r.randrange(5)) for s in r.sample(sorted(subjects), 60)] + [s + say(3) for s in r.sample(sorted(subjects), 40)] + [whole, whole[:89], "zz", "", None]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], "i int, prompt string, _subject string, _p string, stratum string")
    began = time.time()
    out = assemble.prompt_stratum(df, spark.createDataFrame(list(subjects.items()), "subject string, stratum string"))
    assert time.time() - began < 5 and set(out.columns) == set(df.columns)
    got = {x["i"]: x for x in out.collect()}
    for i, t in enumerate(texts):
        fits = [s for s in subjects if t is not None and t.lower().startswith(s)]
        assert got[i]["stratum"] == (subjects[max(fits, key=len)] if fits else "unknown") and got[i]["_subject"] == "x"


def test_lax_reading_in_spark_is_that_of_single_answers(spark):
    """Random answers to every stage, broken in many ways: the expressions accept and read what the checks of single answers do."""
    import copy
    import random

    from loomlake.functions import lax
    from loomlake.plans.checks import STAGES

    r = random.Random(11)
    good = record(0)
    odd = [None, "", "x", " Yes ", "0.4", "1", 1, 0, 2, 0.5, 1.0, -1, 1e30, True, False, [], {}, [1], ["a", ""], {"a": "b"}, {"a": " "}, {" ": "b"}, {"a": 1}, "#12aB9f", "#12aB9g", ["#123456", 5], "HIGH", "warm", " Cool", "left_of", "nan", "1e400", [0, 0, 1, 1], ["0", 0.5, True, 1]]

    def places(v, at=()):
        yield at
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield from places(x, (*at, k))

    for stage, check in STAGES.items():
        answers = [json.dumps(good[stage]), "null", "[]", "no", "{}", json.dumps(good[stage] | {"more": {"id": 1}})]
        for _ in range(250):
            one = copy.deepcopy(good[stage])
            for _ in range(r.choice((1, 1, 2))):
                at = r.choice([p for p in places(one) if p] or [("none",)])
                inside = one
                for k in at[:-1]:
                    inside = inside[k]
                if r.random() < 0.2 and at != ("none",):
                    del inside[at[-1]]
                else:
                    inside[at[-1]] = copy.deepcopy(r.choice(odd))
            answers.append(json.dumps(one))
        df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)] + [(-1, None)], "i int, a string")
        got = {x["i"]: x for x in lax.read_answers(df, "a", stage).collect()}
        assert got[-1]["errors"] == ["no JSON"] and got[3]["errors"] == ["no JSON"] and got[2]["errors"] == ["no object"]
        for i, a in enumerate(answers):
            try:
                want = check(json.loads(a))
            except ValueError:
                want = None
            found = got[i]["read"].asDict(recursive=True) if got[i]["read"] else None
            assert found == want, (stage, a, got[i]["errors"])
            assert (want is None) == bool(got[i]["errors"])
    with pytest.raises(ValueError, match="taken"):
        lax.read_answers(df.withColumn("errors", F.lit(1)), "a", "layout")
