import json

import pytest
from pyspark.sql import functions as F

from loomlake.functions import trace as T
from loomlake.functions import vocabulary as V
from loomlake.operators import assemble, quality, shards
from loomlake.plans import produce, report
from loomlake.sources import files
from loomlake.streaming import ledger


def told(**more):
    return {"compute_s": 2.0, "rate_usd_per_s": 0.001, "projected_cost_usd": 0.002, "projected_gpu": "A100-40GB", "input_tokens": 10, "output_tokens": 20, "tokens_per_s": 10.0, "retries": 0, "last_error": None} | more


def record(i=0, **more):
    return {
        "id": f"r{i}", "prompt": f"a lamp {i}",
        "semantic_plan": {"subject": "Old Lamp", "environment": "a dark hall", "camera": "low angle", "mood": "quiet", "dominant_elements": ["dust"]},
        "layout": {"canvas": [1024, 1024], "entities": [{"id": "old_lamp", "kind": "object", "bbox": [0.4, 0.4, 0.6, 0.6], "z": 1}], "relations": [{"subject": "old_lamp", "predicate": "on", "object": "floor"}]},
        "composition": {"lens": "35mm", "rule_of_thirds": True, "subject_scale": 0.4, "leading_lines": False, "symmetry": False},
        "lighting": {"key_light": "window", "fill_light": "low", "rim_light": True, "contrast": "high"},
        "materials": {"materials": {"glass": "wet"}},
        "color_script": {"primary_palette": ["#A1B2C3"], "temperature": "cold", "saturation": "low"},
        "telemetry": {s: told() for s in V.STAGES}, "render": told(compute_s=3.0, projected_cost_usd=0.01), "meta": {"planner": "p", "created_at": f"2024-01-0{i + 1}T00:00:00+00:00", "n_variations": 2, "seed": 5},
        "dataset": {"license": "cc0", "code_version": "v1", "split": "train", "quality": {"clip_score": 0.3, "passed_gate": i % 2 == 0}, "safety": {"nsfw": 0.1}}, "final_image": "x.webp", "visual_tokens": ["A", "B"], "enriched_prompt": None,
    } | more


@pytest.fixture
def frame(spark, tmp_path):
    def make(rows):
        (tmp_path / "r.jsonl").write_text("\n".join([*map(json.dumps, rows), ""]))
        return files.read_jsonl(spark, str(tmp_path / "r.jsonl"))

    return make


def test_tokens_and_prompt(frame):
    r = frame([record()]).select(T.visual_tokens().alias("t"), T.render_prompt().alias("p"), T.compact_prior("layout").alias("c")).first()
    assert r["t"] == ["PLAN_SUBJ:old-lamp", "ENV:a-dark-hall", "CAM:low-angle", "MOOD:quiet", "ELEM:dust", "AT:old-lamp:object:center", "REL:old-lamp:on:floor", "LENS_35MM", "THIRDS", "SCALE:0.4", "LIGHT_KEY:window", "FILL_LOW", "RIM", "CONTRAST_HIGH", "MAT:glass:wet", "COLOR_COLD", "SAT_LOW", "PAL:#a1b2c3", "RENDER"]
    assert r["p"] == "Old Lamp in a dark hall. low angle shot. quiet mood. composition: 35mm lens, subject scale 0.4, rule of thirds. lighting: window key light, low fill, rim light, high contrast. materials: glass wet. color script: cold palette (#A1B2C3), low saturation. spatial relations: old lamp on floor. featuring dust. highly detailed, cinematic"
    assert r["c"] == "entities=[old_lamp(object)]; relations=[old_lamp on floor]"


def bad(**parts):
    out = record()
    for path, value in parts.items():
        at, *names = path.split("__")
        node = out[at]
        for n in names[:-1]:
            node = node[int(n)] if n.isdigit() else node[n]
        node[int(names[-1]) if names[-1].isdigit() else names[-1]] = value
    return out


@pytest.mark.parametrize(
    "row,error",
    [
        (bad(layout__entities__0__bbox=[0.0, 0.0, 1.2, 1.0]), "entity_box"),
        (bad(layout__entities__0__bbox=[0.5, 0.0, 0.5, 1.0]), "entity_box"),
        (bad(layout__entities__0__bbox=[0.0, 0.0, 1.0, 1.0]), "entity_full_frame"),
        (bad(layout__relations__0__object="ghost"), "relation_ends"),
        (bad(layout__relations__0__predicate="beside"), "relation_predicate"),
        (bad(composition__subject_scale=2.0), "composition"),
        (bad(lighting__contrast="extreme"), "lighting"),
        (bad(materials__materials={"glass": " "}), "materials"),
        (bad(color_script__primary_palette=["#zzzzzz"]), "palette"),
        (bad(dataset__split="holdout"), "split"),
        (bad(telemetry__odd=told()), "telemetry_stages"),
        (record(images=[{"path": "a", "idx": -1, "width": 0, "height": 1}]), "images"),
    ],
)
def test_invalid_records(frame, row, error):
    assert T.validate(frame([row])).first()["errors"] == [error]


def test_valid_and_normalised(frame):
    row = bad(layout__relations__0__predicate=" On_Top_Of", color_script__temperature="cool")
    df = T.normalised(frame([row]))
    assert T.validate(df).first()["errors"] == []
    assert df.select("color_script.temperature", F.col("layout.relations")[0]["predicate"]).first()[:] == ("cold", "on")


def test_examples_and_totals(frame):
    df = frame([record()])
    r = df.select(T.chat_example("sys").alias("m"), T.token_target().alias("t"), *[c.alias(k) for k, c in T.totals().items()]).first()
    assert [m["role"] for m in r["m"]] == ["system", "user", "assistant"] and json.loads(r["m"][2]["content"])["visual_tokens"] == ["A", "B"]
    assert r["t"]["completion"] == "A B" and (r["total_compute_s"], r["e2e_compute_s"], r["e2e_cost_usd"]) == (12, 15, 0.022)


def test_assemble_resets_dataset(spark, frame):
    renders = spark.createDataFrame([("r0", "new", None, None, [("a", "s", 0, 1, 1, 7)])], "id string, prompt string, seed long, telemetry struct<compute_s:double,rate_usd_per_s:double,cost_usd:double,projected_cost_usd:double,gpu:string>, images array<struct<path:string,sha256:string,idx:int,width:int,height:int,seed:bigint>>")
    r = assemble.assemble(renders, frame([record(), record(1)]), license_name="mit", code_version="v2").collect()
    assert len(r) == 1 and r[0]["enriched_prompt"] == "new" and r[0]["meta"]["seed"] is None and r[0]["render"] is None
    assert r[0]["dataset"]["license"] == "mit" and r[0]["dataset"]["split"] is None and r[0]["dataset"]["quality"] is None


def test_images_and_shards(spark, frame, tmp_path):
    import tarfile

    df = frame([record(i) for i in range(3)])
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "r0_1.webp").write_bytes(b"im")
    images = files.image_files(spark, str(tmp_path / "img"))
    assert {(r["id"], r["n_images"]) for r in assemble.image_counts(df, images).collect()} == {("r0", 1), ("r1", 0), ("r2", 0)}
    content = spark.read.format("binaryFile").load(str(tmp_path / "img")).select(F.lit("r0").alias("id"), F.lit(1).alias("idx"), "content")
    placed = shards.with_shards(df, "id", 2).withColumn("json", F.to_json(F.struct("id", "prompt")))
    made = files.write_shards(placed, str(tmp_path / "arch"), content).orderBy("shard").collect()
    assert [(r["shard"], r["n_records"], r["n_images"]) for r in made] == [("shard-00000.tar", 2, 1), ("shard-00001.tar", 1, 0)]
    assert sorted(f.name for f in (tmp_path / "arch").iterdir()) == ["shard-00000.tar", "shard-00001.tar"]
    assert tarfile.open(tmp_path / "arch" / "shard-00000.tar").getnames() == ["r0.json", "r0.1.webp", "r1.json"]
    index = shards.index_rows(placed.withColumn("n_images", F.lit(0))).orderBy("id").first()
    assert index["gate_reasons"] == [] and index["split"] == "train" and len(index) == 18
    assert shards.manifest(df, "id").first()["license"] == "cc0"


def test_summaries(frame):
    df = frame([record(i) for i in range(3)])
    r = quality.pack_summary(df, ["clip_score", "aesthetic"]).first()
    assert (r["passed"], r["failed"], r["clip_score_mean"], r["aesthetic_mean"]) == (2, 1, 0.3, None)
    assert {x["split"]: x["n"] for x in quality.split_counts(df.select(F.lit(None).cast("string").alias("s")), "s").collect()} == {"train": 0, "val": 0, "test": 0, "unassigned": 3}


def test_report(spark, frame, tmp_path):
    df = frame([record(0), record(1, render=None)])
    runs = spark.createDataFrame([("render", "2024-01-01", 1.0, 2.0), (None, "2024-01-02", 0.5, None)], "kind string, started_at string, total_cost_usd double, real_cost_est_usd double")
    boxes = spark.createDataFrame([(1.0, 0.5, 0.3, 0.2, 10.0)], "real_cost_usd double, gpu_cost_usd double, cpu_cost_usd double, mem_cost_usd double, billed_s double")
    out = report.build(df, runs, boxes)
    assert out["n_traces"] == 2 and out["totals"]["n_rendered"] == 1 and out["totals"]["first_try_valid_rate"] == 1 and out["totals"]["e2e_usd_total"] == pytest.approx(0.034)
    assert out["ledger"]["by_kind"] == {"render": 1, "?": 1} and out["billed"]["real_to_marginal_ratio"] == pytest.approx(29.41)
    at = report.write_bundle(out, df, str(tmp_path / "rep"))
    assert (tmp_path / "rep" / "latest.md").read_text().startswith("# Report") and json.load(open(f"{at}/report.json"))["n_traces"] == 2
    assert report.build(df.limit(0))["n_traces"] == 0


def test_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("one\n\n  two \nthree\n")
    assert [r["prompt"] for r in files.read_prompts(spark, str(tmp_path / "p.txt"), 2).orderBy("pos").collect()] == ["one", "two"]
    assert files.read_optional(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.append_records(df, str(tmp_path / "o"))
    files.append_records(df, str(tmp_path / "o"))
    lines = [x for f in (tmp_path / "o").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == ['{"a":1,"b":null}'] * 2
    (tmp_path / "s.csv").write_text("id,clip,human_good\na,0.5,1\nb,None,0\nc,,\n")
    from loomlake.operators.calibration import labelled

    got = labelled(files.read_sheet(spark, str(tmp_path / "s.csv")), ["clip"]).orderBy("id").collect()
    assert [(r["id"], r["clip"], r["human_good"]) for r in got] == [("a", 0.5, 1), ("b", None, 0)]


def test_stages_retry(spark):
    ticks = iter(range(100))
    client = produce.ScriptedClient(["no json", '<think>{x}</think>```json\n{"v": 1}\n```'])

    def check(x):
        if "v" not in x:
            raise ValueError("no v")
        return x

    answer, info = produce.run_stage(client, "s", "u", check, retries=1, clock=lambda: float(next(ticks)))
    assert answer == {"v": 1} and info["retries"] == 1 and info["compute_s"] == 2 and info["last_error"] and "does not fit" in client.asked[1]
    with pytest.raises(produce.StageFailed):
        produce.run_stage(produce.ScriptedClient(["a", "b"]), "s", "u", check, retries=1)
    whole = produce.plan(produce.ScriptedClient(['{"v": 1}'] * 6), "p", dict.fromkeys(V.STAGES, check))
    assert list(whole["telemetry"]) == V.STAGES
    with pytest.raises(produce.StageFailed):
        produce.plan(produce.ScriptedClient(['{"v": 1}'] * 3), "p")


def test_producer_keeps_failed_rows(spark):
    def make():
        def work(row):
            if row["id"] == 2:
                raise RuntimeError("boom")
            return {"double": row["id"] * 2}

        return work

    got = produce.produce(spark.range(4), make, "double long", key="id").orderBy("id").collect()
    assert [r["double"] for r in got] == [0, 2, None, 6] and got[2]["error"] == "RuntimeError: boom"


def test_tracking():
    rows = []
    with pytest.raises(KeyError), produce.tracked(rows.append, "x", n=1):
        raise KeyError("k")
    with produce.tracked(rows.append, "y") as r:
        r["total_cost_usd"] = 2.0
    assert [r["status"] for r in rows] == ["error", "ok"] and rows[0]["n"] == 1
    clock = iter([0.0, 52.0])
    meter = produce.Meter("T4", lambda: None, lambda: None, lambda: next(clock)).start()
    assert meter.stop(120.0)["billed_s"] == 172 and meter.stop()["billed_s"] == 172 and not meter.result["measured"]


def test_ledger_stream(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text('{"kind": "render", "total_cost_usd": 1.5}\n{"kind": "render", "total_cost_usd": 0.5}\n{"total_cost_usd": 1.0}\n')
    q = ledger.start(ledger.by_kind(ledger.read_runs(spark, str(tmp_path / "l"))), "totals", str(tmp_path / "c"))
    q.awaitTermination(120)
    assert {(r["kind"], r["n_runs"], r["total_cost_usd"]) for r in spark.table("totals").collect()} == {("render", 2, 2.0), ("?", 1, 1.0)}


def test_command_line(capsys):
    from loomlake.cli import main

    assert main(["cost", "a100", "2", "--samples", "2"]) == 0 and capsys.readouterr().out.strip() == "0.00277600"
    assert main(["query"]) == 0 and "by_stratum" in capsys.readouterr().out


def test_sinks_commit_whole_files(spark, tmp_path):
    """Archives hold what was written, members in order; failed tasks and jobs leave nothing, files of one name are replaced."""
    import hashlib
    import os

    from loomlake.sources import sinks

    rows = [(f"a{i % 3}.tar", f"m{i}", i, os.urandom(i * 97)) for i in range(40)] + [("a0.tar", "none", 99, None), ("big.tar", "big", 1, b"x" * 3_000_000)]
    df = spark.createDataFrame(rows, "archive string, name string, nth int, data binary").repartition(5)
    folder = f"file://{tmp_path}/archives"
    sinks.write_archives(df, folder, ["nth"])
    got = {(r["archive"], r["nth"]): (r["name"], r["size"], r["sha256"]) for r in sinks.archive_members(spark, folder).collect()}
    want = {}
    for archive in {r[0] for r in rows}:
        for nth, r in enumerate(sorted((r for r in rows if r[0] == archive), key=lambda r: r[2])):
            want[archive, nth] = (r[1], len(r[3] or b""), hashlib.sha256(r[3] or b"").hexdigest())
    assert got == want and sorted(os.listdir(tmp_path / "archives")) == ["a0.tar", "a1.tar", "a2.tar", "big.tar"]
    sizes = {r["archive"]: r["bytes"] for r in sinks.archive_files(spark, folder).collect()}
    assert sizes["big.tar"] == os.path.getsize(tmp_path / "archives" / "big.tar")
    bad = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), (F.col("id") % 30).cast("string")).alias("name"), F.when(F.col("id") < 39, F.lit(b"x")).otherwise(F.raise_error(F.lit("broken")).cast("binary")).alias("data"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_files(bad, str(tmp_path / "single"))
    assert not [f for f in (tmp_path / "single").glob("*") if not f.name.startswith("_staging-")]
    assert spark.read.format("binaryFile").load(str(tmp_path / "single")).count() == 0
    sinks.write_files(bad.filter("name = 'f1'").limit(1).withColumn("data", F.lit(b"old")), str(tmp_path / "single"))
    sinks.write_files(spark.range(0, 30, 1, 4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit(b"new").alias("data")), str(tmp_path / "single"))
    assert {f.name: f.read_bytes() for f in (tmp_path / "single").glob("f*")} == {f"f{i}": b"new" for i in range(30)}
    sinks.write_archives(df.limit(0), f"{tmp_path}/empty", ["nth"])
    assert files.shard_counts(spark, f"{tmp_path}/empty").count() == 0
    writer = sinks.SingleFiles(str(tmp_path / "twice"))
    at, place, staging = writer.staging()
    for attempt in (1, 2):  # two attempts of one task: what one of them staged is taken
        at.create_dir(f"{staging}/0-{attempt}")
        with at.open_output_stream(f"{staging}/0-{attempt}/f") as out:
            out.write(b"%d" % attempt)
    writer.commit([sinks.Written(f"{staging}/0-2", ["f"]), None])
    assert [(f.name, f.read_bytes()) for f in (tmp_path / "twice").iterdir()] == [("f", b"2")]
