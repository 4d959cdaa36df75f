"""Columns that outside models make: pluggable callables, run by Arrow batches with errors as data."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from loomlake.functions import vocabulary as V
from loomlake.plans.checks import STAGES
from loomlake.sources.files import exists


class Client(Protocol):
    def complete(self, system: str, user: str, *, json_mode: bool = True) -> tuple[str, int, int]:
        """Text, input tokens and output tokens."""
        ...


@dataclass
class ScriptedClient:
    """Replays answers in turn, for tests; a token is four characters."""

    answers: list[str]
    asked: list[str] = field(default_factory=list)

    def complete(self, system: str, user: str, *, json_mode: bool = True) -> tuple[str, int, int]:
        self.asked.append(user)
        if len(self.asked) > len(self.answers):
            raise RuntimeError("no answers left")
        text = self.answers[len(self.asked) - 1]
        count = lambda s: max(1, len(s)) // 4
        return text, count(system + user), count(text)


@dataclass
class LocalClient:
    """A model in this process: generate(system, user) gives the text and count(text) its tokens."""

    generate: Callable[[str, str], str]
    count: Callable[[str], int]

    def complete(self, system: str, user: str, *, json_mode: bool = True) -> tuple[str, int, int]:
        text = self.generate(system, user)
        return text, self.count(f"{system}\n{user}"), self.count(text)


def scored(score: Callable[[dict], float | None]) -> Callable[[dict], float | None]:
    """A scorer whose errors are missing values; scores have four digits."""

    def one(row: dict) -> float | None:
        try:
            found = score(row)
            return None if found is None else round(float(found), 4)
        except Exception:  # noqa: BLE001
            return None

    return one


class StageFailed(RuntimeError):
    """A stage without a valid answer after all attempts."""


def json_object(text: str) -> dict:
    """The JSON object of an answer: thinking and fences off, else from the first brace to the last."""
    import re

    bare = re.sub(r"(?is)<think>.*?</think>", "", text).strip()
    tries = [bare, re.sub(r"(?s)^```[a-zA-Z]*\s*|\s*```$", "", bare).strip()]
    if "{" in bare and "}" in bare:
        tries.append(bare[bare.index("{") : bare.rindex("}") + 1])
    for t in tries:
        try:
            found = json.loads(t)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError("no JSON object in the answer")


def run_stage(client: Client, system: str, user: str, check: Callable[[dict], dict], *, retries: int = 2, rate: float = 0.0, gpu: str = "unknown", clock: Callable[[], float] = time.perf_counter) -> tuple[dict, dict]:
    """Ask until the answer is valid: (answer, telemetry). Time and tokens of all attempts count; last_error is the last failure."""
    spent, into, out, error, prompt = 0.0, 0, 0, None, user
    for attempt in range(retries + 1):
        begin = clock()
        text, a, b = client.complete(system, prompt, json_mode=True)
        spent, into, out = spent + clock() - begin, into + a, out + b
        try:
            answer = check(json_object(text))
        except (ValueError, KeyError, TypeError) as e:
            error = str(e)
            prompt = f"{user}\n\nThe last answer does not fit the schema. Error:\n{error}\nReturn the corrected JSON object and nothing else."
            continue
        told = {"compute_s": spent, "rate_usd_per_s": rate, "projected_cost_usd": spent * rate, "projected_gpu": gpu, "input_tokens": into, "output_tokens": out, "tokens_per_s": out / spent if spent > 0 else 0.0, "retries": attempt, "last_error": error}
        return answer, told
    raise StageFailed(error)


def plan(client: Client, prompt: str, checks: dict[str, Callable[[dict], dict]] = STAGES, *, system: str = "", ask: Callable[[str, str, dict], str] | None = None, **options: object) -> dict:
    """All stages in order, each with the decisions before it; checks: what an answer to each stage must be."""
    done: dict[str, dict] = {}
    told: dict[str, dict] = {}
    for stage in V.STAGES:
        user = ask(stage, prompt, done) if ask else f"{prompt}\n{json.dumps(done)}\n{stage}"
        done[stage], told[stage] = run_stage(client, system, user, checks[stage], **options)
    return {"prompt": prompt, **done, "telemetry": told}


def produce(df: DataFrame, make: Callable[[], Callable[[dict], dict]], outputs: str, *, key: str, tasks: int | None = None, in_flight: int = 1) -> DataFrame:
    """Add what a model makes of each row: columns `outputs` (DDL) and error, null where all went well.

    make() runs once a partition and returns the function of one row, a dictionary of plain values; its exceptions
    become errors of their rows, with null outputs. in_flight: how many rows of a partition are asked for at once,
    by threads; rows keep their order. Write the result before using it twice, as models are not run again then.
    """
    if in_flight < 1:
        raise ValueError("in_flight must be 1 at least")
    made = StructType.fromDDL(outputs)
    schema = StructType([df.schema[key], *made, StructField("error", StringType())])
    rows = df.repartition(tasks, key) if tasks else df
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()

        def one(row: dict) -> dict:
            try:
                found = work(row)
                return {key: row[key], **{n: found.get(n) for n in made.names}, "error": None}
            except Exception as e:  # noqa: BLE001
                return {key: row[key], **dict.fromkeys(made.names), "error": f"{type(e).__name__}: {e}"}

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64).to_pylist()
                    out = list(map(one, part)) if in_flight == 1 else list(pool.map(one, part))
                    try:
                        yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    except (pa.ArrowException, TypeError, ValueError):
                        yield from map(typed, out)

    def typed(row: dict) -> pa.RecordBatch:
        try:
            return pa.RecordBatch.from_pylist([row], schema=kinds)
        except (pa.ArrowException, TypeError, ValueError) as e:
            return pa.RecordBatch.from_pylist([{key: row[key], "error": f"{type(e).__name__}: {e}"}], schema=kinds)

    return rows.mapInArrow(run, schema)


def produce_into(df: DataFrame, make: Callable[[], Callable[[dict], dict]], outputs: str, folder: str, *, key: str, tasks: int | None = None, in_flight: int = 1) -> DataFrame:
    """produce into a table that only grows: rows whose key has a result there are not asked for again.

    Each call writes a run of its own beside those before; a run that was killed has left the files that its tasks
    finished, and they count. Returns one row a key: its result, or the error of its last run without one.
    """
    spark = df.sparkSession
    runs = int(time.time() * 1e6)
    todo = df
    if exists(spark, folder):
        done = spark.read.parquet(folder).filter("error is null").select(key).distinct()
        todo = df.join(done, key, "left_anti")
    made = produce(todo, make, outputs, key=key, tasks=tasks, in_flight=in_flight)
    # The plain committer moves a task's files as the task ends, so that finished tasks of a killed run are there.
    made.withColumn("run", F.lit(runs)).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)
    rows = spark.read.parquet(folder)
    names = [c for c in rows.columns if c not in (key, "run")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(F.col("error").isNull(), "run")).alias("r"))
    return best.select(key, "r.*")


@contextmanager
def timed(rate: float = 0.0, clock: Callable[[], float] = time.perf_counter) -> Iterator[dict]:
    """Seconds and cost of a block, failed work too."""
    found: dict = {"compute_s": 0.0, "projected_cost_usd": 0.0, "rate_usd_per_s": rate}
    begin = clock()
    try:
        yield found
    finally:
        spent = clock() - begin
        found.update(compute_s=round(spent, 6), projected_cost_usd=round(spent * rate, 8))


@contextmanager
def tracked(append: Callable[[dict], None], kind: str, clock: Callable[[], float] = time.time, **fields: object) -> Iterator[dict]:
    """A ledger row for a block: its time, 'ok' or 'error', and what the block adds; appended in any case."""
    row: dict = {"kind": kind, **fields}
    begin = clock()
    row["started_at"] = time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime(begin))
    try:
        yield row
        row.setdefault("status", "ok")
    except BaseException as e:
        row.update(status="error", error=str(e))
        raise
    finally:
        row["wall_s"] = round(clock() - begin, 3)
        append(row)


@dataclass
class Meter:
    """Billed life of a container from injectable readers; without readings it falls back to the given ones."""

    gpu: str | None
    read_cpu: Callable[[], float | None]
    read_memory: Callable[[], float | None]
    clock: Callable[[], float] = time.monotonic
    memory_fallback_gib: float = 0.0
    began: float = 0.0
    cpu0: float | None = None
    result: dict | None = None

    def start(self) -> Meter:
        self.began, self.cpu0 = self.clock(), self.read_cpu()
        return self

    def stop(self, idle_s: float = 0.0) -> dict:
        """Cost parts; asked again it gives the same."""
        if self.result is None:
            life = self.clock() - self.began + idle_s
            cpu, memory = self.read_cpu(), self.read_memory()
            measured = memory is not None and cpu is not None and self.cpu0 is not None
            used = max((cpu or 0.0) - (self.cpu0 or 0.0), V.LEAST_CORES * life)
            gib = memory if memory is not None else self.memory_fallback_gib
            gpu = life * (V.GPU_RATES[V.GPU_ALIASES.get(self.gpu, self.gpu)] if self.gpu else 0.0)
            parts = {"gpu_cost_usd": gpu, "cpu_cost_usd": used * V.CPU_RATE, "mem_cost_usd": gib * life * V.MEMORY_RATE}
            self.result = {"billed_s": life, **parts, "real_cost_usd": sum(parts.values()), "measured": measured}
        return self.result
