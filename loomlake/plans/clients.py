"""Clients and readings from outside Spark."""

from __future__ import annotations

import json
import os
import subprocess
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from pathlib import Path

KEY_VARIABLE = "LOOMLAKE_API_KEY"


@dataclass
class HttpClient:
    """A chat-completion server; its failures are RuntimeErrors. api_key: sent as a bearer token, by default that of KEY_VARIABLE."""

    url: str
    model: str
    timeout: float = 120.0
    temperature: float = 0.2
    api_key: str | None = field(default_factory=lambda: os.environ.get(KEY_VARIABLE), repr=False)

    def complete(self, system: str, user: str, *, json_mode: bool = True) -> tuple[str, int, int]:
        """Text, input tokens and output tokens of one answer."""
        body: dict = {"model": self.model, "temperature": self.temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if json_mode:
            body["response_format"] = {"type": "json_object"}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        call = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as reply:
                found = json.load(reply)
        except urllib.error.URLError as e:
            raise RuntimeError(f"no answer from {self.url}: {e}") from e
        used = found.get("usage") or {}
        return found["choices"][0]["message"]["content"], int(used.get("prompt_tokens", 0)), int(used.get("completion_tokens", 0))


def first_number(files: list[tuple[str, str | None, float]]) -> float | None:
    """The first reading of (file, word before the number, unit) that is there."""
    for path, word, unit in files:
        try:
            text = Path(path).read_text()
            value = text if word is None else next(line.split()[1] for line in text.splitlines() if line.startswith(word))
            return int(value) * unit
        except (OSError, ValueError, StopIteration, IndexError):
            continue
    return None


def cpu_core_seconds(root: str = "/sys/fs/cgroup") -> float | None:
    """CPU seconds of this container, by control groups of version 2 or 1; None without either."""
    return first_number([(f"{root}/cpu.stat", "usage_usec", 1e-6), (f"{root}/cpuacct/cpuacct.usage", None, 1e-9)])


def memory_peak_gib(root: str = "/sys/fs/cgroup") -> float | None:
    return first_number([(f"{root}/memory.peak", None, 2.0**-30), (f"{root}/memory/memory.max_usage_in_bytes", None, 2.0**-30), (f"{root}/memory.current", None, 2.0**-30)])


def code_version(folder: str = ".") -> str:
    """The short commit of a checkout, 'unknown' without one."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip() or "unknown"
    except (OSError, subprocess.SubprocessError):
        return "unknown"
