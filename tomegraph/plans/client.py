"""Calls to a language model as a replayable table (LLM-13, SNK-4).

Replies are written to a table before anything reads them, so later plans don't pay for a call again; a task
that is lost before its part is committed does. `ledger.py` keeps calls over runs, in small parts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LLM_CALLS
from ..session import materialise

#: Calls that one task has in flight; models served locally get fewer.
IN_FLIGHT, IN_FLIGHT_LOCAL = 50, 5


class Client(Protocol):
    def complete(self, prompt: str, params: dict) -> tuple[str, str]:
        """Reply and finish reason."""


def prompt_hash(prompt: str, stage: str) -> str:
    return hashlib.sha256(f"{stage}\x00{prompt}".encode()).hexdigest()


class ReplayClient:
    """Recorded replies by prompt hash; an unknown prompt is an error."""

    def __init__(self, replies: dict[str, str]):
        self.replies = replies

    def complete(self, prompt: str, params: dict) -> tuple[str, str]:
        return self.replies[prompt_hash(prompt, params.get("stage", ""))], "stop"


class Known:
    """A reply that is there already."""

    def __init__(self, reply: tuple[str, str]):
        self.reply = reply

    def complete(self, prompt: str, params: dict) -> tuple[str, str]:
        return self.reply


class RuleClient:
    """Deterministic answers without a model: capitalised names are entities, the rest is echoed."""

    def complete(self, prompt: str, params: dict) -> tuple[str, str]:
        body = prompt.rpartition("### TEXT\n")[2]
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][\w']+(?: [A-Z][\w']+)*", body)))
        stage = params.get("stage", "")
        ids = [re.sub(r"[^a-z0-9]+", "_", n.lower()).strip("_") for n in names]
        if stage in ("graph", "entities"):
            nodes = [{"id": i, "label": n, "type": "Location"} for i, n in zip(ids, names, strict=True)]
            edges = [{"source": a, "target": b, "relationship": "near", "desc": ""} for a, b in zip(ids, ids[1:], strict=False)]
            return json.dumps({"nodes": nodes, "edges": edges}), "stop"
        if stage == "locations":
            return json.dumps({"location_ids": ids}), "stop"
        if stage == "resolve":
            return "{}", "stop"
        return body.strip()[:200] or "NO_SPATIAL_INFO", "stop"


class HttpClient:
    """A server with the common chat-completions interface; the key comes from an environment variable."""

    def __init__(self, url: str, model: str, key_variable: str = "LLM_API_KEY", timeout: float = 120):
        self.url, self.model, self.key_variable, self.timeout = url, model, key_variable, timeout

    def complete(self, prompt: str, params: dict) -> tuple[str, str]:
        from urllib.request import Request, urlopen

        fields = {k: v for k, v in params.items() if k in ("temperature", "top_p", "max_tokens", "stop", "response_format", "presence_penalty")}
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], **fields}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"}
        with urlopen(Request(f"{self.url.rstrip('/')}/chat/completions", body, head), timeout=self.timeout) as r:  # noqa: S310
            choice = json.load(r)["choices"][0]
        return choice["message"]["content"] or "", choice.get("finish_reason") or ""


def concurrency(model: str = "") -> int:
    """Calls in flight a task: LLM_CONCURRENCY, else by the kind of model."""
    default = IN_FLIGHT_LOCAL if re.search("qwen|local", model.lower()) else IN_FLIGHT
    return int(os.environ.get("LLM_CONCURRENCY", default))


#: Further tries of a call that fails, and seconds before the first of them; each waits twice as long as the one before.
RETRIES, BACK_OFF = 0, 0.5


def attempt(client: Client, key: str, prompt: str, stage: str, retries: int = RETRIES, back_off: float = BACK_OFF, **params) -> dict:
    """One call as a row of LLM_CALLS; the last error is the row's result."""
    row = {"prompt_hash": prompt_hash(prompt, stage), "stage": stage, "key": key, "prompt": prompt, "response": None, "status": "ok", "error": None, "finish_reason": None}
    for i in range(retries + 1):
        try:
            row["response"], row["finish_reason"] = client.complete(prompt, {"stage": stage, **params})
            return row | {"status": "ok", "error": None}
        except Exception as e:  # noqa: BLE001
            row |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
            if i < retries:
                time.sleep(back_off * 2**i)
    return row


def asked(prompts: DataFrame, client: Client, stage: str, at_once: int, **params) -> DataFrame:
    """llm_calls of prompts (key, prompt), at_once calls in flight a task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in it:
                rows = pool.map(lambda row: attempt(client, *row, stage, **params), zip(pdf["key"], pdf["prompt"], strict=True))
                yield pd.DataFrame(list(rows), columns=[c.split(" ")[0] for c in LLM_CALLS.split(", ")])

    return prompts.select(F.col("key").cast("string").alias("key"), "prompt").mapInPandas(run, LLM_CALLS)


def call(prompts: DataFrame, client: Client, stage: str, in_flight: int | None = None, **params) -> DataFrame:
    """llm_calls of prompts (key, prompt): one row each, an error never fails the stage; in_flight calls a task, concurrency() by default.

    A client with a ledger (ledger.Recorded) is asked only what the ledger doesn't hold.
    """
    if (ledger := getattr(client, "ledger", None)) is not None:
        return ledger.call(prompts, client.client, stage, in_flight=in_flight, **params)
    return materialise(asked(prompts, client, stage, in_flight or concurrency(getattr(client, "model", "")), **params), f"calls-{stage}")


def truncations(calls: DataFrame) -> DataFrame:
    """Calls that stopped at the length limit, with prompt and reply."""
    return calls.where("finish_reason = 'length'").select("stage", "key", "prompt", "response")
