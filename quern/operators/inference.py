"""Text generation by pluggable providers, in the workers, once per prompt."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

RESULT = "response string, model string, tokens_used struct<prompt:int,completion:int,total:int>, latency_ms double, provider string, error string"
#: Default models (fixed values).
MODELS = {
    "ollama": "llama2",
    "huggingface": "mistralai/Mistral-7B-Instruct-v0.2",
    "anthropic": "claude-3-sonnet-20240229",
    "openai": "gpt-4-turbo",
    "gemini": "gemini-1.5-pro",
    "extractive": "first-context-line",
}
BLOCKED, NO_RESPONSE = "[Blocked by safety filter or other candidate issue]", "[No response generated]"


class Client(Protocol):
    def __call__(self, prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int] | tuple[str, int, int, int]:
        """The response, the tokens of prompt and completion, and in all where the provider counts these itself."""


def extractive(model: str, settings: dict) -> Client:
    """Offline: answers with the first line below the first context header, or the last line of the prompt."""

    def call(prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int]:
        _, found, rest = prompt.partition("\n[Source: ")
        lines = rest.split("\n") if found else prompt.split("\n")[-1:]
        answer = " ".join((lines[1] if found and len(lines) > 1 else lines[-1]).split()[:max_tokens])
        return answer, len(prompt.split()), len(answer.split())

    return call


def ollama(model: str, settings: dict) -> Client:
    client = _import("ollama").Client(host=settings.get("base_url", "http://localhost:11434"))

    def call(prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int]:
        r = client.generate(model=model, prompt=prompt, options={"num_predict": max_tokens, "temperature": temperature})
        return r["response"], r.get("prompt_eval_count", 0), r.get("eval_count", 0)

    return call


def huggingface(model: str, settings: dict) -> Client:
    hub = _import("transformers")
    tokenizer, net = hub.AutoTokenizer.from_pretrained(model), hub.AutoModelForCausalLM.from_pretrained(model, load_in_8bit=settings.get("load_in_8bit", False)).to(settings.get("device", "cpu"))

    def call(prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int]:
        ids = tokenizer(prompt, return_tensors="pt").to(net.device)
        n = ids["input_ids"].shape[1]
        out = net.generate(**ids, max_new_tokens=max_tokens, temperature=temperature, do_sample=temperature > 0)[0][n:]
        return tokenizer.decode(out, skip_special_tokens=True), int(n), len(out)

    return call


def anthropic(model: str, settings: dict) -> Client:
    client = _import("anthropic").Anthropic(api_key=settings.get("api_key") or os.getenv("ANTHROPIC_API_KEY"))

    def call(prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int]:
        r = client.messages.create(model=model, max_tokens=max_tokens, temperature=temperature, messages=[{"role": "user", "content": prompt}])
        return r.content[0].text, r.usage.input_tokens, r.usage.output_tokens

    return call


def openai(model: str, settings: dict) -> Client:
    client = _import("openai").OpenAI(api_key=settings.get("api_key") or os.getenv("OPENAI_API_KEY"))

    def call(prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int]:
        r = client.chat.completions.create(model=model, max_tokens=max_tokens, temperature=temperature, messages=[{"role": "user", "content": prompt}])
        return r.choices[0].message.content, r.usage.prompt_tokens, r.usage.completion_tokens

    return call


def gemini(model: str, settings: dict) -> Client:
    api = _import("google.generativeai")
    key = settings.get("api_key") or os.getenv("GEMINI_API_KEY") or os.getenv("GOOGLE_API_KEY")
    if not key:
        raise ValueError("gemini needs an API key")
    api.configure(api_key=key)
    client = api.GenerativeModel(model)

    def call(prompt: str, max_tokens: int, temperature: float) -> tuple[str, int, int, int]:
        try:
            r = client.generate_content(prompt, generation_config={"max_output_tokens": max_tokens, "temperature": temperature})
            usage = getattr(r, "usage_metadata", None)
            try:
                text = r.text
            except ValueError:  # a response without text has been blocked, or is none
                text = BLOCKED if r.candidates else NO_RESPONSE
            return (text, usage.prompt_token_count, usage.candidates_token_count, usage.total_token_count) if usage else (text, 0, 0, 0)
        except Exception as e:
            raise RuntimeError(f"Gemini generation failed: {e}") from e

    return call


def _import(name: str):
    from importlib import import_module

    try:
        return import_module(name)
    except ImportError as e:
        raise RuntimeError(f"Install {name} to use this provider") from e


PROVIDERS: dict[str, Callable[[str, dict], Client]] = {"ollama": ollama, "huggingface": huggingface, "anthropic": anthropic, "openai": openai, "gemini": gemini, "extractive": extractive}


def with_retry(call: Callable[[], dict], max_retries: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """What ``call`` returns at one of ``max_retries`` tries; between them waits of backoff, 2 backoff, 4 backoff..."""
    last = None
    for attempt in range(max_retries):
        try:
            return call()
        except Exception as e:
            last = e
            if attempt + 1 < max_retries:
                sleep(backoff * 2**attempt)
    raise RuntimeError(f"Failed after {max_retries} attempts: {last}")


def wait_for(message: str, retries: int) -> int | None:
    """Units to wait before another try, by what an error's text says; None if it says nothing of that kind."""
    low = message.lower()
    if "rate limit" in low or "429" in low:
        return (retries + 1) * 2
    return 1 if "timeout" in low or "connection" in low else None


class Inference:
    """A provider and its model, named on the driver and made once per Python worker."""

    def __init__(self, provider: str = "extractive", model: str | None = None, settings: dict | None = None, client: Client | None = None) -> None:
        self.provider = provider.lower()
        if client is None and self.provider not in PROVIDERS:
            raise ValueError(f"Unsupported provider: {provider}")
        self.model, self.settings, self._client = model or MODELS.get(self.provider, self.provider), settings or {}, client

    def client(self) -> Client:
        return self._client or PROVIDERS[self.provider](self.model, self.settings)

    def generate_one(self, prompt: str, max_tokens: int = 1000, temperature: float = 0.7, client: Client | None = None) -> dict:
        began = time.perf_counter()
        text, asked, answered, *counted = (client or self.client())(prompt, max_tokens, temperature)
        used = {"prompt": int(asked), "completion": int(answered), "total": int(counted[0] if counted else asked + answered)}
        return {"response": text, "model": self.model, "tokens_used": used, "latency_ms": (time.perf_counter() - began) * 1000, "provider": self.provider}

    def generate_one_with_retry(self, prompt: str, max_retries: int = 3, backoff: float = 1.0, **options) -> dict:
        return with_retry(lambda: self.generate_one(prompt, **options), max_retries, backoff)

    def try_one(self, prompt: str, max_tokens: int, temperature: float, client: Client | None = None, max_retries: int = 1, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
        """The answer, or after ``max_retries`` tries a row with the last error; it waits ``backoff`` seconds for each unit that the error's class asks, or 1, 2, 4... units."""
        error = f"{max_retries} tries"
        for attempt in range(max_retries):
            try:
                return {**self.generate_one(prompt, max_tokens, temperature, client), "error": None}
            except Exception as e:
                error = str(e) or type(e).__name__
                if attempt + 1 < max_retries:
                    units = wait_for(error, attempt)
                    sleep(backoff * (2**attempt if units is None else units))
        return {"response": None, "model": self.model, "tokens_used": None, "latency_ms": None, "provider": self.provider, "error": error}

    def generate(self, prompts: DataFrame, prompt: str = "prompt", max_tokens: int = 1000, temperature: float = 0.7, max_retries: int = 1, backoff: float = 1.0, batch: int = 64) -> DataFrame:
        """``prompts``, computed once, with the columns of ``RESULT``. Equal prompts are asked once; one that fails has its error and no response. Write the result before using it twice: a plan that runs again asks again (``ledger.AnswerLedger`` never does)."""
        me, prompts = self, durable(prompts)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = None
            for frame in batches:
                for at in range(0, len(frame), batch):
                    asked = list(frame["_asked_prompt"][at : at + batch])
                    client = client or (me.client() if asked else None)
                    rows = [me.try_one(p, max_tokens, temperature, client, max_retries, backoff) for p in asked]
                    yield pd.DataFrame({"_asked_prompt": asked, **{c: [r[c] for r in rows] for c in ("response", "model", "tokens_used", "latency_ms", "provider", "error")}})

        distinct = prompts.select(F.col(prompt).alias("_asked_prompt")).distinct()
        answers = distinct.mapInPandas(run, f"_asked_prompt string, {RESULT}")
        return prompts.join(answers, F.col(prompt).eqNullSafe(F.col("_asked_prompt"))).drop("_asked_prompt")


def available(prefer_local: bool = True) -> Inference:
    """A local server if one answers, else a provider whose key is set, else the local one."""
    if prefer_local:
        try:
            _import("ollama").Client().list()
            return Inference("ollama")
        except Exception:  # no server: try the keys
            pass
    for key, provider in (("ANTHROPIC_API_KEY", "anthropic"), ("OPENAI_API_KEY", "openai")):
        if os.getenv(key):
            return Inference(provider)
    return Inference("ollama")


def error_class(message: Column, retries: Column) -> Column:
    """struct<should_retry, wait_time, message> of an API error's text after so many retries."""
    low = F.lower(message)
    limited = low.contains("rate limit") | low.contains("429")
    lost = low.contains("timeout") | low.contains("connection")
    wait = F.when(limited, (retries + 1) * 2).when(lost, F.lit(1)).otherwise(F.lit(0)).cast("int")
    return F.struct(F.coalesce(limited | lost, F.lit(False)).alias("should_retry"), wait.alias("wait_time"), message.alias("message"))


def read_verdict(answer: str | None) -> tuple[float, str | None]:
    """Score and reason of a judge's answer: code fences go, the rest is JSON; what can't be read scores 0 with the error as reason."""
    try:
        data = json.loads(re.sub(r"```json\n?|\n?```", "", answer))
        reason = data.get("reason", "")
        return float(data.get("score", 0.0)), reason if reason is None or isinstance(reason, str) else json.dumps(reason)
    except Exception as e:
        return 0.0, f"Error calculating score: {e}"


def judged(response: Column) -> Column:
    """struct<score, reason> of a judge's answer; read in Python, where the answer was made, since JSON's errors are part of it."""

    @F.pandas_udf("score double, reason string")
    def verdicts(answers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_verdict(x) for x in answers], columns=["score", "reason"])

    return verdicts(response)
