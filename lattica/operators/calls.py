"""Calls of a text generator from executors: retries with growing waits, errors that end a job, bounded concurrency."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


class Generator(Protocol):
    """Answers a prompt with text; must be picklable. One with a true attribute `streams` may be given a prompt as `Parts`, and need not hold it whole."""

    def __call__(self, prompt: str) -> str: ...


class Parts:
    """A prompt as an iterable of its parts. What has been read is kept, so that a repeated call reads the same; the rest isn't held."""

    def __init__(self, parts: Iterator[str]):
        self._seen: list[str] = []
        self._rest = parts

    def __iter__(self) -> Iterator[str]:
        yield from self._seen
        for x in self._rest:
            self._seen.append(x)
            yield x


class FatalError(Exception):
    """What repeating will not cure: no access, no credit, no such model."""


#: Status codes of errors that repeating will not cure.
FATAL_CODES = re.compile(r"(?<!\d)(?:401|402|403|404)(?!\d)")


@dataclass(frozen=True)
class Policy:
    """How often a call is tried, how long it waits between tries (doubled up to a longest), how many run at once."""

    attempts: int = 3
    wait: float = 2.0
    longest: float = 30.0
    concurrent: int = 3
    sleep: Callable[[float], None] = time.sleep


def is_fatal(error: Exception) -> bool:
    return isinstance(error, FatalError) or bool(FATAL_CODES.search(str(error)))


def call(generator: Generator, prompt: str | Parts, policy: Policy = Policy()) -> str:
    """The generator's answer, stripped; its last error if all tries fail, at once if it is fatal."""
    for turn in range(policy.attempts):
        try:
            return (generator(prompt) or "").strip()
        except Exception as e:  # noqa: BLE001 - generators raise what they like
            if is_fatal(e):
                raise FatalError(str(e)) from e
            if turn + 1 == policy.attempts:
                raise
            policy.sleep(min(policy.longest, policy.wait * 2**turn))
    raise ValueError("a policy needs one attempt at least")


def _outcome(generator: Generator, prompt: str | Parts, policy: Policy) -> tuple[str | None, str | None]:
    """(output, error), one of them None; fatal errors are raised."""
    try:
        return call(generator, prompt, policy), None
    except FatalError:
        raise
    except Exception as e:  # noqa: BLE001
        return None, str(e)


def answered_parts(parts: DataFrame, generator: Generator, policy: Policy = Policy()) -> DataFrame:
    """(question_id, output, error) from prompts in parts (question_id, kind, part, text), as `answered` has them; a task reads its prompts part by part."""
    kind = parts.schema["question_id"].dataType
    schema = pa.schema([("question_id", to_arrow_type(kind)), ("output", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k.as_py(), t) for b in batches for k, t in zip(b.column("question_id"), b.column("text"), strict=True))
        for key, group in groupby(rows, key=itemgetter(0)):
            prompt = Parts(t.as_py() for _, t in group)
            output, error = _outcome(generator, prompt if getattr(generator, "streams", False) else "".join(prompt), policy)
            yield pa.RecordBatch.from_pylist([{"question_id": key, "output": output, "error": error}], schema)

    placed = parts.repartition(policy.concurrent, "question_id").sortWithinPartitions("question_id", "kind", "part").select("question_id", "text")
    return placed.mapInArrow(run, f"question_id {kind.simpleString()}, output string, error string")


def answered(df: DataFrame, prompt: str, generator: Generator, policy: Policy = Policy()) -> DataFrame:
    """`df` without its prompt column, plus output and error, one of them null. A fatal error fails the job.

    Every task calls in turn, so the number of partitions bounds the calls at once. Write the result before reading it twice.
    """
    rest = [c for c in df.columns if c != prompt]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != prompt), "output string", "error string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            outputs, errors = [], []
            for p in f[prompt]:
                output, error = _outcome(generator, p or "", policy)
                outputs.append(output)
                errors.append(error)
            out = f[rest].copy()
            out["output"], out["error"] = outputs, errors
            yield out

    return df.select(*rest, F.col(prompt)).repartition(policy.concurrent).mapInPandas(run, schema)
