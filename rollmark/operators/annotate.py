"""The pluggable text annotator: any function from prompts to answers, called in Arrow batches.

A model behind a network is such a function; nothing of a provider is part of this engine. The
mock is deterministic, so results can be compared. A failed call becomes an error text, and the
fallbacks are ordinary columns.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import token_estimate
from ..session import ship_package


class Annotator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def with_retries(call: Annotator, attempts: int = 3, first: float = 1.0, factor: float = 2.0, most: float = 60.0, retryable: Callable[[Exception], bool] | None = None, sleep=time.sleep) -> Annotator:
    """Call again after growing waits while the error is worth it."""
    worth = retryable or (lambda e: bool(re.search(r"rate|timeout|overload|unavailable|429|5\d\d", str(e), re.I)))

    def run(prompts: list[str]) -> list[str]:
        for n in range(attempts):
            try:
                return call(prompts)
            except Exception as e:
                if n == attempts - 1 or not worth(e):
                    raise
                sleep(min(first * factor**n, most))
        raise AssertionError

    return run


def mock_annotator(prompts: list[str]) -> list[str]:
    """Assigns each entity in a consolidation prompt the first number of its records, and else lists
    the capitalised words of a prompt as patterns."""
    out = []
    for prompt in prompts:
        blocks = re.findall(r"(?m)^\[(.+?)\]\n((?:  - .*\n?)+)", prompt)
        if blocks:
            found = []
            for entity, lines in blocks:
                number = re.search(r"\d+", lines)
                found.append({"soldier_id": entity, "regiment": number[0] if number else None, "confidence": "moderate" if number else "tentative"})
            out.append(json.dumps({"assignments": found}))
        else:
            words = sorted({w for w in re.findall(r"\b[A-Z][a-z]{3,}\b", prompt)})[:5]
            out.append("```json\n" + json.dumps({"patterns": [{"pattern": w, "means": "mentioned", "tier": "tentative"} for w in words]}) + "\n```")
    return out


def annotate(frame: DataFrame, prompt_col: str, annotator: Annotator, batch: int = 32) -> DataFrame:
    """Add answer and error (null where the call went well)."""
    ship_package(frame.sparkSession)
    schema = StructType([*frame.schema.fields]).add("answer", "string").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            prompts, answers, errors = rows[prompt_col].fillna("").tolist(), [], []
            for s in range(0, len(prompts), batch):
                part = prompts[s : s + batch]
                try:
                    answers += annotator(part)
                    errors += [None] * len(part)
                except (OSError, RuntimeError, ValueError) as e:  # what calls fail with; mistakes in code are raised
                    answers += [None] * len(part)
                    errors += [str(e)[:500]] * len(part)
            yield rows.assign(answer=answers, error=errors)

    return frame.mapInPandas(run, schema)


def answer_json(text: str | None):
    """The JSON in an answer, found as ``json_from_text`` finds it; None if there is none."""
    text = text or ""
    tries = [text]
    for form in (r"(?s)```(?:json|JSON)?\s*(.*?)```", r"(?s)(\{.*\})", r"(?s)(\[.*\])"):
        tries += re.findall(form, text)[:1]
    for found in tries:
        try:
            return json.loads(found)
        except ValueError:
            continue
    return None


def discover(batches: DataFrame, annotator: Annotator, inverted: bool = False, last: int = 25, attempts: int = 3) -> DataFrame:
    """Add prompt, answer and error to batches (component, batch, head, tail), asked one after the other.

    The batches of a component are taken in the order of ``batch``, or in the inverted order; each prompt shows
    the ``last`` patterns that the answers so far have given, each once, so later answers may depend on
    earlier ones. Components are independent of each other, and a component has as many batches as it has
    rivals. A failed call is repeated while that is worth it; then its error is kept and the fold goes on."""
    ship_package(batches.sparkSession)
    schema = StructType([*batches.schema.fields]).add("prompt", "string").add("answer", "string").add("error", "string")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        call = with_retries(annotator, attempts)
        rows = rows.sort_values("batch", ascending=not inverted, kind="stable")
        known: dict[str, str] = {}
        prompts, answers, errors = [], [], []
        for head, tail in zip(rows["head"], rows["tail"], strict=True):
            shown = "\n".join(f"  - {p}" for p in list(known.values())[-last:])
            prompts.append("\n\n".join([head, *(["KNOWN PATTERNS:\n" + shown] if shown else []), tail]))
            try:
                answers.append(call([prompts[-1]])[0])
                errors.append(None)
            except (OSError, RuntimeError, ValueError) as e:  # what calls fail with; mistakes in code are raised
                answers.append(None)
                errors.append(str(e)[:500])
            found = answer_json(answers[-1])
            for entry in found.get("patterns") or [] if isinstance(found, dict) else []:
                pattern = entry.get("pattern") if isinstance(entry, dict) else None
                if isinstance(pattern, str) and pattern.strip():
                    known.setdefault(pattern.strip().lower(), pattern)
        return rows.assign(prompt=prompts, answer=answers, error=errors)

    return batches.groupBy("component").applyInPandas(fold, schema)


def parse_batch_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys and one row per assignment in the answers; unparsable answers give none."""
    from ..functions.text import json_from_text

    schema = "struct<assignments:array<struct<soldier_id:string,division:string,regiment:string,battalion:string,company:string,confidence:string>>>"
    parsed = F.from_json(json_from_text(F.col("answer")), schema)
    return answers.select(*keys, F.inline(parsed["assignments"]))


def call_log(answers: DataFrame, model: str, prompt_col: str) -> DataFrame:
    """model, input_tokens, output_tokens of each call, estimated from its texts."""
    return answers.select(F.lit(model).alias("model"), token_estimate(F.col(prompt_col)).alias("input_tokens"), token_estimate(F.col("answer")).alias("output_tokens"))


def consolidate(batches: DataFrame, annotator: Annotator, known: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """Answers of batches, with the fallbacks as columns: no component hint, no artifact for it, a
    failed call, an answer that does not parse. known: component_hint of the artifacts there are."""
    hinted = batches.join(F.broadcast(known.select("component_hint").distinct().withColumn("_known", F.lit(True))), "component_hint", "left")
    reason = F.when(F.col("component_hint").isNull() | (F.col("component_hint") == "unknown"), "no_hint").when(F.col("_known").isNull(), "no_resolver")
    ready = hinted.withColumn("fallback", reason).drop("_known")
    called = annotate(ready.where("fallback IS NULL"), prompt_col, annotator)
    from ..functions.text import json_from_text

    judged = F.when(F.col("error").isNotNull(), "call_failed").when(json_from_text(F.col("answer")).isNull(), "unparsable")
    called = called.withColumn("fallback", judged)
    skipped = ready.where("fallback IS NOT NULL").withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    return called.unionByName(skipped)
