"""Model calls: retries, a log of the last calls, verdicts with a bounded memory, questions about passages.

The model itself is the caller's function; nothing here opens a connection.
"""

from __future__ import annotations

import random
import time
from collections import OrderedDict, deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

RETRIES, BASE_DELAY, LOGGED, PREVIEW, VERDICTS = 4, 1.0, 200, 500, 1000
QUESTION = 'Write one question that only this passage answers, as JSON with "question" and "ground_truth".\n\n'
#: What a message holds if a call is worth another try, and what a verifier may say.
RETRIABLE = ("429", "500", "502", "503", "504", "RESOURCE_EXHAUSTED")
SAYS = {"KEEP_DISTINCT": "KEEP", "REJECT_NEW": "REJECT", "MERGE": "MERGE"}


def is_retriable(error: Exception) -> bool:
    return any(x in str(error) for x in RETRIABLE)


def with_backoff(call: Callable, retries: int = RETRIES, delay: float = BASE_DELAY, retriable=is_retriable, sleep=time.sleep, draw=random.random):
    """call(), tried again after a random part of a delay that doubles; an error that isn't retriable is raised at once."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as error:
            if attempt == retries or not retriable(error):
                raise
            sleep(draw() * delay * 2**attempt)


class Bounded(OrderedDict):
    """A map of at most `most` entries; the oldest goes first, and a value set again keeps its age."""

    def __init__(self, most: int = VERDICTS):
        super().__init__()
        self.most = max(1, int(most))

    def __setitem__(self, key, value) -> None:
        if key not in self and len(self) >= self.most:
            self.popitem(last=False)
        super().__setitem__(key, value)


class Log:
    """The last calls, newest first, with the beginnings of prompt and response; recording never fails."""

    def __init__(self, most: int = LOGGED):
        self._rows: deque = deque(maxlen=most)

    def call(self, generate: Callable[[str], str], prompt: str, purpose: str | None = None, model: str | None = None) -> str:
        began, response, error = time.time(), None, None
        try:
            response = generate(prompt)
            return response
        except Exception as e:
            error = str(e)
            raise
        finally:
            cut = lambda s: None if s is None else str(s)[:PREVIEW]
            self._rows.appendleft({
                "at": began, "purpose": purpose, "model": model, "prompt": cut(prompt), "response": cut(response), "seconds": time.time() - began,
                "status": "ok" if error is None else "error", "error": error, "input_size": len(prompt), "output_size": None if response is None else len(str(response)),
            })

    def rows(self) -> list[dict]:
        return list(self._rows)

    def clear(self) -> None:
        self._rows.clear()


class Verifier:
    """verdict(candidate, canonical) for operators.traits.fold: MERGE, KEEP or REJECT, remembered by pair.

    generate(prompt) is the model.  What it answers may stand in a sentence; another answer, or an error after
    all retries, counts as MERGE and isn't remembered.
    """

    def __init__(self, generate: Callable[[str], str], most: int = VERDICTS, **backoff):
        self.generate, self.known, self.backoff = generate, Bounded(most), backoff

    def __call__(self, candidate: str, canonical: str) -> str:
        if (candidate, canonical) in self.known:
            return self.known[candidate, canonical]
        prompt = f'Candidate trait: "{candidate}"\nKnown trait: "{canonical}"\nIs the candidate the same trait (MERGE), another one (KEEP_DISTINCT), or noise (REJECT_NEW)? Answer with one of these words.'
        try:
            said = str(with_backoff(lambda: self.generate(prompt), **self.backoff)).upper()
        except Exception:
            return "MERGE"
        verdict = next((v for word, v in SAYS.items() if word in said), None)
        if verdict is None:
            return "MERGE"
        self.known[candidate, canonical] = verdict
        return verdict


def replies(rows: DataFrame, prompt: str, generate: Callable[[str], str]) -> DataFrame:
    """The rows with `reply`, and `error` where the call failed; calls run in parallel by partition, with retries."""
    columns = rows.columns

    def run(batches):
        for pdf in batches:
            said, failed = [], []
            for text in pdf[prompt]:
                try:
                    said.append(with_backoff(lambda: generate(text)))  # noqa: B023
                    failed.append(None)
                except Exception as e:
                    said.append(None)
                    failed.append(str(e))
            pdf["reply"], pdf["error"] = pd.Series(said, index=pdf.index, dtype=object), pd.Series(failed, index=pdf.index, dtype=object)
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, reply string, error string").select(*columns, "reply", "error")


def questions(passages: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """id, question, ground_truth, source_chunk, chunk_offset.  passages: idx (from 0), chunk_offset, chunk.

    A passage whose reply holds no object with both fields gives none.
    """
    asked = passages.withColumn("prompt", F.concat(F.lit(QUESTION), "chunk"))
    forms = F.transform(X.json_candidates("reply"), lambda c: F.from_json(c, "question string, ground_truth string"))
    found = F.get(F.filter(forms, lambda x: (x["question"] != "") & (x["ground_truth"] != "")), F.lit(0))
    out = replies(asked, "prompt", generate).withColumn("q", found).where("q IS NOT NULL")
    return out.select(F.format_string("q-%03d", F.col("idx") + 1).alias("id"), "q.question", "q.ground_truth", F.col("chunk").alias("source_chunk"), "chunk_offset")


def backfill_context(memory: DataFrame, blurb, around: int = 4) -> DataFrame:
    """The memory with context_prefix filled where it is null.  blurb(chat, surrounding, text) is a column; an empty one fills nothing.

    Only rows without a prefix ask for their neighbours, by equal (chat, index), so that a long chat isn't one task.
    Rows without a chat or an index have no neighbours, and keep no prefix.
    """
    said = F.coalesce(*[c for c in ("raw_text", "content") if c in memory.columns])
    rows = memory.withColumn("_said", said)
    lacking = rows.where("context_prefix IS NULL AND chat_id IS NOT NULL AND message_index IS NOT NULL").select("id", "chat_id", "_said", F.explode(F.sequence(F.col("message_index") - around, F.col("message_index") + around)).alias("message_index"))
    near = rows.select("chat_id", "message_index", "node_id", F.col("_said").alias("_near"))
    texts = F.array_sort(F.collect_list(F.struct("message_index", "node_id", "_near")))
    told = lacking.join(near, ["chat_id", "message_index"]).groupBy("id", "chat_id").agg(F.first("_said").alias("_said"), F.array_join(F.transform(texts, lambda x: x["_near"]), "\n---\n").alias("_around"))
    filled = told.select("id", F.nullif(blurb(F.col("chat_id"), F.col("_around"), F.col("_said")), F.lit("")).alias("_blurb"))
    out = memory.join(filled, "id", "left").withColumn("context_prefix", F.coalesce("context_prefix", "_blurb"))
    return out.select(*memory.columns)
