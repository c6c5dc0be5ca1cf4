"""Results of a caller's own summariser, merged into the records."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.functions import rules
from talkloom.functions.text import appended, blank_to_null, unique_values
from talkloom.operators.records import SCOPE

RESULT = "summary string, generated_summary string, themes array<string>, topics array<string>, related_sermons array<string>, questionable_claims array<string>, skipped boolean"


def enrich(records: DataFrame, summarise: Callable[[dict], object], columns: list[str] | None = None, scope: list[str] = SCOPE, timeout: float = 180.0, workers: int = 1, kept: str | None = None) -> DataFrame:
    """scope, record_id, outcome (ok, empty, failed, timed out), output: ``summarise`` called for each record with its fields.

    It may return text, or a mapping that becomes JSON; what it raises becomes the
    outcome of that record alone, as does a call of more than ``timeout`` seconds.
    A task makes ``workers`` calls at a time (16 at most), each of which waits no
    longer than that; calls that never end keep a thread until the task ends.

    With ``kept``, a folder of any file system that Arrow knows, every good outcome
    is written there as it comes, under the digest of what was asked. A repeated
    task, a later run and equal records find it there and don't ask again.
    """
    workers = max(1, min(16, workers))
    kept = re.sub("^file:/+", "/", kept) if kept else None
    columns = columns or ["record_id", "title", "date", "speaker", "series", "primary_refs", "transcript_text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Kept(kept) if kept else None
        for b in batches:
            done = []
            for k in range(0, len(b), workers):
                asked = list(b["payload"][k : k + workers])
                known = {p: found.get(p) for p in asked} if found else {}
                running = {p: _started(summarise, p) for p in dict.fromkeys(asked) if not known.get(p)} if found else {n: _started(summarise, p) for n, p in enumerate(asked)}
                until = time.monotonic() + timeout
                told = {p: _outcome(x, until) for p, x in running.items()}
                for p, x in told.items() if found else ():
                    if x[0] in ("ok", "empty"):
                        found.put(p, x)
                done += [known.get(p) or told[p] for p in asked] if found else [told[n] for n in range(len(asked))]
            yield b[[*scope, "record_id"]].assign(outcome=[x[0] for x in done], output=[x[1] for x in done])

    kinds = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in scope)
    return records.select(*scope, "record_id", F.to_json(F.struct(*columns)).alias("payload")).mapInPandas(run, ", ".join([*([kinds] if kinds else []), "record_id string, outcome string, output string"]))


class Kept:
    """Outcomes in a folder, by the digest of what was asked."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.system, self.base = FileSystem.from_uri(folder)

    def _place(self, payload: str) -> tuple[str, str]:
        key = hashlib.sha256(payload.encode("utf-8", "replace")).hexdigest()
        return f"{self.base}/{key[:3]}", f"{self.base}/{key[:3]}/{key}.json"

    def get(self, payload: str) -> tuple[str, str | None] | None:
        try:
            with self.system.open_input_stream(self._place(payload)[1]) as f:
                return tuple(json.loads(f.read()))
        except FileNotFoundError:
            return None

    def put(self, payload: str, outcome: tuple[str, str | None]) -> None:
        """Written beside and moved into place, so that no one reads half of it."""
        folder, place = self._place(payload)
        self.system.create_dir(folder)
        part = f"{folder}/_{uuid.uuid4().hex}"
        with self.system.open_output_stream(part) as f:
            f.write(json.dumps(outcome).encode())
        self.system.move(part, place)


def _started(summarise: Callable[[dict], object], payload: str) -> tuple[threading.Thread, list]:
    """The call in a thread of its own, and where its outcome will stand."""
    told: list = []

    def call() -> None:
        try:
            got = summarise(json.loads(payload))
            got = got if isinstance(got, str) or got is None else json.dumps(got)
            told.append(("ok" if got and got.strip() else "empty", got))
        except Exception as e:  # noqa: BLE001 - a caller's code: its failure belongs to the record
            told.append(("failed", str(e)))

    thread = threading.Thread(target=call, daemon=True)
    thread.start()
    return thread, told


def _outcome(running: tuple[threading.Thread, list], until: float) -> tuple[str, str | None]:
    thread, told = running
    thread.join(max(0.0, until - time.monotonic()))
    return told[0] if told else ("timed out", None)


def merged(records: DataFrame, results: DataFrame, scope: list[str] = SCOPE) -> DataFrame:
    """Records with their results of the same scope and id: JSON fields or plain text; ``skipped`` leaves a record as it is, failures flag it."""
    r = results.withColumn("_j", F.from_json("output", RESULT, {"mode": "PERMISSIVE"}))
    r = r.withColumn("_json", F.col("output").rlike(r"(?s)^\s*\{.*\}\s*$")).select(*[F.col(c).alias(f"_{c}") for c in (*scope, "record_id")], "outcome", "output", "_j", "_json")
    same = F.col("record_id") == F.col("_record_id")
    for c in scope:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    x = records.join(r, same, "left")
    done = F.coalesce((F.col("outcome") == "ok") & ~(F.col("_json") & F.coalesce(F.col("_j.skipped"), F.lit(False))), F.lit(False))
    text = F.when(F.col("_json"), F.coalesce(blank_to_null("_j.summary"), blank_to_null("_j.generated_summary"))).otherwise(blank_to_null("output"))
    union = lambda c, f: F.when(done & F.col("_json"), unique_values(c, f"_j.{f}")).otherwise(F.col(c))
    bad = F.coalesce(F.col("outcome").isin("failed", "empty", "timed out"), F.lit(False))
    flags = F.when(done, appended(F.col("review_flags"), F.lit(rules.EXTERNAL_FLAG))).when(bad, appended(F.col("review_flags"), F.concat(F.lit("External summary "), F.col("outcome"), F.lit(".")))).otherwise(F.col("review_flags"))
    return x.withColumns(
        {
            "summary": F.when(done, text).otherwise(F.col("summary")), "themes": union("themes", "themes"), "topics": union("topics", "topics"), "related": union("related", "related_sermons"),
            "questionable_claims": union("questionable_claims", "questionable_claims"), "review_flags": flags,
            "summary_status": F.when(done, "ai_generated_review_required").otherwise(F.col("summary_status")), "summary_source": F.when(done, "external_command").otherwise(F.col("summary_source")),
        }
    ).drop(*[f"_{c}" for c in (*scope, "record_id")], "outcome", "output", "_j", "_json")
