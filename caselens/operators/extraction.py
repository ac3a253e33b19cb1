"""Structured extraction over documents: one model call for each distinct text, cached by contract and content, with retries,
quarantine and an audit. The model is an injected object; everything around it is here."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.batches import frames
from caselens.functions.evidence import EvidenceError, align_events, ground, merge, shift, views
from caselens.functions.text import segments

RESULT = "content_sha256 string, events string, views map<string,string>, counts map<string,long>, attempts int, error_code string, error_type string"


class Extractor(Protocol):
    """Proposes events of a text, with quotes for evidence. identity goes into the contract."""

    identity: dict

    def propose(self, text: str, limits: dict | None = None) -> list[dict]: ...


class LeadingWords:
    """Deterministic stand-in for a model: one event from the first words of a text. Texts of one or two words are refused."""

    identity = {"kind": "leading-words"}

    def propose(self, text: str, limits: dict | None = None) -> list[dict]:
        words = text.split()
        if 0 < len(words) < 3:
            raise UpstreamError(429)
        quote = lambda *texts: [{"text": t} for t in texts]
        event = {"normalized_event_type": "lead", "polarity": "occurred", "trigger": {"text": words[0]}, "behaviors": quote(words[1]), "requests": quote(f"{words[0]}\0"), "search_terms": words[:2]} if words else None
        return [event] if event else []


class UpstreamError(RuntimeError):
    """A failed call; status is the HTTP status, if there was one."""

    def __init__(self, status: int | None = None):
        super().__init__(f"status {status}")
        self.status = status


@dataclass(frozen=True)
class Contract:
    """What a result depends on besides the text, and how often a text is tried, on which it does not depend."""

    model: str
    model_artifact_fingerprint: str | None = None
    schema_version: str = "events-v1"
    prompt_version: str = "prompt-v1"
    temperature: float = 0.0
    seed: int = 42
    max_tokens: int = 4096
    segment_chars: int = 8000
    thinking: bool = False
    truncation_recovery: str = "compact-v1"
    max_attempts: int = 2

    def terms(self) -> dict:
        """The ten fields that a resumed run and a cached result must agree in."""
        return {k: v for k, v in asdict(self).items() if k != "max_attempts"}

    def key(self) -> str:
        return digest(self.terms())

    def cache_key(self, content_sha256: str) -> str:
        return hashlib.sha256(f"{self.key()}\0{content_sha256}".encode()).hexdigest()


def canonical(value) -> str:
    """JSON with sorted keys and no spaces: equal values are equal texts."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    """sha-256 of canonical JSON."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()


# What the answer of a second attempt at a text is held to, when the first was cut off.
COMPACT = {"quote_chars": 48, "items": 2, "search_terms": 4}
#: Statuses below 500 that pass by themselves.
PASSING = (408, 409, 429)


class Truncated(RuntimeError):
    """The model's answer was cut off."""


def outcome(error: Exception) -> tuple[str, bool]:
    """(code of a failure, whether another attempt may end better): the first row of the table that fits."""
    status = getattr(error, "status", None) or 0
    table = [
        (isinstance(error, EvidenceError), getattr(error, "code", ""), False),
        (isinstance(error, (ValueError, TypeError)), "UNEXPECTED_ERROR", False),
        (status == 429, "UPSTREAM_RATE_LIMITED", True),
        (status > 0, "UPSTREAM_HTTP_ERROR", status in PASSING or status >= 500),
        (isinstance(error, TimeoutError) or "timeout" in type(error).__name__.lower(), "UPSTREAM_TIMEOUT", True),
        (isinstance(error, ConnectionError), "UPSTREAM_CONNECTION_ERROR", True),
        (True, "UNEXPECTED_ERROR", True),
    ]
    return next((code, again) for fits, code, again in table if fits)


def waits(attempts: int, seed: str) -> Iterator[float]:
    """Seconds before each attempt: none before the first, then doubling from one, each a quarter more or less."""
    chance = random.Random(seed)
    yield from (2.0**n * chance.uniform(0.75, 1.25) if n >= 0 else 0.0 for n in range(-1, attempts - 1))


def user_message(text: str) -> str:
    """What a model is told of a case: its text and nothing else."""
    return json.dumps({"case_content": text}, ensure_ascii=False)


def proposed(model: Extractor, text: str) -> tuple[list[dict], int]:
    """(events, recoveries): an answer that was cut off is asked for once more in the compact form."""
    try:
        return model.propose(text), 0
    except Truncated:
        return model.propose(text, COMPACT), 1


def extract_document(model: Extractor, text: str, segment_chars: int) -> tuple[list[dict], dict[str, int]]:
    """Segments are proposed and grounded alone, then shifted to their places and merged."""
    parts, total = [], {}
    for offset, part in segments(text, segment_chars):
        answer, recovered = proposed(model, part)
        events, counts = ground(answer, part)
        counts["truncation_recoveries"] = recovered
        parts.append(shift(events, offset))
        total = {k: total.get(k, 0) + v for k, v in counts.items()}
    return merge(parts), total


def with_attempts(call: Callable, most: int, seed: str, sleep: Callable[[float], None] = time.sleep):
    """(result, None, attempts) or (None, error, attempts)."""
    if most < 1:
        raise ValueError("at least one attempt is needed")
    failure = None
    for attempt, wait in enumerate(waits(most, seed), 1):
        if wait:
            sleep(wait)
        try:
            return call(), None, attempt
        except Exception as e:  # noqa: BLE001  a failed document goes to quarantine
            failure = e
        if not outcome(failure)[1]:
            break
    return None, failure, attempt


def _told(rows: list[tuple]):
    """Rows of RESULT as a record batch."""
    text = pa.string()
    kinds = [("content_sha256", text), ("events", text), ("views", pa.map_(text, text)), ("counts", pa.map_(text, pa.int64())), ("attempts", pa.int32()), ("error_code", text), ("error_type", text)]
    plain = lambda values: [list(v.items()) if isinstance(v, dict) else v for v in values]
    columns = [pa.array(plain(values), kind) for values, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))


#: What goes with a text that may have a cached result; made_of: the hash of the text that the result is of.
HELD = ("cached", "made_of", "events", "views", "counts")


def _fits(events: str | None, text: str | None) -> bool:
    try:
        return events is not None and align_events(json.loads(events), text)[1] == 0
    except (ValueError, KeyError, TypeError):
        return False


def _checked(sha: str, text: str, made_of: str | None, events: str | None, views, counts) -> tuple:
    """A cached result of a text; an error for one of another text, or whose spans do not stand where it says without any repair."""
    if made_of != sha:
        raise ValueError("a cached result is of another text")
    if not _fits(events, text):
        raise ValueError("a cached result does not fit its text")
    return events, views, counts


def _worker(load: Callable[[], Extractor], contract: Contract, sleep):
    """Batches of content_sha256 and case_content; behind them may stand HELD, which is null for a text that has no cached result."""

    def run(batches: Iterator) -> Iterator:
        model = load()
        for frame in frames(batches):
            rows = []
            for sha, text, *held in frame.itertuples(index=False, name=None):
                if held and held[0]:
                    rows.append((sha, *_checked(sha, text, *held[1:]), 0, None, None))
                    continue
                done, error, attempts = with_attempts(lambda text=text: extract_document(model, text, contract.segment_chars), contract.max_attempts, sha, sleep)
                if error is None:
                    events, counts = done
                    rows.append((sha, canonical(events), views(events), counts, attempts, None, None))
                else:
                    rows.append((sha, None, None, getattr(error, "counts", {}), attempts, outcome(error)[0], type(error).__name__))
            yield _told(rows)

    return run


def run_extraction(records: DataFrame, load: Callable[[], Extractor], contract: Contract, cache: DataFrame | None = None, done: DataFrame | None = None, partitions: int | None = 8, sleep=time.sleep) -> DataFrame:
    """records: source_id, source_row, case_content. One row for each record that isn't in done (source_id): its result or its error.

    Equal texts share one call (records join back on the hash); texts with a result in cache (cache_key and the result) need none, but an
    error is raised for a result that was made of another text, or whose spans are not where they were. The calls are spread over
    `partitions` tasks, which bounds how many run at once; with None they are made where the texts are, in tasks of bounded size.

    Texts are shuffled once, to their cache key; what is done and what is cached comes to them there, by keys. Records travel without their
    text unless case_content of the result is used."""
    hashed = records.withColumn("content_sha256", F.sha2("case_content", 256))
    todo = hashed if done is None else hashed.join(done.select("source_id").distinct(), "source_id", "left_anti")
    key = F.sha2(F.concat(F.lit(contract.key() + "\0"), F.col("content_sha256")), 256)
    texts = hashed.select(key.alias("cache_key"), "content_sha256", "case_content").groupBy("cache_key").agg(F.first("content_sha256").alias("content_sha256"), F.first("case_content").alias("case_content"))
    if done is not None:
        texts = texts.join(todo.select(key.alias("cache_key")).distinct(), "cache_key", "left_semi")
    if cache is not None:
        held = cache.withColumnRenamed("content_sha256", "made_of").withColumn("cached", F.lit(True))
        texts = texts.join(held.select("cache_key", *HELD), "cache_key", "left")
    texts = texts.drop("cache_key") if partitions is None else texts.drop("cache_key").coalesce(partitions)
    results = texts.mapInArrow(_worker(load, contract, sleep), RESULT)
    return todo.join(results.withColumn("cache_key", key), "content_sha256")


def accepted(results: DataFrame) -> DataFrame:
    return results.where("error_code is null").drop("error_code", "error_type", "case_content")


def quarantined(results: DataFrame) -> DataFrame:
    """Failed records, without their text."""
    return results.where("error_code is not null").select("source_id", "source_row", "content_sha256", "error_code", "error_type", "attempts", "counts")


def cache_rows(results: DataFrame) -> DataFrame:
    return results.where("error_code is null").select("cache_key", "content_sha256", "events", "views", "counts").dropDuplicates(["cache_key"])


EVENTS = "array<struct<normalized_event_type:string,polarity:string>>"


def audit(results: DataFrame) -> DataFrame:
    """One row: records, failures, events, totals of the grounding counts and the share of quotes that stand in the source."""
    total = lambda name: F.coalesce(F.sum(F.col("counts")[name]), F.lit(0))
    proposed, rejected = total("proposed_evidence_quotes"), total("rejected_evidence_quotes")
    return results.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("error_code").isNull()).alias("succeeded"), F.count_if(F.col("error_code").isNotNull()).alias("failed"),
        F.coalesce(F.sum(F.size(F.from_json("events", EVENTS))), F.lit(0)).alias("events"), proposed.alias("proposed_evidence_quotes"), rejected.alias("rejected_evidence_quotes"),
        total("dropped_events").alias("dropped_events"), total("trigger_fallbacks").alias("trigger_fallbacks"), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"),
        F.when(proposed > 0, (proposed - rejected) / proposed).alias("exact_evidence_quote_rate"),
    )


def histograms(results: DataFrame) -> DataFrame:
    """what, value, count of event polarities and error codes."""
    polarity = results.select(F.explode(F.from_json("events", EVENTS)).alias("e")).select(F.lit("polarity").alias("what"), F.col("e.polarity").alias("value"))
    errors = results.where("error_code is not null").select(F.lit("error_code").alias("what"), F.col("error_code").alias("value"))
    return polarity.unionByName(errors).groupBy("what", "value").agg(F.count(F.lit(1)).alias("count"))
