"""State across requests: daily quotas, circuit breakers and the index feedback, as streams and as their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, EngineConfig


def quota_batch(requests: DataFrame, limit: int) -> DataFrame:
    """Requests (``layer, ts``) of each layer and day, of which the first ``limit`` are granted. Only counts matter, so
    it is one partially aggregated count."""
    n = F.count(F.lit(1))
    per = requests.groupBy("layer", F.to_date("ts").alias("day")).agg(n.alias("asked"))
    granted = F.least("asked", F.lit(limit).cast("long"))
    return per.withColumn("granted", granted).withColumn("refused", F.col("asked") - F.col("granted"))


QUOTA_OUT = "layer string, day date, event_id long, granted boolean, used int"


def quota_stream(requests: DataFrame, cfg: EngineConfig = DEFAULT, default: int = 80) -> DataFrame:
    """Grants each request (``layer, ts, event_id, amount``) while its layer's daily limit lasts. State is one (day,
    used) for each layer; a new day resets it; a request of an earlier day than the state's is refused."""
    limits = dict(cfg.daily_limits)

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        layer = key[0]
        day, used = state.get if state.exists else ("", 0)
        rows = []
        batch = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, event, amount in zip(batch["ts"], batch["event_id"], batch["amount"]):
            own = ts.strftime("%Y-%m-%d")
            if own > day:
                day, used = own, 0
            ok = own == day and used + amount <= limits.get(layer, default)
            used += int(amount) if ok else 0
            rows.append((layer, ts.date(), event, ok, used))
        state.update((day, used))
        yield pd.DataFrame(rows, columns=["layer", "day", "event_id", "granted", "used"])

    return requests.groupBy("layer").applyInPandasWithState(decide, QUOTA_OUT, "day string, used int", "append", GroupStateTimeout.NoTimeout)


def quota_windows(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests of each layer in tumbling days, as a stream with a watermark or as a batch."""
    return requests.withWatermark("ts", late).groupBy("layer", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("asked"))


def pauses_batch(results: DataFrame, minutes: int = 10) -> DataFrame:
    """What :func:`breaker_stream` does, over a whole table (``layer, ts, event_id, failed``): ``layer, failures, refused,
    pauses``. A failure pauses its layer; what falls into a pause is not sent, so it neither fails nor prolongs it.
    ``failures`` counts the rows marked as failed, ``refused`` those of them inside a pause.

    Rows of a layer come sorted and are read batch by batch with the end of the pause as the only state; each pause is
    found by a binary search, so a layer is never held whole."""
    bad = results.where("failed").select("layer", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    bad = bad.repartition("layer").sortWithinPartitions("layer", "at")
    reach = minutes * 60_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until: dict[str | None, int] = {}
        for batch in batches:
            layers = batch.column(0).dictionary_encode()
            at, code = batch.column(1).to_numpy(), layers.indices.fill_null(-1).to_numpy()
            out = []
            for k in np.unique(code).tolist():
                own, name = at[code == k], layers.dictionary[k].as_py() if k >= 0 else None
                end, i, pauses, refused = until.get(name), 0, 0, 0
                while True:
                    free = int(np.searchsorted(own, end, "left")) if end is not None else i
                    refused += max(0, free - i)
                    if free >= len(own):
                        break
                    pauses, end, i = pauses + 1, int(own[free]) + reach, free + 1
                until = {name: end}  # layers come one after the other
                out.append((name, len(own), refused, pauses))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            if out:
                yield pa.RecordBatch.from_arrays(columns, ["layer", "failures", "refused", "pauses"])

    parts = bad.mapInArrow(run, "layer string, failures long, refused long, pauses long")
    return parts.groupBy("layer").agg(*[F.sum(c).alias(c) for c in ("failures", "refused", "pauses")])


BREAKER_OUT = "layer string, event_id long, ts timestamp, allowed boolean"


def breaker_stream(results: DataFrame, minutes: dict[str, int] | None = None) -> DataFrame:
    """Requests (``layer, ts, event_id, failure``: empty, ``limit``, ``error`` or ``connection``) with ``allowed``: not
    inside a pause of their layer. A failure pauses it for ten minutes, a lost connection for five. State is the end
    of the pause."""
    pause = {"limit": 10, "error": 10, "connection": 5} | (minutes or {})

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else 0.0
        rows = []
        batch = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, event, failure in zip(batch["ts"], batch["event_id"], batch["failure"]):
            at = ts.timestamp()
            allowed = at >= until
            if allowed and failure:
                until = at + 60 * pause.get(failure, 10)
            rows.append((key[0], event, ts, allowed))
        state.update((until,))
        yield pd.DataFrame(rows, columns=["layer", "event_id", "ts", "allowed"])

    return results.groupBy("layer").applyInPandasWithState(decide, BREAKER_OUT, "until double", "append", GroupStateTimeout.NoTimeout)


def feed_index(results: DataFrame, path: str, cfg: EngineConfig = DEFAULT, checkpoint: str | None = None):
    """Starts the feedback of approved results (``doc_id, url, text, chars, score, label``) into the index at ``path``:
    each micro-batch appends the articles whose exact address the index does not hold yet, untrusted, as analysed
    news. Vector numbers follow from document and chunk, so a repeated batch adds nothing new."""
    from ..operators import index

    def add(batch: DataFrame, _: int) -> None:
        held = index.load(batch.sparkSession, path)
        fresh = index.new_only(index.gate(batch, cfg).where("approved"), held)
        docs = fresh.select(
            F.col("doc_id").cast("string").alias("base_doc_id"), "text", F.lit("analyzed").alias("source"), "url",
            F.lit(None).cast("string").alias("published_at"), F.create_map(F.lit("trusted"), F.lit("false")).alias("metadata"),
            F.lit("analyzed_news").alias("source_type"),
        )
        index.append(index.rows_of(docs, cfg), path)

    writer = results.writeStream.foreachBatch(add)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
