"""Keyed state over streams: restoring placeholders in fragments, rate limits and quotas."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def open_end(form: str = "[{type}_{id}]") -> re.Pattern:
    """Matches the end of a text that may be the beginning of a placeholder of this form."""
    head = form.split("{", 1)[0]
    return re.compile(re.escape(head) + r"[A-Z0-9_]*$") if head else re.compile(r"[A-Z0-9_]+$")


def step(held: str, fragment: str, placeholders: dict[str, str], end: re.Pattern) -> tuple[str, str]:
    """(what can be emitted, what is held back) after one more fragment."""
    text = held + fragment
    m = end.search(text)
    out, keep = (text[: m.start()], m.group()) if m else (text, "")
    for key in sorted(placeholders, key=len, reverse=True):
        out = out.replace(key, placeholders[key])
    return out, keep


def restore_fragments(fragments: DataFrame, keys: tuple[str, ...] = ("stream_id", "channel"), form: str = "[{type}_{id}]", idle_ms: int = 30 * 60 * 1000) -> DataFrame:
    """Streaming: (keys, seq, emitted) for fragments (keys, seq long, frag, last boolean, placeholders map).

    A fragment's end that may be a placeholder's beginning is held back until the next; ``last`` flushes it. The state
    is that short end alone, flushed and dropped after ``idle_ms`` milliseconds without fragments. Channels (such as tool calls) are independent.
    """
    end = open_end(form)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get[0]
            state.remove()
            yield pd.DataFrame([(*key, None, held)], columns=[*keys, "seq", "emitted"])
            return
        held, rows, done = state.get[0] if state.exists else "", [], False
        for p in pd.concat(list(parts)).sort_values("seq").itertuples():
            out, held = step(held, p.frag or "", dict(p.placeholders or {}), end)
            if p.last:
                out, held, done = out + held, "", True
            rows.append((*key, p.seq, out))
        if done:
            state.remove()
        else:
            state.update((held,))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[*keys, "seq", "emitted"])

    schema = ", ".join(f"{k} string" for k in keys) + ", seq long, emitted string"
    return fragments.groupBy(*keys).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def admit(times: Iterable[float], rpm: int, kept: list[float] | None = None) -> tuple[list[tuple[bool, int]], list[float]]:
    """For each request in order of time: (admitted, seconds to wait); a request counts for 60 seconds, refused ones don't count.

    A limit of 0 or less admits everything.
    """
    kept, out = list(kept or []), []
    if rpm <= 0:
        return [(True, 0) for _ in times], kept
    for t in times:
        while kept and kept[0] < t - 60:
            kept.pop(0)
        if len(kept) >= rpm:
            out.append((False, max(1, int(kept[0] + 60 - t))))
        else:
            kept.append(t)
            out.append((True, 0))
    return out, kept


def _limit(limit: int | str) -> Column:
    """A limit as a column: one for all rows, or the named column's (null: no limit)."""
    return F.coalesce(F.col(limit).cast("long"), F.lit(0)) if isinstance(limit, str) else F.lit(limit).cast("long")


def rate_limit(requests: DataFrame, rpm: int | str = 60, key: str = "user_id", ts: str = "ts", id: str = "event_id") -> DataFrame:
    """Batch: (id, key, ts, admitted, retry_after) by the exact sliding window.

    ``rpm`` is a number, or the column that has each principal's own; 0 or less, or null there, is no limit. Whether a request is admitted depends on the requests of its key in order; no more than ``rpm`` times are kept. The
    rows of a key come sorted from the shuffle and are read one Arrow batch at a time, so a hot key is never gathered.
    """
    rows = requests.select(F.col(id).alias("id"), F.col(key).alias("key"), F.col(ts).alias("ts"), (F.unix_micros(F.col(ts)) / F.lit(1e6)).alias("at"), _limit(rpm).alias("rpm"))
    dealt = rows.repartition("key").sortWithinPartitions("key", "at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), []
        for pdf in batches:
            out = []
            for k, at, most in zip(pdf["key"], pdf["at"], pdf["rpm"], strict=True):
                if k != now:
                    now, kept = k, []
                verdict, kept = admit([at], most, kept)
                out += verdict
            yield pdf.drop(columns=["at", "rpm"]).assign(admitted=[o[0] for o in out], retry_after=[o[1] for o in out])

    kinds = dict(rows.dtypes)
    return dealt.mapInPandas(run, f"id {kinds['id']}, key {kinds['key']}, ts {kinds['ts']}, admitted boolean, retry_after int")


def rate_limit_stream(requests: DataFrame, rpm: int | str = 60, key: str = "principal", ts: str = "ts") -> DataFrame:
    """Streaming: (principal, ts, admitted, retry_after); ``rpm`` as in ``rate_limit``, the state is the times that count."""

    def run(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(parts)).sort_values("ts")
        verdict, kept = [], list(state.get[0]) if state.exists else []
        for at, most in zip(pdf["ts"], pdf["rpm"], strict=True):
            one, kept = admit([at.timestamp()], int(most), kept)
            verdict += one
        state.update((kept,))
        state.setTimeoutDuration(120_000)
        yield pd.DataFrame({"principal": who[0], "ts": pdf["ts"], "admitted": [v[0] for v in verdict], "retry_after": [v[1] for v in verdict]})

    rows = requests.select(F.col(key).cast("string").alias("principal"), F.col(ts).alias("ts"), _limit(rpm).alias("rpm"))
    return rows.groupBy("principal").applyInPandasWithState(run, "principal string, ts timestamp, admitted boolean, retry_after int", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def daily_quota(usage: DataFrame, quota: int | str, key: str = "user_id", ts: str = "ts", tokens: str = "tokens", id: str = "event_id") -> DataFrame:
    """(id, key, day, used_before, admitted, retry_after): refused once the day's tokens (UTC) have reached the quota; amounts below 1 don't count.

    ``quota`` is a number, or the column that has each principal's own; 0 or less, or null there, is no limit.
    """
    day = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(ts, "UTC"), "UTC"))
    own = Window.partitionBy(key, "day").orderBy(ts, id).rowsBetween(Window.unboundedPreceding, -1)
    rows = usage.withColumn("day", day).withColumn("__n", F.greatest(F.col(tokens), F.lit(0)))
    rows = rows.withColumn("used_before", F.coalesce(F.sum("__n").over(own), F.lit(0)))
    most = _limit(quota)
    refused = (most > 0) & (F.col("used_before") >= most)
    left = F.lit(86400) - F.pmod(F.unix_timestamp(ts), F.lit(86400))
    return rows.select(F.col(id).alias("id"), F.col(key).alias("key"), "day", "used_before", (~refused).alias("admitted"), F.when(refused, left).otherwise(0).alias("retry_after"))
