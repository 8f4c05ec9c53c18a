"""The controller of the adaptive baseline: a pure function over small states, run as a batch fold or as a stream.

A state is a plain dict. Rules are tried in order; the first whose condition holds decides. A batch of windows is
summarised before it is seen, so the state never holds windows: how many there are, and for each of two baselines the
collective alarms, the drift and the calm windows. The baselines take turns: version 0 is the first, each acceptance
hands over to the other. While both run side by side, the shares of calm windows of all that was seen are compared, those
of the new baseline with relaxed point thresholds in its first windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Limits:
    confirm: int = 192
    retrace: int = 288
    accumulate: int = 1344
    parallel: int = 288
    extension: int = 480
    recovery: float = 0.85
    stability: float = 0.85
    cooldown: int = 672
    warmup: int = 96


@dataclass(frozen=True)
class Batch:
    at: int
    rows: int
    collective: int
    drift: bool


#: old, new: calm windows of both baselines since they run side by side; since: windows that the new one has seen.
START = {"state": "NORMAL", "counter": 0, "collected": 0, "seen": 0, "extended": False, "track": "", "until": -1, "version": 0, "old": 0, "new": 0, "since": 0}
Result = tuple[dict, str, int | None]


def _to(s: dict, action: str = "NONE", start: int | None = None, **changes) -> Result:
    return {**s, **changes}, action, start


def _normal(s: dict, b: Batch, k: Limits) -> Result:
    n = b.collective or max(0, s["counter"] - 1)
    return _to(s, counter=n, state="CA_TENTATIVE" if n else "NORMAL")


def _tentative(s: dict, b: Batch, k: Limits) -> Result:
    n = s["counter"] + b.collective if b.collective else max(0, s["counter"] - 1)
    if n >= k.confirm:
        return _to(s, "START_FORWARD_COLLECTION", b.at, counter=n, collected=0, state="ACCUMULATING")
    return _to(s, counter=n, state="CA_TENTATIVE" if n else "NORMAL")


def _accumulating(s: dict, b: Batch, k: Limits) -> Result:
    n = s["collected"] + b.rows
    if n < k.accumulate:
        return _to(s, collected=n)
    return _to(s, "FINETUNE_FROM_FORWARD_DATA", max(0, b.at - n + 1), collected=n, state="SWITCHING", track="collective")


_BY_STATE: dict[str, Callable[[dict, Batch, Limits], Result]] = {"NORMAL": _normal, "CA_TENTATIVE": _tentative, "ACCUMULATING": _accumulating}


def observe(s: dict, b: Batch, k: Limits = Limits()) -> Result:
    """(state, action, first window of the data to train on) after a batch."""
    if b.at < s["until"]:
        return _to(s, state="COOLDOWN")
    s = {**s, "state": "NORMAL"} if s["state"] == "COOLDOWN" else s
    if s["state"] == "SWITCHING":
        return _to(s)
    if b.drift:
        return _to(s, "FINETUNE_FROM_HISTORY", max(0, b.at - k.retrace), state="SWITCHING", track="drift")
    return _BY_STATE[s["state"]](s, b, k)


def judge(s: dict, old: list[str], new: list[str], at: int, k: Limits = Limits()) -> Result:
    """(state, action, None) after old and new model have labelled the same windows side by side."""
    if not old or len(old) != len(new):
        raise ValueError("labels of both models must be of equal length, and there must be some")
    return compare(s, len(old), old.count("N"), new.count("N"), at, k)


def compare(s: dict, rows: int, calm_old: int, calm_new: int, at: int, k: Limits = Limits()) -> Result:
    """As judge, from the numbers of windows and of calm ones."""
    if s["state"] != "SWITCHING":
        raise RuntimeError("models are compared only while switching")
    s = {**s, "seen": s["seen"] + rows, "since": s["since"] + rows, "old": s["old"] + calm_old, "new": s["new"] + calm_new}
    if s["seen"] < (k.extension if s["extended"] else k.parallel):
        return _to(s)
    share_old, share_new = s["old"] / s["seen"], s["new"] / s["seen"]
    collective = s["track"] == "collective"
    done = {"state": "COOLDOWN", "until": at + k.cooldown, "counter": 0, "collected": 0, "seen": 0, "extended": False, "track": "", "old": 0, "new": 0, "since": 0}
    verdicts = (
        (share_new >= k.stability and (not collective or share_new >= share_old), "ACCEPT_NEW_BASELINE", {**done, "version": s["version"] + 1}),
        (collective and share_old >= k.recovery, "REJECT_NEW_BASELINE", done),
        (not s["extended"], "EXTEND_PARALLEL_VALIDATION", {"extended": True, "seen": 0, "old": 0, "new": 0}),
        (True, "REJECT_NEW_BASELINE", done),
    )
    action, changes = next((a, c) for holds, a, c in verdicts if holds)
    return _to(s, action, **changes)


_FIELDS = "state string, counter bigint, collected bigint, seen bigint, extended boolean, track string, until bigint, version bigint, old bigint, new bigint, since bigint"
_OUT = "series string, at bigint, state string, action string, data_start bigint, counter bigint, version bigint"


def _advance(series: str, s: dict, batches: Iterator[dict], k: Limits) -> tuple[dict, list[tuple]]:
    rows = []
    for b in batches:
        now, other = s["version"] % 2, 1 - s["version"] % 2
        s, action, start = observe(s, Batch(b["at"], b["rows"], b[f"collective{now}"], b[f"drift{now}"]), k)
        rows.append((series, b["at"], s["state"], action, start, s["counter"], s["version"]))
        if s["state"] == "SWITCHING" and action == "NONE":
            calm_new = b[f"warm{other}"] if s["since"] < k.warmup else b[f"calm{other}"]
            s, action, start = compare(s, b["rows"], b[f"calm{now}"], calm_new, b["at"], k)
            if action != "NONE":
                rows.append((series, b["at"], s["state"], action, start, s["counter"], s["version"]))
    return s, rows


def summarise(df: DataFrame, series: str, index: str, step: int = 24) -> DataFrame:
    """(series, at, rows, and collective, drift, calm, warm of baselines 0 and 1): batches of `step` windows by their index.

    df: a row for each window and baseline (0 or 1), with label, relaxed_label and drift. One aggregation.
    """
    from pyspark.sql import functions as F

    both = []
    for i in (0, 1):
        own = F.col("baseline") == i
        both += [F.count_if(own & (F.col("label") == "CA")).alias(f"collective{i}"), F.coalesce(F.bool_or(own & F.col("drift")), F.lit(False)).alias(f"drift{i}")]
        both += [F.count_if(own & (F.col("label") == "N")).alias(f"calm{i}"), F.count_if(own & (F.col("relaxed_label") == "N")).alias(f"warm{i}")]
    batch = F.floor(F.col(index) / step).alias("batch")
    return df.groupBy(F.col(series).cast("string").alias("series"), batch).agg(F.max(index).cast("bigint").alias("at"), F.count_if(F.col("baseline") == 0).alias("rows"), *both).drop("batch")


def _rows(pdf: pd.DataFrame) -> Iterator[dict]:
    pdf = pdf.sort_values("at")
    return iter(pdf.astype({c: bool if c.startswith("drift") else int for c in pdf.columns if c != "series"}).to_dict("records"))


def fold(batches: DataFrame, k: Limits = Limits()) -> DataFrame:
    """Every transition of every series, in one ordered pass over its batches (a row for 24 windows)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _, rows = _advance(pdf["series"].iloc[0], dict(START), _rows(pdf), k)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"data_start": "Int64"})

    return batches.groupBy("series").applyInPandas(one, _OUT)


def stream(batches: DataFrame, k: Limits = Limits()) -> DataFrame:
    """The same over a stream of batches; the state of a series is the fields of START."""
    names = list(START)

    def one(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(names, state.get)) if state.exists else dict(START)
        s, rows = _advance(key[0], s, _rows(pd.concat(list(pdfs))), k)  # the micro-batch's rows of one series
        state.update(tuple(s[n] for n in names))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"data_start": "Int64"})

    return batches.groupBy("series").applyInPandasWithState(one, _OUT, _FIELDS, "append", GroupStateTimeout.NoTimeout)
