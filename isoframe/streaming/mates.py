"""Mate pairing on a stream: alignments arrive in any order, pairs leave as soon as both mates are there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from isoframe.operators.reads import usable

ROW = "sample string, qname string, flag int, chrom string, pos long, cigar string"
#: Alignments as they arrive.
TIMED = ROW + ", arrived timestamp"


def pair_mates(stream: DataFrame, time: str = "arrived", timeout: str = "10 minutes") -> DataFrame:
    """(sample, qname, complete, flag1, chrom1, pos1, cigar1, flag2, ...): pairs, and lone mates once they time out.

    time: a timestamp column of the stream, the event time. State holds one mate for each name at most and goes when its
    pair leaves, or once the watermark has passed its time. The watermark trails the latest time by `timeout`, so a mate
    that comes later than that is left out as late.
    """
    out = "sample string, qname string, complete boolean, " + ", ".join(f"flag{i} int, chrom{i} string, pos{i} long, cigar{i} string" for i in (1, 2))
    names = [f"{c}{i}" for i in (1, 2) for c in ("flag", "chrom", "pos", "cigar")]

    def step(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield pd.DataFrame([(*key, False, *held, None, None, None, None)], columns=["sample", "qname", "complete", *names])
            return
        rows, latest = [], 0
        for b in batches:
            rows += [tuple(r) for r in b[["flag", "chrom", "pos", "cigar"]].itertuples(index=False)]
            latest = max(latest, int(b["_time"].max()))
        if state.exists:
            rows.insert(0, state.get)
            state.remove()
        done = []
        while len(rows) >= 2:
            a, b = sorted(rows[:2], key=lambda r: (r[2], r[0] & 0x40 == 0))
            done.append((*key, True, *a, *b))
            rows = rows[2:]
        if rows:
            flag, chrom, pos, cigar = rows[0]
            state.update((int(flag), chrom, int(pos), cigar))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
        if done:
            yield pd.DataFrame(done, columns=["sample", "qname", "complete", *names])

    paired = usable(stream).where(F.col("flag").bitwiseAND(1) != 0).withWatermark(time, timeout)
    paired = paired.select("sample", "qname", "flag", "chrom", "pos", "cigar", time, F.unix_millis(time).alias("_time"))
    return paired.groupBy("sample", "qname").applyInPandasWithState(step, out, "flag int, chrom string, pos long, cigar string", "append", GroupStateTimeout.EventTimeTimeout)
