"""The event fold as a stream: state per entity, one step an assessment.  An extension; batch is the rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideline.config import Profile

OUT = "patient_id string, t timestamp, demoted boolean"
STATE = "band int, last double, risk double"


def emit_stream(assessments: DataFrame, p: Profile) -> DataFrame:
    """Emitted (patient_id, t, demoted) of a stream of (patient_id, t, band, risk, raw, raw_band, noted).

    Rows of one batch are taken in time order; rows that come later than their batch are taken as they come.
    """
    rest = p.refractory_h * 3600

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        band, last, risk = state.get if state.exists else (0, float("nan"), 0.0)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for a in rows.itertuples(index=False):
            now = a.t.timestamp()
            rested = now - last >= rest
            if a.band >= p.floor_band:
                emit = a.band > band or (a.band == band and rested and a.risk - risk >= p.re_emit)
                band = max(band, a.band)
            else:
                emit = a.noted and a.raw > 0 and a.raw_band > a.band and a.raw_band >= p.floor_band and (last != last or rested)
                band = a.band
            if emit:
                out.append((key[0], a.t, a.band < p.floor_band))
                last, risk = now, a.risk
        state.update((int(band), float(last), float(risk)))
        yield pd.DataFrame(out, columns=["patient_id", "t", "demoted"])

    return assessments.groupBy("patient_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
