"""Every registered query of the measurement library against its SQL, on the smallest tables."""

import glob
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from safemeter import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return con


def rows(frame):
    def plain(v):
        if pd.isna(v):
            return None
        if isinstance(v, float):
            return round(v, 9)
        return str(v) if not isinstance(v, (bool, int, np.bool_, np.integer)) else int(v)

    out = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in out.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df()
    for frame in (got, want):
        for c in frame.columns:
            if frame[c].dtype.kind == "M":
                frame[c] = frame[c].astype("datetime64[us]").astype(str)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names_match():
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)


def test_entry(spark):
    out = Q.entry(spark, SF)
    assert {"catch_rate", "false_positive_rate"} <= set(out.columns) and out.count() == 12


def test_fast_tier_scores_every_document(spark, duck):
    want = duck.execute("select doc_id, case toxic when 1 then 'attack' when 0 then 'benign' end as label, toxic is null or doc_id % 2 = 1 as held_out from documents left join labels using (doc_id)").df()
    got = Q.m3_m5_fast_tier_scores(spark, SF).toPandas()
    assert got["tier1_score"].between(0, 1).all() and rows(got.drop(columns="tier1_score")) == rows(want)
    assert Q.t3_streaming_detection(spark, SF).count() == len(want)
