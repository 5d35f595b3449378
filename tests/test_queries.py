import os

import duckdb
import pytest

from gridmark.plans import ORACLES, QUERIES, load_all
from scripts.check_oracles import rows_of

load_all()
FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(ORACLES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file[: -len('.parquet')]} as select * from '{FOLDER}/{file}'")
    frame = QUERIES[name](spark, FOLDER)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in frame.collect()], frame.columns) == rows_of(result.fetchall(), columns)


def test_catalogue_is_consistent():
    assert set(ORACLES) == set(QUERIES)
    assert len(QUERIES) > 90
