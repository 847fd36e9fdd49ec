"""Every query with an oracle against DuckDB on the smallest tables; the others must run."""

import os

import pytest

from voxelith import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v != v else v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_oracle(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    res = duck.execute(own.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()]
    assert in_order(got) == in_order(want)


#: Rows that queries without an oracle have at the smallest size, by their definitions: of the table, a grid or bins.
ROWS = {
    "c7_largest_component": lambda n: 0 < n < 32000, "c4_components": lambda n: 0 < n < 16000, "q1_segment_implant": lambda n: 0 < n < 32000,
    "q3_bone_region": lambda n: n < 32000, "q5_fields": lambda n: 0 < n <= 32000, "q4_implant_data": lambda n: n == 32000,
    "q9_segmentation": lambda n: n > 0, "g22_ellipsoids": lambda n: n == 10, "q2_frame_of_reference": lambda n: n == 3,
}


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_runs(spark, name):
    df = own.QUERIES[name](spark, SF)
    rows = df.collect()
    assert ROWS.get(name, lambda n: n > 0)(len(rows)) and len(set(df.columns)) == len(df.columns)
    numbers = [v for r in rows for v in r if isinstance(v, float)]
    assert all(v == v for v in numbers), "no result is NaN"


def test_entry_without_corpus_queries(spark):
    import __spark_entry__ as entry

    assert set(own.QUERIES) <= set(entry.queries()) and set(own.ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["axis", "row", "bin", "n"]
