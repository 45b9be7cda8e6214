"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from logspark.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import SF_DIR

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) and len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, tables, name):
    found = QUERIES[name](spark, SF_DIR)
    want = tables.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(found.select(*[f"`{c}`" for c in columns]).collect()) == plain(tables.sql(f"select {quoted} from ({ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["parse_all", "parse_rfc3164"])
def test_rows_over_new_year(spark, tmp_path, name):
    """Events of a year's first seconds: their lines are stamped up to six seconds earlier, in the year before."""
    c = duckdb.connect()
    c.sql(f"""copy (select i as event_id, timestamp '2024-01-01 00:00:00.25' + to_seconds(cast(i // 6 as int)) as ts, i * 37 as user_id, ['error', 'signup', 'view'][i % 3 + 1] as event_type, 1.5 as value, '{{"k": 1}}' as props from range(60) r(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.ts[:4] for r in found} == {"2023", "2024"}
    assert plain([[r[k] for k in sorted(r.asDict())] for r in found]) == plain(c.sql(f"select {', '.join(sorted(found[0].asDict()))} from ({ORACLE_SQL[name]})").fetchall())
