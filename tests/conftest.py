import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from catalog.compare import session
    s = session("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


def day(i: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def series_df(spark, values, scode="A", name="x"):
    return spark.createDataFrame([(scode, day(i), None if v is None else float(v)) for i, v in enumerate(values)],
                                 f"scode string, date date, {name} double")


def values(df, col):
    return [r[col] for r in df.orderBy("scode", "date").collect()]
