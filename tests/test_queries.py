"""Every query of the library against its SQL, run by DuckDB on the smallest data."""

import re

import duckdb
import pytest

from kavsak import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert got  # see test_without_sql and test_parsers for what is in them
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted(names) == cols and len(got) == len(want)
    assert got == want


def test_unblocked_reaches_every_supplier(spark):
    """Against all pairs by DuckDB, on data with suppliers in the query set."""
    sf, name = "/root/testdata/sf0.01", "link_unblocked"
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(plans.oracle_sql()[name]).fetchall())
    got = sorted(map(tuple, plans.queries()[name](spark, sf).collect()))
    assert got == want and all(right % 50 == 0 for _, right, _ in got) and got


def building(t):
    m = re.search(r"\b(apartman|residence|rezidans|blok|işhanı|iş hanı|plaza|hotel|otel)\b", t)
    if not m:
        return None
    name = " ".join([*re.findall(r"[a-zğüşiöç\-]+", t[: m.start()])[-2:], m[1]])
    return re.sub(r"^\d+[a-z]?\s*", "", re.sub(r"^\bno\b\s*\d+[a-z]?/?\d*\s*", "", name).strip()).strip() or None


def tail(t, provinces=("izmir", "ankara", "bursa")):
    last = t.split(" ")[-8:]
    for a, b in reversed(list(zip(last, last[1:]))):
        if all(re.fullmatch("[a-zçğıöşü]+", w) for w in (a, b)) and b in provinces and a not in provinces:
            return b, a
    return None, None


def test_buildings_and_tails_of_every_row(spark):
    from pyspark.sql import functions as F

    from kavsak.functions import parse as P
    from kavsak.plans.queries import cleaned

    t = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    texts = {r["id"]: r["t"] for r in cleaned(t).collect()}
    found = {r["id"]: r["x"] for r in plans.queries()["parse_building"](spark, SF).collect()}
    assert found == {i: building(x) for i, x in texts.items()}
    assert all((x is not None) == (i % 4 == 1) for i, x in found.items()) and any(found.values())
    ends = {r["id"]: (r["il"], r["ilce"]) for r in plans.queries()["city_tail"](spark, SF).collect()}
    assert ends == {i: tail(x) for i, x in texts.items()} and any(il for il, _ in ends.values())
    more = ["yeni gul apartman", "no 12 apartman", "apartman", "a b c d plaza e otel", "kat 3 iş hanı", "x", ""]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(more)), "i int, t string").select("i", P.building(F.col("t"), P.TRIGGERS_A).alias("x")).orderBy("i").collect()]
    assert got == [building(x) for x in more]
