"""Every registered query of the timeline operators against its SQL on the driver's small tables, or at least run there."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from chronoweave.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def values(df: pd.DataFrame) -> list[tuple]:
    """Rows in a defined order, columns by name."""

    def plain(x):
        if isinstance(x, float) or str(type(x).__name__).startswith(("float", "Decimal")):
            return None if pd.isna(x) else float(x)
        if x is None or x is pd.NaT or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        return bool(x) if type(x).__name__ in ("bool", "bool_") else float(int(x)) if type(x).__name__.startswith(("int", "uint")) else str(x)

    rows = [tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def oracle(sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.execute(sql).df()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns)
    if name in registry.ORACLE_SQL:
        want = oracle(registry.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        a, b = values(got), values(want)
        assert len(a) == len(b), (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
        assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:4]


def test_texts_are_compared_whole(spark, tmp_path):
    import __spark_entry__ as entry

    a, b = "".join(chr(0x4E00 + i) for i in range(150)), "".join(chr(0x5E00 + i) for i in range(150))
    rows = [(1, 0, "user", a + "the part that both texts share"), (1, 1, "assistant", b + "the part that both texts share")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["h10_lcs_contiguous"](spark, str(tmp_path)).collect()
    assert [r["lcs"] for r in got] == [25]
    got = entry.queries()["h11_edit_ratio"](spark, str(tmp_path)).collect()
    assert [r["ratio"] > 0.1 for r in got] == [True]
