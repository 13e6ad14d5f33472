import pandas as pd
import pytest

from tapeloom.llm.queries import ORACLE, QUERIES
from tests.llm.common import SMALL


def rows(df):
    """Rows in order; a null is None, and a whole number is an int whatever its column became for the nulls in it."""
    def plain(v):
        return None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted((tuple(map(plain, r)) for r in df.astype(object).values.tolist()), key=lambda r: [(v is None, v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE[name]).df()
    assert list(got.columns) == list(want.columns)
    assert rows(got) == rows(want)


def test_every_operator_has_a_query():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 14) for n in QUERIES if n.startswith(f"op{k}_")]
    assert len(QUERIES) == 13
