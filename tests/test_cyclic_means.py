import duckdb
import numpy as np
import pandas as pd

from loopsight import catalogue


def test_means_on_the_seam_are_on_the_side_that_sql_says(spark, tmp_path):
    """Revolutions whose mean lies on the seam, from files in no order."""
    keys = np.concatenate([np.arange(first, first + 249) for first in (29322, 88214, 147106)] + [np.arange(500)])
    rows = pd.DataFrame({"o_orderkey": np.sort(keys), "o_custkey": 1})
    mixed = rows.sample(frac=1, random_state=5)
    (tmp_path / "orders.parquet").mkdir()
    for i in range(4):
        mixed.iloc[i::4].to_parquet(tmp_path / "orders.parquet" / f"{i}.parquet")
    got = catalogue.QUERIES["phase_circular_means"](spark, str(tmp_path)).toPandas().set_index("revolution").mean_phase
    db = duckdb.connect()
    db.execute("set threads = 1")
    db.register("orders", rows)
    for name in ("lineitem", "events", "embeddings"):
        db.execute(f"create view {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    want = db.execute(catalogue.ORACLE_SQL["phase_circular_means"]).df().set_index("revolution").mean_phase
    assert got.to_dict() == want.to_dict()
    assert got[118] == 14723.0
