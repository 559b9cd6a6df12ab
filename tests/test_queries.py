import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inundata.operators import catalog
from inundata.plans import catalog_queries


def same_as_sql(spark, name, path, *tables):
    """Rows of a query, after they are found equal to those of its SQL."""
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS FROM '{path}/{t}.parquet'")
        want = db.sql(catalog_queries.ORACLE_SQL[name]).fetchall()
    got = [tuple(x) for x in catalog_queries.QUERIES[name](spark, str(path)).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got


@pytest.mark.parametrize("ids", [range(10), [0, 1, 2, 3, 9], range(3)])
def test_average_of_any_height_and_of_gaps(spark, tmp_path, ids):
    v = np.random.default_rng(12).normal(0, 0.1, (len(ids), 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": list(v), "label": pa.array([0] * len(ids), pa.int32())}), tmp_path / "embeddings.parquet")
    assert len(same_as_sql(spark, "resample_average", tmp_path, "embeddings")) == 16 * len({i // 4 for i in ids})


def test_tiles_of_a_large_extent_are_made_by_many_tasks(spark, tmp_path):
    keys = [*range(12), 900]
    pq.write_table(pa.table({"s_suppkey": pa.array(keys, pa.int64())}), tmp_path / "supplier.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW supplier AS SELECT *, 0e0 AS s_acctbal FROM '{tmp_path}/supplier.parquet'")
        want = db.sql(catalog_queries.ORACLE_SQL["tile_plan"]).fetchall()
    df = catalog_queries.QUERIES["tile_plan"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    parts = [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == len(want) > 9000 and max(parts) < 0.4 * len(want)


def test_tile_plan_rounds_only_if_asked(spark):
    ext = spark.createDataFrame([(1, 0.0, 0.0, 100_020.0, 60.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    plan = catalog.DownloadPlan(block_threshold=9000, tile_size=5000)  # two blocks of 50,010 m
    plain, cut = ([(x.block, x.tile, x.x0, x.x1, x.width, x.height) for x in catalog.tile_plan(ext, plan, digits).orderBy("block", "tile").collect()] for digits in (None, -2))
    assert plain == [(0, 0, 0.0, 50_000.0, 5000, 6), (0, 1, 50_000.0, 50_010.0, 1, 6), (1, 0, 50_010.0, 100_010.0, 5000, 6), (1, 1, 100_010.0, 100_020.0, 1, 6)]
    assert [x[2:4] for x in cut] == [(0.0, 50_000.0), (50_000.0, 50_000.0), (50_000.0, 100_000.0), (100_000.0, 100_000.0)]
