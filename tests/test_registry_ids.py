"""The derived registry is stored with its ids, so that reading versions hashes no schema again."""

from pactlake.sources.derived import Views


def test_versions_are_read_with_their_ids(spark, tmp_path):
    rows = {
        "region": "0 as r_regionkey, 'ASIA' as r_name", "nation": "0 as n_nationkey, 'N' as n_name, 0 as n_regionkey",
        "supplier": "1L as s_suppkey, 0 as s_nationkey", "part": "1L as p_partkey",
        "lineitem": "1L as l_orderkey, 1L as l_partkey, 1L as l_suppkey, 1 as l_linenumber, 5D as l_quantity, 1D as l_extendedprice, 0D as l_discount, "
                    "0D as l_tax, 'A' as l_returnflag, 'O' as l_linestatus, timestamp_ntz'1995-01-01' as l_shipdate",
    }
    for name, row in rows.items():
        spark.sql(f"select {row}").write.parquet(f"{tmp_path}/{name}.parquet")
    views = Views(spark, str(tmp_path))
    stored = views.version_bodies
    assert "schema_id" in stored.columns
    assert stored.select("schema_id").first() == stored.select(views._body_id()).first()
    assert "sha2" not in views.versions._jdf.queryExecution().optimizedPlan().toString()
