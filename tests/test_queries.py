"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from plotwise.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(frame, cols):
    clean = frame[cols].astype(object).where(frame[cols].notna(), None)
    return sorted(tuple(str(float(x)) if isinstance(x, float) else str(x) for x in r) for r in clean.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(registry.queries()))
def test_matches_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def matches(spark, name, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = registry.queries()[name](spark, sf).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    return len(want) > 0 and rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


def test_villages_load_whole(spark):
    assert matches(spark, "lgd_load", "/root/testdata/sf0.1")


@pytest.mark.parametrize("name", ["bbox", "vertex_mean", "centroid", "point_in_polygon", "nearby_batch", "nearby_globe", "boundary_village", "boundary_hobli", "boundary_overlap"])
def test_whole_tables(spark, name):
    assert matches(spark, name, "/root/testdata/sf0.01" if name.startswith("boundary") else "/root/testdata/sf0.1")


def test_lake_polygons_beyond_90_degrees(spark, tmp_path):
    """Of large tables the customers' squares lie beyond the degrees of the globe."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    own = pq.read_table(f"{SF}/customer.parquet")
    far = own.set_column(own.schema.get_field_index("c_custkey"), "c_custkey", pc.add(own["c_custkey"], 899_850))
    pq.write_table(far, tmp_path / "customer.parquet")
    assert matches(spark, "lake_polygons", str(tmp_path))


def test_resumed_index_reads_files_in_many_tasks(spark, monkeypatch):
    """Village files that are large have several row groups, so that a batch of three files is not the work of three tasks."""
    import pyarrow.parquet as pq

    listed, groups = registry.lake.files, []

    def noted(session, root, names):
        out = listed(session, root, names)
        groups.append(max(pq.read_metadata(r.path.removeprefix("file:")).num_row_groups for r in out.collect()))
        return out

    monkeypatch.setattr(registry.lake, "files", noted)
    monkeypatch.setattr(registry, "ROW_GROUP", 1 << 10, raising=False)
    assert matches(spark, "survey_index_resumed", SF.replace("0.001", "0.01")) and groups[0] > 1
