"""Every registered query of the library on empty tables, and on tables with nulls in every column."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import foldspark.queries  # noqa: F401
from foldspark import registry

SF = "/root/testdata/sf0.001"


def empty(table):
    return table.slice(0, 0)


def with_nulls(table):
    """The first rows, of which every column loses some of its own."""
    table = table.slice(0, 300)
    for k, field in enumerate(table.schema):
        kept = [None if i % 23 == k else v for i, v in enumerate(table.column(k).to_pylist())]
        table = table.set_column(k, field.name, pa.array(kept, field.type))
    return table


def failed(spark, folder: Path, change) -> dict[str, str]:
    for path in Path(SF).glob("*.parquet"):
        pq.write_table(change(pq.read_table(path)), folder / path.name)

    def run(item):
        name, query = item
        try:
            rows = query(spark, str(folder)).count()
        except Exception as error:
            return name, str(error)[:300]
        return name, f"{rows} rows" if change is empty and rows else ""

    with ThreadPoolExecutor(4) as pool:
        return {name: said for name, said in pool.map(run, registry.QUERIES.items()) if said}


@pytest.mark.parametrize("change", [empty, with_nulls])
def test_odd_tables(spark, tmp_path, change):
    assert len(registry.QUERIES) > 90
    assert not failed(spark, tmp_path, change)
