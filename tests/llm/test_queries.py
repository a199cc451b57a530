"""The registered queries themselves: their SQL where they have one, and the columns of their contracts."""

import os

import duckdb
import pytest

from terraloom.llm import catalog, common, embeddings
from terraloom.session import TABLES
from terraloom.sources import tables
from tests.test_catalog import rows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_deleted deleted_lines text",
    "op2": "vec_id n_links component_id kept",
    "op3": "doc_id size source_size target taken",
    "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op5": "page_id url text n_chars",
    "op6": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7": "doc_id fingerprint component_id",
    "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "page_id host path rule verdict",
    "op10": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 8)
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cursor.fetchall(), names)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_has_its_columns_and_every_row(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    number = name.split("_")[0]
    assert df.columns[: len(COLUMNS[number].split())] == COLUMNS[number].split()
    table = {"op2": "embeddings", "op5": "pages", "op9": "pages"}.get(number, "documents")
    key = df.columns[0]
    assert df.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()


def test_scratch_tables_of_a_query_are_those_it_reads(spark):
    with common.collected() as written:
        df = catalog.QUERIES["op1_line_dedup"](spark, SF)
        read = tables.roots(df)
    left = [t for t in written if os.path.exists(t._terraloom_path.removeprefix("file://"))]
    assert len(written) > 5 and 0 < len(left) < len(written) and all(t._terraloom_path.rsplit("/", 1)[-1] in read for t in left)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="shared folder"):
        tables.shared_root(Session)
