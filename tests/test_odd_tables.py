"""Registered queries against their SQL over tables with odd rows, which the driver's larger tables hold too."""

import duckdb
import pytest

from loomfield import registry


def differences(spark, folder, name):
    """Rows of a query alone, and of its SQL alone."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = registry.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    rel = con.sql(registry.ORACLE_SQL[name])
    want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=str)
    return [r for r in got if r not in want], [r for r in want if r not in got], len(got) - len(want)


def documents(folder, rows):
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(doc_id, text, lang, source, n_chars)) TO '{folder}/documents.parquet'")


@pytest.mark.parametrize("name", ("validate_samples", "shards_complete"))
def test_texts_of_any_length_are_samples(spark, tmp_path, name):
    texts = ("''", "'a'", "NULL", "'ab'", "'long enough'")
    documents(tmp_path, ", ".join(f"({i}::BIGINT, {texts[i % 5]}, 'en', 'src{i % 3}', 1::BIGINT)" for i in range(400)))
    assert differences(spark, tmp_path, name) == ([], [], 0)


def test_report_of_repeated_keys_and_null_shards(spark, tmp_path):
    texts = ("''", "'a'", "'long enough'")
    documents(tmp_path, ", ".join(f"({i // 2}::BIGINT, {texts[i % 3]}, 'en', {'NULL' if i % 5 == 0 else f"'src{i % 3}'"}, 1::BIGINT)" for i in range(400)))
    assert differences(spark, tmp_path, "validate_report") == ([], [], 0)
