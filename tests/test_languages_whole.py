"""Languages by words, of every document."""

import duckdb
import pytest

from loomline.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["detected_language", "kept_languages"])
def test_no_document_is_left_out(spark, name):
    docs = f"read_parquet('{FOLDER}/documents.parquet')"
    made = registry.ORACLES[name].replace("FROM documents", f"FROM {docs} documents").replace("JOIN documents", f"JOIN {docs} documents")
    want = {r[0] for r in duckdb.execute(made).fetchall()}
    found = {r.doc_id for r in registry.QUERIES[name](spark, FOLDER).collect()}
    everyone = {r[0] for r in duckdb.execute(f"SELECT doc_id FROM {docs}").fetchall()}
    assert found == want
    assert found == everyone if name == "detected_language" else len(found) > len(everyone) / 2
