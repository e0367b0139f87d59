"""Registered queries over the whole small tables: contract columns, row counts, SQL."""

import duckdb
import pytest

from conftest import SF_SMALL
from epilake.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1": "doc_id start n_tokens ids_crc32", "op2": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3": "page_id payload_bytes payload_digest record_type refers_to", "op4": "doc_id held_out lang_pred score",
    "op5": "doc_id size source_size target taken", "op6": "doc_id", "op7": "doc_id item_id", "op8": "doc_id held_out score predicted",
    "op9": "page_id url text n_chars", "op10": "doc_id n_shingles component_id kept",
    "op11": "doc_id n_words n_removed kept_sha256",
    "op12": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13": "anchor_id positive_id rank negative_id positive_score negative_score",
}


def table(name):
    return f"read_parquet('{SF_SMALL}/{name}.parquet')"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    n = key.split("_")[0]
    got = QUERIES[key](spark, SF_SMALL)
    assert set(COLUMNS[n].split()) <= set(got.columns)
    rows = got.collect()
    con = duckdb.connect()
    if n not in ("op6", "op7", "op13"):
        name, of = {"op3": ("page_id", "pages"), "op9": ("page_id", "pages"), "op12": ("distinct conv_id", "conversations")}.get(n, ("doc_id", "documents"))
        ids = [r[0] for r in con.execute(f"select {name} from {table(of)}").fetchall()]
        assert sorted(r[COLUMNS[n].split()[0]] for r in rows) == sorted(ids)
    if key in ORACLES:
        for t in ("documents", "pages", "benchmark", "labels"):
            con.execute(f"create view {t} as select * from {table(t)}")
        cur = con.execute(ORACLES[key])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(got.columns)
        want = sorted(cur.fetchall(), key=str)
        assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == want
