"""The subpackage's queries on the smallest tables, against SQL where SQL can say it."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from starloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")

COLUMNS = {
    "op1_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op2_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op3_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op4_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op5_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op6_mpeg_audio": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op7_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_near_dedup": {"doc_id", "class_id"},
    "op9_substring_dedup": {"doc_id", "first_word", "end_word"},
    "op10_url_filters": {"page_id", "host", "path", "rule", "verdict"},
    "op11_merkle_manifest": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12_centroid_clustering": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op13_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    rows = df.collect()
    documents = spark.read.parquet(f"{SF}/{'pages' if name in ('op1_html_extraction', 'op10_url_filters') else 'embeddings' if name == 'op12_centroid_clustering' else 'documents'}.parquet").count()
    if name == "op4_best_fit_packing":
        assert len({r["doc_id"] for r in rows}) == documents
    elif name != "op9_substring_dedup":
        assert len(rows) == documents
    if name in ORACLES:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cursor = con.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        plain = lambda r: tuple(None if isinstance(r[n], float) and math.isnan(r[n]) else r[n] for n in sorted(names))
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(plain, rows), key=repr) == sorted((plain(dict(zip(names, r, strict=True))) for r in cursor.fetchall()), key=repr)
