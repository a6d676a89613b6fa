"""Registered queries: contract columns, and equality with DuckDB where it has SQL."""

import os

import duckdb
import pytest
from shelfmark.llm import queries as Q

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_benchmark_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_substring_dedup": "doc_id bigint, start bigint, end bigint, ref_doc_id bigint, ref_start bigint, ref_end bigint, n_match bigint, similarity double",
    "op7_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op8_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_license_scan": "doc_id bigint, license string, containment double",
    "op10_url_filter": "page_id bigint, host string, path string, rule string, verdict string, score double",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def shown(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    got = Q.queries()[name](spark, DATA)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == COLUMNS[name]
    rows = [tuple(r) for r in got.collect()]
    if name not in Q.oracle_sql():
        table = "pages" if name.startswith("op10") else "documents"
        assert rows and (name[:3] in ("op6", "op8") or len(rows) == spark.read.parquet(f"{DATA}/{table}.parquet").count())
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert shown(rows) == shown([tuple(r[names.index(c)] for c in got.columns) for r in found.fetchall()])
