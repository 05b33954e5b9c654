"""Spark queries against DuckDB on the smallest tables: a sample of each family, all with PALIMPSEST_ALL=1."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = """snap_1_state_at_head snap_2_delta_since_base hist_1_branch_default hist_2_parent_branches hist_6_first_revisions hist_8_undo_redo_revision dag_1_ancestors dag_4_path
src_4_root_info src_10_all_revisions prj_2_as_list flt_5_graph_validity flt_8_glob join_3_orphan_backings set_1_value_sets fn_scalars diff_1_graph_diff diff_5_apply diff_6_apply_sequence
mrg_3_conflict_classes mrg_9_three_way ref_6_resolve_path ref_7_dead_references gc_1_reachable fts_2_phrase fts_2_boolean trk_2_nodes trk_8_coalesce cmp_4_kept_chains cmp_8_plan sync_7_change_feed exp_1_dot_graph""".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()) if os.environ.get("PALIMPSEST_ALL") else SAMPLE)
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["proot", "branch", "item", "value", "k"] and df.count() > 790


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) > 120


@pytest.mark.parametrize("name", ["cod_1_binary_round_trip", "txt_1_text_diff", "txt_2_attributed_text"])
def test_round_trips(spark, name):
    df = catalog.queries()[name](spark, SMALL)
    assert df.count() and not df.where("not ok").count()
