"""Every registered query of the reference's operators against its SQL."""

import pytest

from gristmill import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, duck, same, sf_dir):
    same(plans.QUERIES[name](spark, sf_dir), duck, plans.ORACLES[name])


@pytest.mark.parametrize("name, group, most", [("w4_order_nodes_edges", "Window", 2), ("j4_attach_ids", "LeftOuter", 1)])
def test_versions_are_parsed_once_for_each_text(name, group, most, spark, sf_dir):
    # what is parsed is read from a written table of distinct texts, and rows aren't grouped again for each branch
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_" not in plan and "lineitem" not in plan
    assert 0 < plan.count(group) <= most


def test_pieces_of_lineitem_are_bounded(spark, sf_dir, same, duck, monkeypatch):
    from gristmill import fixtures

    rows = fixtures.Fixtures(spark, sf_dir).lineitem.count()
    monkeypatch.setattr(fixtures, "PIECE_ROWS", rows // 40)
    assert fixtures.Fixtures(spark, sf_dir).dealt().lineitem.rdd.getNumPartitions() >= 40
    for name in ("s13_index_lookup", "p18_pick_artifact", "w3_top_versions"):
        found = plans.QUERIES[name](spark, sf_dir)
        assert found.rdd.getNumPartitions() >= 40
        same(found, duck, plans.ORACLES[name])


def test_graph_documents_are_read_once(spark, sf_dir):
    plan = plans.QUERIES["r3_graph_document"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
