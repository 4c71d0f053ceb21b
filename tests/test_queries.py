from __future__ import annotations

import pytest

import inkgrid.plans.document  # noqa: F401  (registers its queries)
import inkgrid.plans.pages  # noqa: F401
import inkgrid.plans.scalars  # noqa: F401
import inkgrid.plans.sources  # noqa: F401
from inkgrid.plans.queries import ORACLE, QUERIES
from inkgrid.plans.views import view

from .oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, name, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["box_containment", "box_intersection", "top_left_in", "segment_intersections", "nearest_in_direction", "enclosing_bounds", "shape_votes"])
def test_no_nested_loops(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scan_reads_only_what_is_used(spark, sf_dir):
    plan = QUERIES["box_containment"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan


def test_page_pairs_cross_groups(spark, sf_dir):
    boxes = view(spark, sf_dir, "v_boxes").collect()
    pairs = {(a.id, b.id): (a, b) for a in boxes for b in boxes if a.page == b.page and a.id < b.id}
    assert any(a.grp != b.grp for a, b in pairs.values())
    rows = QUERIES["bbox_geometry_page"](spark, sf_dir).collect()
    assert len(rows) == len(pairs) and {(r.a_id, r.b_id) for r in rows} == pairs.keys()
    for r in rows:
        a, b = pairs[r.a_id, r.b_id]
        assert r.gap_x == max(0, a.x0 - b.x1, b.x0 - a.x1) and r.gap_y == max(0, a.y0 - b.y1, b.y0 - a.y1)
        assert r.holds == (a.x0 <= b.x0 and a.y0 <= b.y0 and a.x1 >= b.x1 and a.y1 >= b.y1)

    def area(a, b):
        w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
        return None if w < 0 or h < 0 else w * h if w and h else 0.1 * h if not w else w * 0.1

    want = {k: area(*v) for k, v in pairs.items()}
    got = QUERIES["bbox_overlap_area_page"](spark, sf_dir).collect()
    assert {(r.a_id, r.b_id): r.area for r in got} == {k: pytest.approx(v) for k, v in want.items() if v is not None} and len(got) == sum(v is not None for v in want.values())


def test_geometry_crosses_groups_F6(spark, sf_dir):
    boxes = view(spark, sf_dir, "v_boxes").collect()
    rows = QUERIES["bbox_geometry"](spark, sf_dir).collect()
    assert "grp =" not in ORACLE["bbox_geometry"]
    assert sorted((r.a_id, r.b_id) for r in rows) == sorted((a.id, b.id) for a in boxes for b in boxes if a.page == b.page and a.id < b.id)


def test_areas_cross_groups_F7(spark, sf_dir):
    boxes = view(spark, sf_dir, "v_boxes").collect()
    rows = QUERIES["bbox_overlap_area"](spark, sf_dir).collect()
    assert "grp =" not in ORACLE["bbox_overlap_area"]
    assert sorted((r.a_id, r.b_id) for r in rows) == sorted((a.id, b.id) for a in boxes for b in boxes if a.page == b.page and a.id < b.id)


def test_link_components(spark, sf_dir):
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in view(spark, sf_dir, "v_links").collect():
        x, y = sorted((find(r.from_id), find(r.to_id)))
        parent[y] = x
    rows = QUERIES["link_components"](spark, sf_dir).collect()
    assert len(rows) == len(parent) and {r.node: r.component for r in rows} == {x: find(x) for x in list(parent)}
