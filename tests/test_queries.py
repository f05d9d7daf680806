"""Every query of the core against its SQL."""

import pytest

import hodonym.plans.drilldowns  # noqa: F401
from hodonym.plans.adapter import Views
from hodonym.plans.catalog import CATALOG
from hodonym.plans.catalog_sql import CATALOG_SQL
from hodonym.plans.panels import PANELS, PANELS_SQL
from hodonym.plans.reference_queries import P5_QUERIES, P5_SQL
from tests.compare import DATA, connection, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, str(DATA))


@pytest.mark.parametrize("name", [*CATALOG, *PANELS])
def test_query(views, con, name):
    same({**CATALOG, **PANELS}[name](views), con, {**CATALOG_SQL, **PANELS_SQL}[name])


@pytest.mark.parametrize("name", P5_QUERIES)
def test_references(spark, con, name):
    same(P5_QUERIES[name](spark, str(DATA)), con, P5_SQL[name])


def test_invariants(views):
    sd = views.sd
    assert sd.count() == sd.select("siruta", "name_normalized", "street_type").distinct().count()
    al = views.all_names
    assert al.where("corroboration_count > 4 or corroboration_count < 1").count() == 0
    assert al.where("in_registry = 1").count() <= sd.count()
    m = views.renns_m.alias("m").join(sd.alias("s"), "id" and views.renns_m.left_id == sd.id).join(views.renns.select("id", views.renns.street_type.alias("t")).alias("r"), views.renns_m.right_id == views.renns.id)
    assert m.where("m.match_type = 'exact_type_core' and not s.street_type <=> r.t").count() == 0
    assert m.where("m.match_type = 'core_only' and s.street_type <=> r.t").count() == 0
