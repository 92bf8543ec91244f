"""Access matrix facts from the seed data."""

from pyspark.sql import functions as F

from thresher.operators.access import role_permission_names
from thresher.sources.access_tables import permissions, policy_grants, roles


def test_seed_counts(spark):
    r, p = roles(spark), permissions(spark)
    assert r.count() == 4 and p.count() == 11
    rp = role_permission_names(r, policy_grants(spark), p)
    top = {x.permission for x in rp.where("role = 'SUPER_ADMIN'").collect()}
    assert len(top) == 11
    editor = {x.permission for x in rp.where("role = 'RULE_EDITOR'").collect()}
    assert "rules:publish" not in editor and "rules:delete" not in editor
    assert "rules:delete_draft" in editor
    manager = {x.permission for x in rp.where("role = 'RULE_MANAGER'").collect()}
    assert "iam:manage" not in manager and "rules:delete_draft" not in manager
