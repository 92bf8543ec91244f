"""Access and audit report plans (users from customer, audit from orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from thresher.operators.access import (
    audit_latest, change_check, directory, effective_permissions, grant_matrix, role_catalogue, team_backfill,
)
from thresher.plans.common import table
from thresher.plans.registry import register, rounded
from thresher.sources.access_tables import (
    DEFAULT_TEAM, PERMISSIONS, ROLE_PERMISSIONS, ROLES, audit_log, permissions, policy_grants, roles, user_roles, users,
)

_ROLES_SQL = ", ".join(f"({i}, '{n}')" for i, n, _ in ROLES)
_GRANTS_SQL = ", ".join(f"({r}, {p})" for r, granted in ROLE_PERMISSIONS.items() for p in granted)
_PERMS_SQL = ", ".join(f"({i}, '{r}', '{a}')" for i, r, a in PERMISSIONS)

ACCESS_CTE = f"""
roles AS (SELECT * FROM (VALUES {_ROLES_SQL}) t(id, name)),
perms AS (SELECT * FROM (VALUES {_PERMS_SQL}) t(id, resource, action)),
grants AS (SELECT * FROM (VALUES {_GRANTS_SQL}) t(role_id, permission_id)),
users AS (SELECT c_custkey AS id, lower(c_name) || '@example.org' AS email, c_name AS display_name,
                 CASE WHEN c_acctbal < 0 THEN 'DISABLED' ELSE 'ACTIVE' END AS status, CAST(NULL AS INTEGER) AS team_id
          FROM customer),
user_roles AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
                      WHEN 'FURNITURE' THEN 3 WHEN 'MACHINERY' THEN 4 END AS role_id FROM customer
               WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')),
dir AS (SELECT u.id, u.email, u.display_name, u.status, COALESCE(r.name, '') AS role
        FROM users u LEFT JOIN user_roles ur ON ur.user_id = u.id LEFT JOIN roles r ON r.id = ur.role_id),
holders AS (SELECT ur.role_id, COUNT(*) AS holders FROM users u JOIN user_roles ur ON ur.user_id = u.id
            WHERE u.status = 'ACTIVE' GROUP BY ur.role_id)"""


def _t(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return users(c), user_roles(c), roles(spark), policy_grants(spark), permissions(spark)


@register("access_effective", covers="X1 J1 U3", sql=f"""
WITH {ACCESS_CTE}
SELECT DISTINCT u.id AS user_id, r.name AS role, p.resource || ':' || p.action AS permission
FROM users u JOIN user_roles ur ON ur.user_id = u.id JOIN roles r ON r.id = ur.role_id
JOIN grants g ON g.role_id = r.id JOIN perms p ON p.id = g.permission_id
WHERE u.status = 'ACTIVE'""")
def access_effective(spark, sf_dir):
    return effective_permissions(*_t(spark, sf_dir))


@register("access_directory", covers="X2 J2", sql=f"""
WITH {ACCESS_CTE}
SELECT id, email, display_name, status, role FROM dir ORDER BY id""")
def access_directory(spark, sf_dir):
    u, ur, r, _, _ = _t(spark, sf_dir)
    return directory(u, ur, r).orderBy("id")


@register("access_roles", covers="X3 J3 A20 A21", sql=f"""
WITH {ACCESS_CTE},
pr AS (SELECT g.role_id, list_sort(list(p.resource || ':' || p.action)) AS perms
       FROM grants g JOIN perms p ON p.id = g.permission_id GROUP BY g.role_id)
SELECT r.id AS role_id, r.name AS role, COALESCE(array_to_string(pr.perms, ';'), '') AS permissions,
       COALESCE(len(pr.perms), 0) AS n_permissions, COALESCE(h.holders, 0) AS holders
FROM roles r LEFT JOIN pr ON pr.role_id = r.id LEFT JOIN holders h ON h.role_id = r.id""")
def access_roles(spark, sf_dir):
    return role_catalogue(*_t(spark, sf_dir))


@register("access_matrix", covers="X4", sql=f"""
WITH {ACCESS_CTE}
SELECT r.name AS role, p.resource || ':' || p.action AS permission, COALESCE(h.holders, 0) AS holders
FROM grants g JOIN roles r ON r.id = g.role_id JOIN perms p ON p.id = g.permission_id
LEFT JOIN holders h ON h.role_id = g.role_id""")
def access_matrix(spark, sf_dir):
    return grant_matrix(*_t(spark, sf_dir))


@register("access_audit_latest", covers="X5 O8", sql="""
SELECT o_orderkey AS id, o_custkey AS actor_user_id,
       CASE o_orderstatus WHEN 'F' THEN 'role.assign' WHEN 'O' THEN 'user.disable' ELSE 'role.revoke' END AS action,
       'user' AS target_type, CAST(o_custkey AS VARCHAR) AS target_id, o_orderpriority AS priority,
       round(o_totalprice, 4) AS total, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at
FROM orders ORDER BY o_orderkey DESC LIMIT 200""")
def access_audit_latest(spark, sf_dir):
    return rounded(audit_latest(audit_log(table(spark, sf_dir, "orders")), {"priority": "string", "total": "double"}))


def _proposals(orders):
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT")
    return urgent.select(
        F.col("o_orderkey").alias("proposal_id"), F.col("o_custkey").alias("target_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(F.lit(0).cast("long")).alias("actor_id"),
        F.lit("READ_ONLY_ANALYST").alias("new_role"),
        F.when(F.col("o_totalprice") > 300000, "DISABLED").otherwise("ACTIVE").alias("new_status"))


def _few_admins(proposals, user_roles_):
    """For the last-admin check: only users for whom someone else proposes a
    change keep the top role, so that one batch proposes to remove them all."""
    named = proposals.where("target_id <> actor_id").select(F.col("target_id").alias("user_id")).distinct()
    top = user_roles_.where("role_id = 1").join(named, "user_id", "left_semi")
    return user_roles_.where("role_id <> 1").unionByName(top)


@register("access_change_check", covers="X6 A20", sql=f"""
WITH {ACCESS_CTE},
prop AS (SELECT o_orderkey AS proposal_id, o_custkey AS target_id,
                CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END AS actor_id,
                'READ_ONLY_ANALYST' AS new_role,
                CASE WHEN o_totalprice > 300000 THEN 'DISABLED' ELSE 'ACTIVE' END AS new_status
         FROM orders WHERE o_orderpriority = '1-URGENT'),
d AS (SELECT dir.*, role = 'SUPER_ADMIN' AND status = 'ACTIVE'
                AND id IN (SELECT target_id FROM prop WHERE target_id <> actor_id) AS top FROM dir),
removals AS (SELECT target_id, MIN(proposal_id) AS first FROM prop JOIN d ON d.id = target_id
             WHERE top AND target_id <> actor_id GROUP BY target_id),
last AS (SELECT target_id FROM removals WHERE (SELECT COUNT(*) FROM removals) >= (SELECT COUNT(*) FROM d WHERE top)
         ORDER BY first DESC LIMIT 1)
SELECT proposal_id, p.target_id, actor_id, p.target_id = actor_id AS self_edit,
       p.target_id <> actor_id AND last.target_id IS NOT NULL AS last_admin,
       p.target_id <> actor_id AND last.target_id IS NULL AS allowed
FROM prop p JOIN d ON d.id = p.target_id LEFT JOIN last ON last.target_id = p.target_id""")
def access_change_check(spark, sf_dir):
    u, ur, r, _, _ = _t(spark, sf_dir)
    proposals = _proposals(table(spark, sf_dir, "orders"))
    return change_check(proposals, u, _few_admins(proposals, ur), r)


@register("access_team_backfill", covers="X7 J7", sql=f"""
WITH {ACCESS_CTE}
SELECT d.id, CASE WHEN d.role != 'SUPER_ADMIN' THEN {DEFAULT_TEAM[0]} ELSE u.team_id END AS team_id
FROM dir d JOIN users u ON u.id = d.id""")
def access_team_backfill(spark, sf_dir):
    u, ur, r, _, _ = _t(spark, sf_dir)
    return team_backfill(u, ur, r, DEFAULT_TEAM[0])
