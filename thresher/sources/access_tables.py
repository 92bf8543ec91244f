"""Access tables.

Roles and permissions are seed data (fixed values below).  The grant
matrix is the seed policies' pairs.  Users, role assignments and the
audit trail are derived from the test tables so the reports grow with the
data: every customer is a user (negative balance = disabled; market
segment decides the role, one segment has none), every order is an audit
entry.  On a deployment these are real tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The seed roles (id, name, is_system) and permissions
# (id, resource, action), in their seed order.
ROLES = [
    (1, "SUPER_ADMIN", True),
    (2, "RULE_MANAGER", True),
    (3, "RULE_EDITOR", True),
    (4, "READ_ONLY_ANALYST", True),
]
PERMISSIONS = [
    (1, "rules", "create"),
    (2, "rules", "read"),
    (3, "rules", "update"),
    (4, "rules", "delete"),
    (5, "rules", "delete_draft"),
    (6, "rules", "publish"),
    (7, "live_analysis", "read"),
    (8, "aggregated_analysis", "read"),
    (9, "historical_analysis", "read"),
    (10, "historical_analysis", "execute"),
    (11, "iam", "manage"),
]
# The permission ids that the seed policies grant to each role.
ROLE_PERMISSIONS = {
    1: (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11),
    2: (1, 2, 3, 4, 6, 7, 8, 9, 10),
    3: (1, 2, 3, 5, 7, 8, 9, 10),
    4: (2, 7, 8, 9, 10),
}
DEFAULT_TEAM = (1, "MISC", True)

# Stand-in: market segment -> role id (HOUSEHOLD holds no role).
SEGMENT_ROLE = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "MACHINERY": 4}


def roles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROLES, "id int, name string, is_system boolean")


def permissions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERMISSIONS, "id int, resource string, action string")


def policy_grants(spark: SparkSession) -> DataFrame:
    """role_permissions as the seed policies grant them."""
    pairs = [(role, permission) for role, granted in ROLE_PERMISSIONS.items() for permission in granted]
    return spark.createDataFrame(pairs, "role_id int, permission_id int")


def users(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("sub-"), F.col("c_custkey").cast("string")).alias("external_subject"),
        F.concat(F.lower(F.col("c_name")), F.lit("@example.org")).alias("email"),
        F.col("c_name").alias("display_name"),
        F.when(F.col("c_acctbal") < 0, "DISABLED").otherwise("ACTIVE").alias("status"),
        F.lit(None).cast("int").alias("team_id"),
    )


def user_roles(customer: DataFrame) -> DataFrame:
    seg = F.col("c_mktsegment")
    role = F.lit(None).cast("int")
    for name, rid in SEGMENT_ROLE.items():
        role = F.when(seg == name, F.lit(rid)).otherwise(role)
    return customer.select(F.col("c_custkey").alias("user_id"), role.alias("role_id"),
                           F.lit(None).cast("long").alias("assigned_by")).where(F.col("role_id").isNotNull())


def audit_log(orders: DataFrame) -> DataFrame:
    st = F.col("o_orderstatus")
    action = F.when(st == "F", "role.assign").when(st == "O", "user.disable").otherwise("role.revoke")
    meta = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total")))
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("actor_user_id"), action.alias("action"),
        F.lit("user").alias("target_type"), F.col("o_custkey").cast("string").alias("target_id"),
        meta.alias("metadata"), F.col("o_orderdate").alias("created_at"),
    )
