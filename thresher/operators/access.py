"""Access and audit reports over the access tables.

The role and permission tables are small; whether a join broadcasts them is
left to Spark, which sees their size at run time.  The user and audit tables
are the large ones and are only ever shuffled on their own keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thresher.functions.timeutil import ntz_text

AUDIT_PAGE = 200
TOP_ROLE = "SUPER_ADMIN"


def role_permission_names(roles: DataFrame, grants: DataFrame, perms: DataFrame) -> DataFrame:
    """(role_id, role, resource, action, permission) -- distinct."""
    return (grants.join(roles, grants["role_id"] == roles["id"]).drop("id")
            .join(perms, grants["permission_id"] == perms["id"]).drop("id")
            .select("role_id", F.col("name").alias("role"), "resource", "action",
                    F.concat_ws(":", "resource", "action").alias("permission"))
            .distinct())


def effective_permissions(users: DataFrame, user_roles: DataFrame, roles: DataFrame, grants: DataFrame,
                          perms: DataFrame) -> DataFrame:
    """Every active user's role and permissions.  One role per user (the
    key of user_roles) and a distinct role->permission side make the
    result distinct without a shuffle of the expanded rows."""
    rp = role_permission_names(roles, grants, perms)
    active = users.where(F.col("status") == "ACTIVE").select(F.col("id").alias("user_id"))
    return active.join(user_roles, "user_id").join(rp, "role_id").select("user_id", "role", "permission")


def directory(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """All users with their role name, '' when they hold none."""
    r = roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"))
    j = users.join(user_roles, users["id"] == user_roles["user_id"], "left").join(r, "role_id", "left")
    return j.select("id", "email", "display_name", "status", F.coalesce(F.col("role"), F.lit("")).alias("role"))


def role_catalogue(users: DataFrame, user_roles: DataFrame, roles: DataFrame, grants: DataFrame,
                   perms: DataFrame) -> DataFrame:
    """Each role with its permission list (sorted text, empty for none), the
    permission count and how many active users hold it."""
    names = grants.join(perms, grants["permission_id"] == perms["id"]).select(
        "role_id", F.concat_ws(":", "resource", "action").alias("perm"))
    per_role = names.groupBy("role_id").agg(F.array_sort(F.collect_set("perm")).alias("perms"))
    holders = users.where(F.col("status") == "ACTIVE").select(F.col("id").alias("user_id")) \
        .join(user_roles, "user_id").groupBy("role_id").agg(F.count(F.lit(1)).alias("holders"))
    j = roles.join(per_role, roles["id"] == per_role["role_id"], "left").drop("role_id") \
        .join(holders, roles["id"] == holders["role_id"], "left")
    return j.select(
        F.col("id").alias("role_id"), F.col("name").alias("role"),
        F.coalesce(F.array_join("perms", ";"), F.lit("")).alias("permissions"),
        F.coalesce(F.size("perms"), F.lit(0)).alias("n_permissions"),
        F.coalesce(F.col("holders"), F.lit(0).cast("long")).alias("holders"))


def grant_matrix(users: DataFrame, user_roles: DataFrame, roles: DataFrame, grants: DataFrame,
                 perms: DataFrame) -> DataFrame:
    """(role, permission) pairs the policies grant, with the number of active
    users who get each through that role."""
    rp = role_permission_names(roles, grants, perms)
    holders = users.where(F.col("status") == "ACTIVE").select(F.col("id").alias("user_id")) \
        .join(user_roles, "user_id").groupBy("role_id").agg(F.count(F.lit(1)).alias("holders"))
    return rp.join(holders, "role_id", "left").select(
        "role", "permission", F.coalesce(F.col("holders"), F.lit(0).cast("long")).alias("holders"))


def audit_latest(audit: DataFrame, fields: dict[str, str], n: int = AUDIT_PAGE) -> DataFrame:
    """Newest `n` audit rows by id with the asked-for fields (name -> type) of
    their JSON metadata; a field that is missing or of another type, or text
    that isn't JSON, gives null."""
    top = audit.orderBy(F.col("id").desc()).limit(n)
    meta = F.try_parse_json("metadata")
    field = lambda name, kind: F.try_variant_get(meta, f"$.{name}", kind).alias(name)
    return top.select("id", "actor_user_id", "action", "target_type", "target_id",
                      *[field(name, kind) for name, kind in fields.items()],
                      ntz_text(F.col("created_at")).alias("created_at"))


def change_check(proposals: DataFrame, users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Check a batch of proposed (target, actor, role, status) changes, taken
    in the order of proposal_id: refuse self edits, and refuse removing
    (demoting or disabling) the last active top admin.

    Each accepted removal leaves one admin fewer, so when the batch removes
    every one of them, the admin whose first removal comes last is the one
    who must stay, and all removals of that admin are refused.  That takes
    one aggregate per target and no running state.  Promotions in the same
    batch don't count (they may themselves be refused)."""
    d = directory(users, user_roles, roles).select(
        F.col("id").alias("target_id"), ((F.col("role") == TOP_ROLE) & (F.col("status") == "ACTIVE")).alias("top"))
    admins = d.where("top").agg(F.count(F.lit(1))).scalar()
    j = proposals.join(d, "target_id", "inner")
    self_edit = F.col("target_id") == F.col("actor_id")
    removal = F.col("top") & ~self_edit & ((F.col("new_role") != TOP_ROLE) | (F.col("new_status") != "ACTIVE"))
    firsts = j.where(removal).groupBy("target_id").agg(F.min("proposal_id").alias("first"))
    stays = firsts.agg(F.max_by("target_id", "first").alias("stays"), F.count(F.lit(1)).alias("removed")) \
        .select(F.when(F.col("removed") >= admins, F.col("stays"))).scalar()
    last = F.coalesce(removal & (F.col("target_id") == stays), F.lit(False))
    return j.select("proposal_id", "target_id", "actor_id", self_edit.alias("self_edit"),
                    last.alias("last_admin"), (~self_edit & ~last).alias("allowed"))


def team_backfill(users: DataFrame, user_roles: DataFrame, roles: DataFrame, default_team_id: int) -> DataFrame:
    """Everyone without the top role goes to the default team; top-role
    holders keep their team (null = above all teams)."""
    d = directory(users, user_roles, roles)
    t = users.select("id", "team_id")
    return d.join(t, "id").select(
        "id", F.when(F.col("role") != TOP_ROLE, F.lit(default_team_id)).otherwise(F.col("team_id")).alias("team_id"))
