"""Members of companies: who belongs where, which rows a member sees, invitations, users of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import js_trim



# What a member can be, and mail hosts that say nothing of a company.
ROLES, MEMBER_STATUSES = ("owner", "admin", "member", "viewer"), ("active", "invited", "suspended")
PUBLIC_HOSTS = r"^(gmail|googlemail|outlook|hotmail|icloud|yahoo|aol)\."


def one_of(value: Column, known, default: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(default)


def role(value: Column) -> Column:
    return one_of(value, ROLES, "member")


def member_status(value: Column) -> Column:
    return one_of(value, MEMBER_STATUSES, "invited")


def email_key(value: Column) -> Column:
    """What addresses are compared by; empty for a missing one."""
    return F.lower(js_trim(F.coalesce(value, F.lit(""))))


def company_name(value: Column) -> Column:
    return F.substring(F.regexp_replace(js_trim(F.coalesce(value, F.lit(""))), r"\s+", " "), 1, 80)


def title(value: Column) -> Column:
    """A slug as a title: dashes and underscores are spaces, words start with a capital, the rest stays."""
    words = F.split(F.regexp_replace(value, "[-_]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def workspace_name(email: Column, full_name: Column, default: str = "Workspace") -> Column:
    """By the company's mail domain, else the first name, else the local part of the address."""
    address, name = F.coalesce(email, F.lit("")), js_trim(F.coalesce(full_name, F.lit("")))
    domain = F.when(F.contains(address, F.lit("@")), F.get(F.split(address, "@"), F.lit(1))).otherwise("")
    own = (domain != "") & ~domain.rlike(PUBLIC_HOSTS)
    return (
        F.when(own, F.concat(title(F.get(F.split(domain, r"\."), F.lit(0))), F.lit(" Workspace")))
        .when(name != "", F.concat(F.get(F.split(name, r"\s+"), F.lit(0)), F.lit("'s Workspace")))
        .when(address != "", F.concat(F.get(F.split(address, "@"), F.lit(0)), F.lit("'s Workspace")))
        .otherwise(default)
    )


def first_memberships(members: DataFrame, companies: DataFrame) -> DataFrame:
    """(user_id, company_slug, company_name, role): each user's active membership that was updated last, then made last.

    Members without a user are left out. A company that is not in the table is named by its slug.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc("id"))
    active = members.where("status = 'active' and user_id is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    named = companies.select(F.col("slug").alias("company_slug"), F.col("name").alias("_name"))
    return active.join(named, "company_slug", "left").select(
        "user_id", "company_slug", F.coalesce("_name", title(F.col("company_slug"))).alias("company_name"), role(F.col("role")).alias("role")
    )


def visible(rows: DataFrame, members: DataFrame, user_id, scope: str = "company_slug") -> DataFrame:
    """Rows of companies in which the user is an active member."""
    mine = members.where((F.col("user_id") == user_id) & (F.col("status") == "active")).select(scope)
    return rows.join(mine, scope, "left_semi")


def own_rows(members: DataFrame, user_id) -> DataFrame:
    """Of the members themselves a user sees only their own rows."""
    return members.where(F.col("user_id") == user_id)


def visible_counts(rows: DataFrame, members: DataFrame, scope: str = "company_slug") -> DataFrame:
    """(user_id, rows) for all users at once: memberships meet counts, so no row is copied per member."""
    per_scope = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n"))
    mine = members.where("status = 'active' and user_id is not null").select("user_id", scope).distinct()
    return mine.join(per_scope, scope).groupBy("user_id").agg(F.sum("n").alias("rows"))


def users_by_email(wanted: DataFrame, users: DataFrame) -> DataFrame:
    """(email, user_id): of users that share an address the one with the smallest id; blank addresses match nobody."""
    found = users.select(email_key(F.col("email")).alias("email"), "user_id").groupBy("email").agg(F.min("user_id").alias("user_id"))
    return wanted.select(email_key(F.col("email")).alias("email")).where("email <> ''").distinct().join(found, "email")


def accepted_invitations(members: DataFrame, users: DataFrame) -> DataFrame:
    """(id, user_id): invitations without a user whose address belongs to a user who has accepted.

    users: user_id, email, accepted. Of several invitations of a company to an address the last counts; of
    several users the smallest id.
    """
    pending = members.where("status = 'invited' and user_id is null").select("company_slug", "id", email_key(F.col("email")).alias("email")).where("email <> ''")
    pending = pending.groupBy("company_slug", "email").agg(F.max("id").alias("id"))
    ready = users.where("accepted").select(email_key(F.col("email")).alias("email"), "user_id").groupBy("email").agg(F.min("user_id").alias("user_id"))
    return pending.join(ready, "email").select("id", "user_id")


def reconciled(members: DataFrame, accepted: DataFrame) -> DataFrame:
    """Members after accepted invitations: they get their user and are active."""
    who = accepted.select(F.col("id").alias("_id"), F.col("user_id").alias("_user"))
    out = members.join(who, F.col("id") == F.col("_id"), "left")
    new = {"user_id": F.coalesce("user_id", "_user"), "status": F.when(F.col("_user").isNotNull(), "active").otherwise(F.col("status"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in members.columns])


def in_order(members: DataFrame) -> DataFrame:
    """Members with their place in a company's list: by status, role, time of creation, then id."""
    order = Window.partitionBy("company_slug").orderBy("status", "role", "created_at", "id")
    return members.withColumn("place", F.row_number().over(order))


def with_users(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with the user of their company and installation; unknown ones get an id made of both."""
    known = users.select(F.col("company_slug").alias("_c"), F.col("install_id").alias("_i"), F.col("user_id").alias("_user"))
    made = F.concat(F.lit("user_"), F.substring(F.sha2(F.concat_ws(":", "company_slug", "install_id"), 256), 1, 12))
    out = events.join(known, (F.col("company_slug") == F.col("_c")) & (F.col("install_id") == F.col("_i")), "left")
    return out.select(*events.columns, F.coalesce("_user", made).alias("user_id"))


def active_user_counts(users: DataFrame, windows: dict[str, int], last_day: Column) -> DataFrame:
    """(company_slug, time_range, active_users): users seen since the start of each window, and 'all'; one pass."""
    day = F.to_date("last_seen")
    counts = users.select("company_slug", day.alias("day"), last_day.alias("last")).groupBy("company_slug").agg(
        *[F.count(F.when(F.col("day") >= F.date_sub("last", n), 1)).alias(name) for name, n in windows.items()], F.count(F.lit(1)).alias("all")
    )
    return counts.unpivot("company_slug", [*windows, "all"], "time_range", "active_users")


