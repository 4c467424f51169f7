"""Scopes: what a request may see and how much it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import text as T

#: Fixed values.
SCOPE_TYPES = ("agent", "session", "user", "task", "document", "project", "repo")
WEIGHTS = {"task": 1.15, "repo": 1.1, "project": 1.08, "user": 1.05, "agent": 1.0, "session": 0.9}


def check_scope_type(name: str) -> str:
    """The name, if it is a scope type; a ValueError otherwise."""
    if name not in SCOPE_TYPES:
        raise ValueError(f"unknown scope type {name!r}; expected one of {', '.join(SCOPE_TYPES)}")
    return name


def task_id(project: Column, repo: Column, task: Column) -> Column:
    """project::repo (or _)::task; null without a task."""
    return F.when(F.coalesce(task, F.lit("")) != "", F.concat_ws("::", project, F.coalesce(repo, F.lit("_")), task))


def repo_id(project: Column, repo: Column) -> Column:
    return F.when(F.coalesce(repo, F.lit("")) != "", F.concat_ws("::", project, repo))


def _scope(kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.struct(F.lit(kind).alias("scope_type"), key.alias("scope_id"), F.lit(WEIGHTS.get(kind, 1.0)).alias("weight")))


def recall_scopes(contexts: DataFrame, key: str = "context_id") -> DataFrame:
    """The scopes that a context recalls from, ordered: key, ord, scope_type, scope_id, weight, scope_key.

    A context has project_id, repo_id, user_id, agent_ids, session_id, task_id, all_scopes, any_type and any_id. ``all_scopes`` asks for no scope,
    that is, for everything; a single explicit scope stands alone.
    """
    c = F.col
    agents = F.transform(F.array_distinct(F.filter(F.coalesce("agent_ids", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != ""))), lambda a: F.struct(F.lit("agent").alias("scope_type"), a.alias("scope_id"), F.lit(1.0).alias("weight")))
    blank = lambda x: F.when(x != "", x)
    fixed = F.array(_scope("task", task_id(c("project_id"), c("repo_id"), c("task_id"))), _scope("repo", repo_id(c("project_id"), c("repo_id"))), _scope("project", c("project_id")), _scope("user", blank(c("user_id"))))
    own = F.array_compact(F.concat(fixed, agents, F.array(_scope("session", blank(c("session_id"))))))
    explicit = F.array(F.struct(c("any_type").alias("scope_type"), c("any_id").alias("scope_id"), F.lit(1.0).alias("weight")))
    chosen = F.when(F.coalesce(c("all_scopes"), F.lit(False)), F.slice(own, 1, 0)).when(c("any_type").isNotNull(), explicit).otherwise(own)
    return contexts.select(key, F.posexplode(chosen).alias("ord", "s")).select(key, "ord", "s.*").withColumn("scope_key", T.scope_key())


def write_scope(project: Column, repo: Column, agent: Column) -> Column:
    """repo before agent before project."""
    repo_key = repo_id(project, repo)
    return F.when(repo_key.isNotNull(), F.concat(F.lit("repo:"), repo_key)).when(agent.isNotNull(), F.concat(F.lit("agent:"), agent)).otherwise(F.concat(F.lit("project:"), project))


def durable_scope(kind: Column, user: Column, task: Column, write: Column) -> Column:
    """Preferences and identities belong to the user, decisions to the task, if there is one; the rest to the write scope."""
    return F.when(kind.isin("preference", "identity") & user.isNotNull(), F.concat(F.lit("user:"), user)).when((kind == "decision") & task.isNotNull(), F.concat(F.lit("task:"), task)).otherwise(write)


def of_types(scopes: DataFrame, *types: str) -> DataFrame:
    """Only the scopes of these types."""
    return scopes.filter(F.col("scope_type").isin(*map(check_scope_type, types)))


def allowed(records: DataFrame, requested: DataFrame) -> DataFrame:
    """Whether each record (id) is in the requested scopes, by key or wildcard: id, allowed."""
    hit = in_scopes(records, requested).select("id", F.lit(True).alias("allowed"))
    return records.select("id").join(hit, "id", "left").select("id", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def context_of_url(scope: str | None, view: str | None = None, agents: tuple[str, ...] = ()) -> dict:
    """The context that the parameters ``scope`` and ``view`` of a request ask for, in the columns of ``recall_scopes``.

    ``all`` asks for everything, ``type:id`` for one scope, a bare name for the agent of that name, ``shared`` (as view) for all known agents and any user.
    """
    scope, view = (scope or "").strip(), (view or "").strip()
    none = {"user_id": None, "agent_ids": None, "all_scopes": False, "any_type": None, "any_id": None}
    if "all" in (scope, view):
        return none | {"all_scopes": True}
    kind, _, ident = scope.partition(":")
    if scope and ":" not in scope:
        return none | {"any_type": "agent", "any_id": scope.lower()}
    if ident.strip() and kind.lower() in SCOPE_TYPES:
        return none | {"any_type": kind.lower(), "any_id": ident.strip()}
    return none | ({"agent_ids": [*agents], "user_id": "*"} if view == "shared" else {})


def in_scopes(records: DataFrame, requested: DataFrame) -> DataFrame:
    """Records of the requested scopes (scope_type, scope_id): equal keys, or any id of a type where ``*`` is asked for.

    Two equi semi-joins by way of one: a request row matches on the key or on the type's wildcard key.
    """
    keys = requested.select(F.when(F.col("scope_id") == "*", F.concat("scope_type", F.lit(":*"))).otherwise(T.scope_key()).alias("asked")).distinct()
    both = records.withColumn("asked", F.explode(F.array(F.col("scope_key"), F.concat("scope_type", F.lit(":*"))))).join(keys, "asked", "left_semi").drop("asked")
    return both.dropDuplicates(["id"])


def scope_weights(records: DataFrame, requested: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, id, scope): for each request and matching record the weight of the first matching scope, over 1.5."""
    asked = requested.select(key, "ord", F.least(F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)), F.lit(1.5)).alias("w"), F.when(F.col("scope_id") == "*", F.concat("scope_type", F.lit(":*"))).otherwise(T.scope_key()).alias("asked"))
    keyed = records.select("id", F.explode(F.array(F.col("scope_key"), F.concat("scope_type", F.lit(":*")))).alias("asked"))
    return keyed.join(asked, "asked").groupBy(key, "id").agg((F.min_by("w", "ord") / 1.5).alias("scope"))
