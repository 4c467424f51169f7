"""Listing, changing and governing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import json as J
from engram.functions import text as T
from engram.plans.views import hot_keys

DAY = 86_400
#: Fixed value: tags that name no topic.
GENERIC_TAGS = ("p0", "p1", "sop", "pinned", "session")


def metadata_is(key: str, value) -> Column:
    """Whether a record's metadata has this value under the key, of the same JSON type: 5 is not "5"."""
    held = F.try_element_at(F.from_json("metadata", J.VALUES), F.lit(key))
    kind = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "number"
    of = F.schema_of_variant(held)
    same = {"string": of == "STRING", "boolean": of == "BOOLEAN", "number": ~of.isin("STRING", "BOOLEAN", "VOID") & ~of.rlike("^(OBJECT|ARRAY)")}[kind]
    read = F.try_variant_get(held, "$", {"string": "string", "boolean": "boolean", "number": "double"}[kind])
    return F.coalesce(same & (read == F.lit(value)), F.lit(False))


def listing(records: DataFrame, kinds=None, tags=None, metadata: dict | None = None, cursor: str | None = None, offset: int = 0, limit: int | None = None, by: str = "updated_at") -> DataFrame:
    """Newest first: kinds, any of the tags (whatever case), equal string metadata, then what follows the cursor, then the limit; an unknown cursor is ignored."""
    out = records
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if tags:
        out = out.filter(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(t.lower()) for t in tags])))
    for k, v in (metadata or {}).items():
        out = out.filter(metadata_is(k, v))
    order = [F.col(by).desc(), F.col("created_at"), F.col("id")]
    if cursor is not None:  # keyset paging: no numbering of all rows
        at = out.filter(F.col("id") == cursor).select(F.col(by).alias("c_by"), F.col("created_at").alias("c_at"), F.col("id").alias("c_id")).limit(1)
        out = out.join(F.broadcast(at), F.lit(True), "left").filter(F.col("c_id").isNull() | (F.col(by) < F.col("c_by")) | ((F.col(by) == F.col("c_by")) & ((F.col("created_at") > F.col("c_at")) | ((F.col("created_at") == F.col("c_at")) & (F.col("id") > F.col("c_id")))))).drop("c_by", "c_at", "c_id")
    out = out.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def past_validity(now: Column) -> Column:
    """The record's validity has run out and nothing supersedes it; needs the hot keys."""
    return F.coalesce((now > F.col("valid_until")) & F.col("superseded_by").isNull(), F.lit(False))


def classify(rules: list[tuple[str, list[str], list[str]]], default: str = "memory") -> Column:
    """The projection target: that of the metadata if a rule has it, else the first rule matching kind or a tag."""
    meta = F.get_json_object("metadata", "$.projectionTarget")
    out = F.when(meta.isin(*[t for t, *_ in rules]), meta)
    for target, kinds, tags in rules:
        match = F.lit(False)
        if kinds:
            match = match | F.col("kind").isin(*kinds)
        if tags:
            match = match | F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
        out = out.when(match, target)
    return out.otherwise(default)


def compact(records: DataFrame, most: int = 1000, content: bool = True) -> DataFrame:
    """Records for an answer: large metadata is cut to its hot keys and marked; without ``content`` the text is left to a later exact read."""
    keys = ("taskId", "sessionId", "supports", "recallCount", "lastRecalledAt", "validUntil")
    small = F.to_json(F.struct(*[F.get_json_object("metadata", f"$.{k}").alias(k) for k in keys], F.lit(True).alias("truncated")))
    out = records.withColumn("metadata", F.when(F.length("metadata") > most, small).otherwise(F.col("metadata")))
    return out if content else out.drop("content")


def decay(records: DataFrame, now: Column, age_days: int = 180, fresh_days: int = 90, target: float = 0.3) -> DataFrame:
    """Stale records, as they are after decay: id, importance_from, importance, changelog entry. The time of the last change stays.

    Spared: pinned ones, those recalled within ``fresh_days``, those younger than ``age_days``, those at or below the target.
    """
    r = hot_keys(records)
    recalled = (F.col("recall_count") > 0) & F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("last_recalled") < fresh_days * DAY, F.lit(False))
    stale = F.unix_timestamp(now) - F.unix_timestamp("updated_at") >= age_days * DAY
    hit = r.filter(~F.array_contains("tags", "pinned") & ~recalled & stale & (F.col("importance") > target))
    reason = f"stale >{age_days}d and not recalled within {fresh_days}d"
    return hit.select("id", F.col("importance").alias("importance_from"), F.lit(target).alias("importance"), "updated_at", F.lit(reason).alias("reason"))


def upsert(current: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    """The newest version of every id; the first creation time stays."""
    both = current.unionByName(changes, allowMissingColumns=True)
    w = Window.partitionBy("id")
    return both.withColumn("rn", F.row_number().over(w.orderBy(F.col(version).desc()))).withColumn("created_at", F.min("created_at").over(w)).filter("rn = 1").drop("rn")


#: What a patch may change besides its id.
PATCHED = {"content": "string", "summary": "string", "importance": "double", "confidence": "double", "source": "string", "tags": "array<string>", "kind": "string", "scope_type": "string", "scope_id": "string", "metadata": "string"}


def update(records: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Patches (an id once; any of ``PATCHED``, null or missing: unchanged) applied: trimmed, clamped, summarised anew where the content changes.

    A blank summary is made anew as well, a blank source changes nothing. ``metadata`` takes the place of all that was there; the JSON text ``null`` leaves none.
    """
    given = [F.col(c).alias(f"p_{c}") if c in patches.columns else F.lit(None).cast(kind).alias(f"p_{c}") for c, kind in PATCHED.items()]
    j = records.join(patches.select("id", *given, F.lit(True).alias("hit")), "id", "left")
    content = F.coalesce(T.trim("p_content"), F.col("content"))
    anew = T.summarize(content)
    summary = F.when(F.col("p_summary").isNotNull(), F.coalesce(F.nullif(T.trim("p_summary"), F.lit("")), anew)).when(F.col("p_content").isNotNull(), anew).otherwise(F.col("summary"))
    out = j.withColumn("summary", summary).withColumn("content", content)
    out = out.withColumn("importance", T.clamp(F.coalesce("p_importance", "importance"), 0, 1)).withColumn("confidence", T.clamp(F.coalesce("p_confidence", "confidence"), 0.05, 1))
    out = out.withColumn("tags", F.when(F.col("p_tags").isNotNull(), T.tags("p_tags")).otherwise(F.col("tags"))).withColumn("updated_at", F.when(F.col("hit"), now).otherwise(F.col("updated_at")))
    out = out.withColumn("source", F.coalesce(F.nullif(T.trim("p_source"), F.lit("")), "source")).withColumn("kind", F.coalesce("p_kind", "kind"))
    if "metadata" in records.columns:
        out = out.withColumn("metadata", F.when(F.trim("p_metadata") == "null", F.lit(None)).otherwise(F.coalesce("p_metadata", "metadata")))
    moved = F.col("p_scope_type").isNotNull() | F.col("p_scope_id").isNotNull()
    out = out.withColumn("scope_type", F.coalesce("p_scope_type", "scope_type")).withColumn("scope_id", F.coalesce(T.trim("p_scope_id"), F.col("scope_id")))
    if "scope_key" in records.columns:
        out = out.withColumn("scope_key", F.when(moved, T.scope_key()).otherwise(F.col("scope_key")))
    return out.select(*records.columns)


def forget(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records without the given ids, and without these in anyone's supports: in their metadata, all else of which stays, and as ``supports``."""
    kept = records.join(ids.select("id").distinct(), "id", "left_anti")
    supports = F.from_json(F.get_json_object("metadata", "$.supports"), "array<string>")
    lost = kept.select("id", F.explode(supports).alias("s")).join(ids.select(F.col("id").alias("s")).distinct(), "s", "left_semi").groupBy("id").agg(F.collect_set("s").alias("lost"))
    out = kept.join(lost, "id", "left").withColumn("supports", F.when(F.col("lost").isNull(), supports).otherwise(F.filter(supports, lambda s: ~F.array_contains("lost", s))))
    return out.withColumn("metadata", F.when(F.col("lost").isNull(), F.col("metadata")).otherwise(J.with_keys("metadata", {"supports": J.variants("supports")}))).drop("lost")


def dangling_supports(records: DataFrame) -> DataFrame:
    """(id, support) of supports that no record has: an anti-join on the exploded ids."""
    s = records.select("id", F.explode(F.from_json(F.get_json_object("metadata", "$.supports"), "array<string>")).alias("support"))
    return s.join(records.select(F.col("id").alias("support")), "support", "left_anti").select("id", "support")


def pinned(records: DataFrame, ids: DataFrame, pin: bool = True) -> DataFrame:
    """Records with the pinned tag put on or taken off those given."""
    hit = records.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    on = F.when(F.array_contains("tags", "pinned"), F.col("tags")).otherwise(F.array_append("tags", "pinned"))
    return hit.withColumn("tags", F.when(F.coalesce("hit", F.lit(False)), on if pin else F.array_remove("tags", "pinned")).otherwise(F.col("tags"))).drop("hit")


def attributed(records: DataFrame, ids: DataFrame, step: float = 0.05, top: float = 0.95, most: int | None = None) -> DataFrame:
    """Importance after attribution: raised by a step up to the top, never lowered. With ``most`` only the first ids (by ``ord``) of a call count."""
    asked = ids.groupBy("id").agg(F.min("ord").alias("ord")).orderBy("ord", "id").limit(most) if most is not None else ids.select("id").distinct()
    hit = records.join(asked.select("id"), "id", "left_semi")
    return hit.select("id", F.col("importance").alias("importance_from"), F.greatest("importance", F.least(F.col("importance") + step, F.lit(top))).alias("importance"))


def statistics(records: DataFrame) -> DataFrame:
    """Counts by kind, scope and source and in all, with the oldest and the newest: one pass over grouping sets."""
    g = records.groupingSets([[F.col("kind")], [F.col("scope_key")], [F.col("source")], []], "kind", "scope_key", "source")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"), F.max("updated_at").alias("newest"))


def governance(records: DataFrame) -> DataFrame:
    """One row: principles, their supports, recalls in all, records recalled, mean importance."""
    r = hot_keys(records)
    principle = F.col("kind") == "principle"
    return r.agg(F.count_if(principle).alias("principles"), F.coalesce(F.sum(F.when(principle, F.size(F.coalesce("supports", F.array().cast("array<string>"))))), F.lit(0)).cast("long").alias("supports"), F.sum("recall_count").alias("recalls"), F.count_if(F.col("recall_count") > 0).alias("recalled"), F.avg("importance").alias("mean_importance"))


def principles(records: DataFrame) -> DataFrame:
    """The principles with what supports them, newest first: id, summary, supports, updated_at."""
    p = hot_keys(records.filter("kind = 'principle'"))
    return p.select("id", F.coalesce("summary", "content").alias("summary"), F.size(F.coalesce("supports", F.array().cast("array<string>"))).alias("supports"), "updated_at").orderBy(F.col("updated_at").desc(), "id")


def hot_records(records: DataFrame, n: int = 10) -> DataFrame:
    return hot_keys(records).filter("recall_count > 0").orderBy(F.col("recall_count").desc(), "created_at", "id").limit(n).select("id", "recall_count", F.substring(F.coalesce("summary", "content"), 1, 40).alias("head"))


def primary_tag(tags: Column, generic=GENERIC_TAGS) -> Column:
    return F.lower(F.get(F.filter(tags, lambda t: ~F.lower(t).isin(*generic)), F.lit(0)))


def reflect_clusters(records: DataFrame, now: Column, since_days: int = 14, size: int = 3, most: int = 6, generic=GENERIC_TAGS) -> DataFrame:
    """Clusters of recent lessons, decisions and notes by primary tag: tag, size. The members stay where they are."""
    pool = records.filter(F.col("kind").isin("lesson", "decision", "note") & ~F.array_contains("tags", "pinned") & (F.unix_timestamp("updated_at") >= F.unix_timestamp(now) - since_days * DAY))
    tagged = pool.withColumn("tag", primary_tag(F.col("tags"), generic)).filter(F.col("tag").isNotNull())
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("created_at", "id")).alias("first")).filter(F.col("size") >= size).orderBy(F.col("size").desc(), "first").limit(most).select("tag", "size")


def reflected(records: DataFrame, documents: DataFrame, texts: DataFrame, scope: tuple[str, str], now: Column, since_days: int = 14, size: int = 3, most: int = 6, interval_days: float = 6, generic=GENERIC_TAGS) -> DataFrame:
    """The principles that a reflection writes (inputs for ``remember``): one for each cluster with a text (tag, text; from a model), with its members as supports.

    Nothing while the scope's context document (scope_key, kind, metadata) says that it reflected within the interval.
    """
    key = f"{scope[0]}:{scope[1]}".lower()
    mark = F.try_to_timestamp(F.get_json_object("metadata", "$.lastReflectAt"))
    fresh = documents.filter((F.col("kind") == "context") & (F.col("scope_key") == key) & (F.unix_timestamp(now) - F.unix_timestamp(mark) < interval_days * DAY)).select(F.lit(1).alias("fresh"))
    clusters = reflect_clusters(records, now, since_days, size, most, generic)
    pool = records.filter(F.col("kind").isin("lesson", "decision", "note") & ~F.array_contains("tags", "pinned") & (F.unix_timestamp("updated_at") >= F.unix_timestamp(now) - since_days * DAY)).withColumn("tag", primary_tag(F.col("tags"), generic))
    members = pool.join(clusters.select("tag"), "tag").groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x.id).alias("supports"))
    made = members.join(texts.filter(T.trim("text") != ""), "tag").join(fresh, F.lit(True), "left_anti")
    iso = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    meta = F.to_json(F.struct("supports", F.col("tag").alias("reflectTag"), iso.alias("reflectedAt"), iso.alias("lastRefreshedAt")))
    return made.select(
        F.xxhash64("tag").alias("ord"), F.lit(scope[0]).alias("scope_type"), F.lit(scope[1]).alias("scope_id"), F.lit(key).alias("scope_key"), F.lit("principle").alias("kind"), T.trim("text").alias("content"),
        F.lit(None).cast("string").alias("summary"), F.lit(0.75).alias("confidence"), F.lit(0.85).alias("importance"), F.lit("reflect").alias("source"), F.array("tag", F.lit("principle"), F.lit("reflected")).alias("tags"), meta.alias("metadata"),
    )


def with_reflect_marks(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """Active documents (scope_key, kind, content, metadata) after marks (scope_key, at; one a scope): a scope's context document says in ``lastReflectAt`` when it
    reflected last, all else of it stays; a scope without one gets an empty one."""
    context = documents.filter(F.col("kind") == "context").join(marks.select("scope_key", F.col("at").alias("_at")), "scope_key", "full")
    meta = F.when(F.col("_at").isNull(), F.col("metadata")).otherwise(J.with_keys("metadata", {"lastReflectAt": J.variant("_at")}))
    context = context.withColumn("metadata", meta).withColumn("kind", F.lit("context")).withColumn("content", F.coalesce("content", F.lit("")))
    return documents.filter(F.col("kind") != "context").unionByName(context.select(*documents.columns))


def principle_marks(inputs: DataFrame) -> DataFrame:
    """Marks (scope_key, at) of written principles (ord, scope_key, kind, metadata) that say when they were reflected: the last write of a scope counts, whoever wrote it."""
    at = F.get_json_object("metadata", "$.reflectedAt")
    text = F.schema_of_variant(F.from_json("metadata", J.VALUES)["reflectedAt"]) == "STRING"
    said = inputs.filter((F.col("kind") == "principle") & text & (T.trim(at) != ""))
    return said.groupBy("scope_key").agg(F.max_by(at, "ord").alias("at"))


def reflected_documents(documents: DataFrame, scope: tuple[str, str], now: Column, interval_days: float = 6) -> DataFrame:
    """The active documents after ``reflected`` ran for a scope: marked with ``now``, unless it had run within the interval."""
    key = f"{scope[0]}:{scope[1]}".lower()
    mark = F.try_to_timestamp(F.get_json_object("metadata", "$.lastReflectAt"))
    fresh = documents.filter((F.col("kind") == "context") & (F.col("scope_key") == key) & (F.unix_timestamp(now) - F.unix_timestamp(mark) < interval_days * DAY))
    due = documents.sparkSession.range(1).select(F.lit(key).alias("scope_key"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at")).join(fresh.select("scope_key"), "scope_key", "left_anti")
    return with_reflect_marks(documents, due)


def profile_sources(records: DataFrame, n: int = 40) -> DataFrame:
    """The weightiest preferences and identities, from which a profile is written."""
    return records.filter(F.col("kind").isin("preference", "identity") & (F.col("importance") >= 0.6)).orderBy(F.col("importance").desc(), "created_at", "id").limit(n).select("id", "kind", "importance", F.substring(F.regexp_replace(F.coalesce("summary", "content"), f"{T.WS}+", " "), 1, 300).alias("digest"))


#: What in a record's content raises its importance.
COMMANDS, LONG_NUMBERS, LESSONS = "`[^`]+`", "[0-9]{4,}", "教训|根因|修复|解法|正确.*做法|错误.*做法|原因.*是"
RECURRENT, DAMAGE, VERIFIED = r"重复.*踩坑|再犯|≥\s*2|多次.*同样|又.*出现.*问题", "误删|丢失.*数据|崩溃|不可逆|回滚.*恢复|全部.*删除", "✅|已验证|验证通过|确认.*生效|实测.*通过"


def rescored(records: DataFrame) -> DataFrame:
    """Importance by signals in the content; only those that rise: commands, long numbers and lesson words, recurrence, damage, verification."""
    c = F.col("content")
    commands, numbers, lessons = (F.regexp_count(c, F.lit(p)) for p in (COMMANDS, LONG_NUMBERS, LESSONS))
    imp = F.col("importance")
    new = F.when((commands + numbers + lessons >= 3) & (imp >= 0.6), F.greatest(imp, F.when(numbers >= 3, 0.85).otherwise(0.8))).otherwise(imp)
    new = F.when(c.rlike(RECURRENT), F.greatest(new, F.lit(0.9))).otherwise(new)
    new = F.when(c.rlike(DAMAGE), F.greatest(new, F.lit(0.9))).otherwise(new)
    new = F.when(c.rlike(VERIFIED), F.least(new + 0.1, F.lit(0.9))).otherwise(new)
    open_ = ~F.col("kind").isin("preference", "principle") & (imp < 0.9)
    return records.filter(open_).withColumn("new", new).filter(F.col("new") > imp).select("id", imp.alias("importance_from"), F.round("new", 2).alias("importance"))


def protected(records: DataFrame) -> DataFrame:
    return records.filter(F.col("kind").isin("preference", "principle") | (F.col("importance") >= 0.9)).select("id", "kind", "importance")


def archived(records: DataFrame, now: Column, days: int = 365) -> DataFrame:
    return records.filter((F.unix_timestamp("created_at") < F.unix_timestamp(now) - days * DAY) & (F.col("importance") < 0.5)).select("id", F.col("importance").alias("importance_from"), F.lit(0.05).alias("importance"))


def consolidation_mode(day: Column) -> Column:
    """archive on January's first Monday, monthly on any other first Monday, weekly else."""
    first_monday = (F.dayofweek(day) == 2) & (F.dayofmonth(day) <= 7)
    return F.when(first_monday & (F.month(day) == 1), "archive").when(first_monday, "monthly").otherwise("weekly")


def merge_plan(groups: DataFrame, guarded: DataFrame, most: int = 5, total: int = 20) -> DataFrame:
    """Merges (group_id, keep, drop) from ranked members (group_id, rank, id): groups cut to ``most`` besides the kept one, protected
    ones never dropped, nothing at all where the plan exceeds ``total`` deletions."""
    g = groups.filter(F.col("rank") <= most)
    keep = g.filter("rank = 0").select("group_id", F.col("id").alias("keep"))
    drop = g.filter("rank > 0").join(guarded.select("id"), "id", "left_anti").select("group_id", F.col("id").alias("drop"))
    plan = keep.join(drop, "group_id").withColumn("job", F.lit(1))
    allowed = plan.groupBy("job").agg(F.count(F.lit(1)).alias("planned")).filter(F.col("planned") <= total).select("job")
    return plan.join(F.broadcast(allowed), "job", "left_semi").drop("job")  # one row at most


def kind_digest(records: DataFrame, chars: int = 150) -> DataFrame:
    """Per kind the number of records and the length of their digest lines: the prompt of a consolidation, group by group."""
    line = F.when(F.length(T.trim("summary")) > 20, F.col("summary")).otherwise(F.substring("content", 1, chars))
    return records.withColumn("line", T.trim(line)).filter("line <> ''").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


def merged_groups(records: DataFrame, plan: DataFrame, now: Column, chars: int = 300, summary_chars: int = 200) -> DataFrame:
    """The records after a merge plan (keep, drop): kept ones hold the head of their summary, dropped ones are forgotten, and supports follow."""
    kept = plan.select(F.col("keep").alias("id"), F.lit(True).alias("merged")).distinct()
    gone = plan.select(F.col("drop").alias("id")).distinct().join(kept.select("id"), "id", "left_anti")
    after = forget(records, gone).drop("supports").join(kept, "id", "left")
    text = F.substring(F.coalesce(F.when(T.trim("summary") != "", F.col("summary")), "content"), 1, chars)
    hit = F.coalesce("merged", F.lit(False))
    out = after.withColumn("content", F.when(hit, text).otherwise(F.col("content"))).withColumn("summary", F.when(hit, F.substring("content", 1, summary_chars)).otherwise(F.col("summary")))
    return out.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).drop("merged")


def lost_protected(before: DataFrame, after: DataFrame) -> DataFrame:
    """Protected records that a job has lost: none are expected."""
    return protected(before).join(after.select("id"), "id", "left_anti")


def consolidated(records: DataFrame, plan: DataFrame, now: Column, mode: str = "weekly") -> DataFrame:
    """A consolidation from end to end: importance by content, archive of old and light records (mode archive), merges, pruned supports."""
    better = rescored(records).select("id", F.col("importance").alias("better"))
    out = records.join(better, "id", "left").withColumn("importance", F.coalesce("better", "importance")).drop("better")
    if mode == "archive":
        low = archived(out, now).select("id", F.col("importance").alias("low"))
        out = out.join(low, "id", "left").withColumn("importance", F.coalesce("low", "importance")).drop("low")
    return merged_groups(out, plan, now)


def next_first_monday(day: Column) -> Column:
    """The first Monday of the month after the day's."""
    return F.next_day(F.last_day(day), "MON")


def true_duplicates(records: DataFrame) -> DataFrame:
    """Records whose whole text, white space aside, another one has: all but the weightiest, then newest; id, keep."""
    h = records.select("id", "importance", "updated_at", F.sha2(T.collapse("content"), 256).alias("h"))
    best = h.groupBy("h").agg(F.max(F.struct("importance", "updated_at", "id")).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", F.col("b.id").alias("keep"))
    return h.join(best, "h").filter("id <> keep").select("id", "keep")


def fragment_clusters(records: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """Days and contexts with several records: day, scope_key, n."""
    return records.groupBy(F.to_date("created_at").alias("day"), "scope_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "day", "scope_key").limit(most)


def scope_drift(records: DataFrame, expected: str = "agent") -> DataFrame:
    """One row: records outside the expected scope type, and scopes of that type."""
    return records.agg(F.count_if(F.col("scope_type") != expected).alias("drifted"), F.count_distinct(F.when(F.col("scope_type") == expected, F.col("scope_key"))).alias("scopes"))


def shared_content(records: DataFrame) -> DataFrame:
    """Scopes of one type with equal texts: scope_key, n records whose text another scope has too."""
    h = records.select("scope_type", "scope_key", F.sha2(T.collapse("content"), 256).alias("h")).distinct()
    twice = h.groupBy("scope_type", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("scope_type", "h")
    return h.join(twice, ["scope_type", "h"], "left_semi").groupBy("scope_key").agg(F.count(F.lit(1)).alias("n"))


def observation(records: DataFrame, now: Column, index_ids: DataFrame) -> DataFrame:
    """One row of health figures; the index is given by the ids that it holds."""
    r = hot_keys(records)
    cut = lambda days: F.unix_timestamp(now) - days * DAY
    base = r.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "principle").alias("principle_count"), F.max(F.when(F.col("kind") == "principle", F.col("updated_at"))).alias("newest_principle"),
        F.sum("recall_count").cast("long").alias("recall_total"), F.count_if(F.col("recall_count") > 0).alias("records_with_recall"),
        F.count_if((F.col("importance") > 0.3) & (F.unix_timestamp("updated_at") < cut(180)) & ~F.contains(F.to_json("tags"), F.lit("pinned")) & (F.col("last_recalled").isNull() | (F.unix_timestamp("last_recalled") < cut(90)))).alias("decay_candidates"),
    )
    lost = dangling_supports(records).agg(F.count(F.lit(1)).alias("supports_missing"))
    stale = index_ids.select("id").join(records.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("fts_stale"))
    rows = index_ids.agg(F.count(F.lit(1)).alias("fts_rows"))
    parts = base.unionByName(lost, allowMissingColumns=True).unionByName(stale, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def judged(snapshots: DataFrame) -> DataFrame:
    """Findings (ts, level, code) of each snapshot against the one before."""
    w = Window.orderBy("ts")  # one row a run
    s = snapshots.withColumn("p_ts", F.lag("ts").over(w)).withColumn("p_recall", F.lag("recall_total").over(w)).withColumn("p_principles", F.lag("principle_count").over(w))
    days = (F.unix_timestamp("ts") - F.unix_timestamp("p_ts")) / DAY
    rule = lambda cond, level, code: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code")))
    found = F.array_compact(F.array(
        rule(F.col("fts_stale") > 0, "ALERT", "index_stale"), rule(F.col("fts_rows") != F.col("memory_rows"), "ALERT", "index_rows"), rule(F.col("supports_missing") > 0, "ALERT", "supports_missing"),
        rule((days >= 2) & (F.col("recall_total") == F.col("p_recall")), "WARN", "recall_stalled"), rule(F.unix_timestamp("ts") - F.unix_timestamp("last_reflect_at") > 10 * DAY, "WARN", "reflect_overdue"),
        rule(F.unix_timestamp("ts") - F.unix_timestamp("profile_updated_at") > 14 * DAY, "WARN", "profile_old"), rule(F.col("principle_count") > F.col("p_principles"), "INFO", "principles_grew"),
        rule(F.col("recall_total") > F.col("p_recall"), "INFO", "recall_grew"), rule(F.lit(True), "INFO", "decay_candidates"),
    ))
    return s.select("ts", F.inline(found))
