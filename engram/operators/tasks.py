"""Task transcripts, rolling summaries, prompt windows and active documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import json as J
from engram.functions import text as T

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def appended(entries: DataFrame, incoming: DataFrame, tasks: DataFrame) -> DataFrame:
    """Incoming entries (task_id, ord, role, content) of existing tasks with their sequence numbers: one past the task's greatest, in order.

    Blank contents are dropped, unknown roles count as the assistant's.
    """
    last = entries.groupBy("task_id").agg(F.max("sequence").alias("last"))
    new = incoming.withColumn("content", T.trim("content")).filter("content <> ''").join(tasks.select("task_id").distinct(), "task_id", "left_semi").join(last, "task_id", "left")
    role = F.when(F.col("role").isin("user", "assistant", "system", "tool"), F.col("role")).otherwise("assistant")
    return new.withColumn("sequence", (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("task_id").orderBy("ord"))).cast("long")).select("task_id", "sequence", role.alias("role"), "content", T.estimate_tokens("content").alias("token_count"))


STATUSES = ("active", "paused", "completed", "archived")


def with_changes(tasks: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Tasks (task_id, scope_key, title, status, created_at, updated_at) after changes (ord, task_id, scope_key, title, status; null: unchanged) in their order.

    An unknown task is made, with its id for want of a title; an unknown status counts as active.
    """
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).when(F.col("status").isNotNull(), "active")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"c_{c}")
    c = changes.withColumn("status", known).withColumn("title", F.when(T.trim("title") != "", T.trim("title"))).groupBy("task_id").agg(last("scope_key"), last("title"), last("status"), F.lit(True).alias("hit"))
    j = tasks.join(c, "task_id", "full")
    return j.select(
        "task_id", F.coalesce("scope_key", "c_scope_key").alias("scope_key"), F.coalesce("c_title", "title", "task_id").alias("title"), F.coalesce("c_status", "status", F.lit("active")).alias("status"),
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("hit"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def summarised(entries: DataFrame, pending: int = 48) -> DataFrame:
    """Entries after a fold of summaries: a task's first ``pending`` open ones are marked, with their text as summary where they had none."""
    w = Window.partitionBy("task_id").orderBy("sequence")
    todo = entries.filter(~F.col("summarized")).select("task_id", "sequence").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= pending).select("task_id", "sequence", F.lit(True).alias("done"))
    j = entries.join(todo, ["task_id", "sequence"], "left")
    done = F.coalesce("done", F.lit(False))
    return j.withColumn("summary", F.when(done & (F.coalesce(T.trim("summary"), F.lit("")) == ""), T.trim("content")).otherwise(F.col("summary"))).withColumn("summarized", F.col("summarized") | done).drop("done")


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All task tables without the tasks that go."""
    return {k: t.join(gone.select("task_id").distinct(), "task_id", "left_anti") for k, t in tables.items()}


def rolling_summaries(entries: DataFrame, state: DataFrame, most: int = 600, pending: int = 48, trimmed: bool = True) -> DataFrame:
    """The summary after folding in a task's pending entries, without a model: the old one and the entries' summaries or texts, a line
    each, cut to ``most``; the head stays. Only the first ``pending`` entries of a task are read. Summaries lose outer white space unless ``trimmed`` is off;
    the end of the whole is trimmed anyway."""
    w = Window.partitionBy("task_id").orderBy("sequence")
    todo = entries.filter(~F.col("summarized")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= pending)
    text = F.when(F.coalesce(T.trim("summary"), F.lit("")) != "", T.trim("summary") if trimmed else F.col("summary")).otherwise(T.trim("content"))
    lines = todo.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", text.alias("line")))), lambda x: x.line), "\n").alias("lines"))
    both = lines.join(state.select("task_id", "rolling_summary"), "task_id", "left")
    return both.select("task_id", T.rtrim(T.clamp_chars(T.join_nonblank("\n", T.trim("rolling_summary"), "lines"), most)).alias("rolling_summary"))


def windows(tasks: DataFrame, entries: DataFrame, decisions: DataFrame, queries: DataFrame, most: int = 4000, recent: int = 24, shown: int = 12, mode: str = "oldest") -> DataFrame:
    """The prompt window of each task: sections for summary, decisions, entries, query and tool context, cut to max(500, ``most``).

    ``mode`` says which ``recent`` entries stand in it: the oldest, or the latest.
    """
    w = Window.partitionBy("task_id").orderBy(F.col("sequence").asc() if mode == "oldest" else F.col("sequence").desc())
    e = entries.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= recent).withColumn("line", F.concat("role", F.lit(": "), T.trim("content")))
    e = e.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "line"))), lambda x: x.line), "\n").alias("entries"), F.sum(F.length(T.trim("content"))).alias("entry_chars"))
    d = decisions.withColumn("rn", F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("created_at").desc(), "id")))
    d = d.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= shown, F.struct("rn", F.concat(F.lit("- "), T.trim("content")).alias("line"))))), lambda x: x.line), "\n").alias("decisions"), F.sum(F.length(T.trim("content"))).alias("decision_chars"))
    j = tasks.select("task_id", "rolling_summary").join(d, "task_id", "left").join(e, "task_id", "left").join(queries, "task_id", "left")
    titled = lambda title, c: F.when(F.coalesce(T.trim(c), F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), T.trim(c)))
    budget = max(500, most)
    text = T.clamp_chars(T.join_nonblank("\n\n", titled("Task summary", "rolling_summary"), titled("Key decisions", "decisions"), titled("Recent task entries", "entries"), titled("Current query", "query"), titled("Tool context", "tool_context")), budget)
    return j.select("task_id", text.alias("window"), F.coalesce("decision_chars", F.lit(0)).alias("decision_chars"), F.coalesce("entry_chars", F.lit(0)).alias("entry_chars"), F.length(text).cast("long").alias("total"), F.lit(budget).cast("long").alias("budget"))


def latest_documents(writes: DataFrame) -> DataFrame:
    """Active documents as last written: one per kind and scope; an empty last write clears it."""
    w = Window.partitionBy("kind", "scope_key").orderBy(F.col("ord").desc())
    return writes.withColumn("rn", F.row_number().over(w)).filter("rn = 1 and trim(content) <> ''").drop("rn")


def distilled(writes: DataFrame, context_chars: int = 400, experience_chars: int = 800) -> DataFrame:
    """Contexts and experiences cut to their sizes."""
    return writes.withColumn("content", F.when(F.col("kind") == "context", T.clamp_chars("content", context_chars)).when(F.col("kind") == "experience", T.clamp_chars("content", experience_chars)).otherwise(F.col("content")))


def warm_up(tasks: DataFrame, n: int = 3) -> DataFrame:
    """Per scope the latest open tasks with the head of their summaries."""
    w = Window.partitionBy("scope_key").orderBy(F.col("updated_at").desc(), "task_id")
    return tasks.filter(F.col("status").isin("active", "paused")).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("scope_key", "rn", "task_id", F.substring(F.coalesce("rolling_summary", F.lit("")), 1, 200).alias("head"))


# -- experience documents


def experience_entries(documents: DataFrame) -> DataFrame:
    """Lines of experience documents without bullets: scope_key, ord, entry_id, text."""
    lines = F.transform(F.split("content", "\r?\n"), lambda x: F.regexp_replace(T.trim(x), f"^[-*]{T.WS}+", ""))
    return documents.select("scope_key", F.posexplode(lines).alias("ord", "text")).filter("text <> ''").select("scope_key", "ord", T.stable_hash36("text").alias("entry_id"), "text")


def attribution(entries: DataFrame, responses: DataFrame, least: float = 0.12, n: int = 5) -> DataFrame:
    """Entries that a response (scope_key, response_id, response) draws on: the ``n`` of greatest Jaccard similarity of long words."""
    both = entries.withColumn("words", T.long_words("text")).join(responses.withColumn("said", T.long_words("response")), "scope_key").withColumn("confidence", T.jaccard("words", "said")).filter(F.col("confidence") >= least)
    w = Window.partitionBy("response_id").orderBy(F.col("confidence").desc(), "ord")
    return both.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("response_id", "entry_id", "rn", "confidence")


STATS = "array<struct<id:string,text:string,activationCount:bigint,positiveCount:bigint,firstSeenAt:string,lastActivatedAt:string>>"


def entry_stats(documents: DataFrame) -> DataFrame:
    """The counters that experience documents keep in their metadata: scope_key, entry_id, text, activations, positives, first_seen, last_activated, ord."""
    s = documents.select("scope_key", F.posexplode(F.from_json(F.get_json_object("metadata", "$.entryStats"), STATS)).alias("ord", "s"))
    return s.select("scope_key", F.col("s.id").alias("entry_id"), F.col("s.text").alias("text"), F.coalesce("s.activationCount", F.lit(0)).alias("activations"), F.coalesce("s.positiveCount", F.lit(0)).alias("positives"), F.col("s.firstSeenAt").alias("first_seen"), F.col("s.lastActivatedAt").alias("last_activated"), "ord")


def merged_stats(entries: DataFrame, stats: DataFrame, now: Column) -> DataFrame:
    """Counters after a document has these entries: known ones keep their counts and take the new text, new ones start at 0, gone ones stay."""
    e = entries.groupBy("scope_key", "entry_id").agg(F.min_by("text", "ord").alias("new_text"), F.min("ord").alias("new_ord"))
    j = stats.join(e, ["scope_key", "entry_id"], "full")
    return j.select(
        "scope_key", "entry_id", F.coalesce("new_text", "text").alias("text"), F.coalesce("activations", F.lit(0)).alias("activations"), F.coalesce("positives", F.lit(0)).alias("positives"), F.coalesce("first_seen", F.date_format(now, ISO)).alias("first_seen"),
        "last_activated", F.coalesce("ord", F.col("new_ord") + 1_000_000).alias("ord"),
    )


def activated(stats: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Counters after responses drew on entries (scope_key, entry_id, outcome): +1 each, +1 positive where the outcome was."""
    h = hits.groupBy("scope_key", "entry_id").agg(F.count(F.lit(1)).alias("more"), F.count_if(F.col("outcome") == "positive").alias("good"))
    j = stats.join(h, ["scope_key", "entry_id"], "left")
    out = j.withColumn("activations", F.col("activations") + F.coalesce("more", F.lit(0))).withColumn("positives", F.col("positives") + F.coalesce("good", F.lit(0)))
    return out.withColumn("last_activated", F.when(F.col("more") > 0, F.date_format(now, ISO)).otherwise(F.col("last_activated"))).drop("more", "good")


def with_stats(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents with these counters in their metadata; all else of that stays."""
    one = F.struct(F.col("ord"), F.struct(F.col("entry_id").alias("id"), "text", F.col("activations").alias("activationCount"), F.col("positives").alias("positiveCount"), F.col("first_seen").alias("firstSeenAt"), F.col("last_activated").alias("lastActivatedAt")).alias("s"))
    g = stats.groupBy("scope_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry_id", one.alias("one")))), lambda x: x.one.s).alias("kept"))
    j = documents.join(g, "scope_key", "left")
    return j.withColumn("metadata", F.when(F.col("kept").isNotNull(), J.with_keys("metadata", {"entryStats": J.variants("kept")})).otherwise(F.col("metadata"))).drop("kept")


def calibrated(documents: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Documents without the lines whose entries are zombies or harmful; the mark of the calibration is set."""
    e = experience_entries(documents).join(verdicts.filter(F.col("verdict").isin("zombie", "harmful")).select("scope_key", "entry_id").distinct(), ["scope_key", "entry_id"], "left_anti")
    text = e.groupBy("scope_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.concat(F.lit("- "), x.text)), "\n").alias("new"))
    j = documents.join(text, "scope_key", "left").withColumn("content", F.coalesce("new", F.lit(""))).drop("new")
    return j.withColumn("metadata", J.with_keys("metadata", {"lastCalibrationAt": J.variant(F.date_format(now, ISO))}))


def calibration(stats: DataFrame, fragments: DataFrame) -> DataFrame:
    """A verdict on each entry (scope_key, entry_id, text, activations, positives): zombie, harmful, core or kept.

    ``fragments`` has one text of recent fragments per scope.
    """
    ratio = F.col("positives") / F.greatest(F.lit(1), F.col("activations"))
    j = stats.join(fragments.select("scope_key", F.lower("recent").alias("recent")), "scope_key", "left")
    seen = F.contains(F.coalesce("recent", F.lit("")), F.lower("text"))
    verdict = F.when((F.col("activations") == 0) & ~seen, "zombie").when((F.col("activations") >= 5) & (ratio < 0.3), "harmful").when((F.col("activations") >= 5) & (ratio > 0.7), "core").otherwise("kept")
    return j.select("scope_key", "entry_id", "text", verdict.alias("verdict"))


def recent_fragments(records: DataFrame, n: int) -> DataFrame:
    """Per scope the summaries of the latest ``n`` records, a line each: scope_key, recent."""
    w = Window.partitionBy("scope_key").orderBy(F.col("updated_at").desc(), "created_at", "id")
    r = records.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).withColumn("line", F.when(F.coalesce(T.trim("summary"), F.lit("")) != "", T.trim("summary")).otherwise(T.trim("content")))
    return r.filter("line <> ''").groupBy("scope_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x.line), "\n").alias("recent"))


def rebuilt(documents: DataFrame, fragments: DataFrame, most: int = 800) -> DataFrame:
    """Experience rebuilt without a model: the document's and the fragments' lines, each once (whatever case and blanks), cut to ``most``."""
    j = documents.select("scope_key", "content").join(fragments, "scope_key", "full")
    lines = F.transform(F.split(F.concat_ws("\n", F.coalesce("content", F.lit("")), "recent"), "\r?\n"), T.trim)
    e = j.select("scope_key", F.posexplode(lines).alias("ord", "line")).withColumn("k", T.normalize("line")).filter("k <> ''")
    first = e.groupBy("scope_key", "k").agg(F.min(F.struct("ord", "line")).alias("f"))
    text = first.groupBy("scope_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x.line), "\n").alias("content"))
    return text.select("scope_key", T.clamp_chars("content", most, trim_short=True).alias("content"))


def due(documents: DataFrame, now: Column, key: str, seconds: int) -> DataFrame:
    """Whether a job may run again per scope: fresh if its mark is younger than the interval."""
    mark = F.try_to_timestamp(F.get_json_object("metadata", f"$.{key}"))
    return documents.select("scope_key", F.when(F.unix_timestamp(now) - F.unix_timestamp(mark) < seconds, "fresh").otherwise("due").alias("state"))


def profile_sections(documents: DataFrame) -> DataFrame:
    """Sections of profile documents: scope_key, ord, title, body without line ends at its end; the preamble has ord 0 and no title."""
    parts = F.split(F.concat(F.lit("\n"), F.col("content")), r"\n(?=##\s)")
    e = documents.select("scope_key", F.posexplode(parts).alias("ord", "part"))
    title = F.when(F.col("ord") > 0, T.trim(F.regexp_extract("part", r"^##\s+(.+?)\s*(?:\n|$)", 1)))
    body = F.when(F.col("ord") > 0, F.regexp_replace("part", r"^##[^\n]*\n?", "")).otherwise(F.substring("part", 2, 1 << 30))
    return e.select("scope_key", "ord", title.alias("title"), F.regexp_replace(body, r"\n+$", "").alias("body"))


def profile_merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sections after a merge by title: replaced in place, new ones behind in their order, the rest as they were."""
    e = existing.filter("title is not null").select("scope_key", "title", F.col("ord").alias("e_ord"), F.col("body").alias("e_body"))
    i = incoming.filter("title is not null").groupBy("scope_key", "title").agg(F.max_by("body", "ord").alias("i_body"), F.min("ord").alias("i_ord"))
    j = e.join(i, ["scope_key", "title"], "full")
    w = Window.partitionBy("scope_key").orderBy(F.col("e_ord").asc_nulls_last(), "i_ord")
    return j.select("scope_key", F.row_number().over(w).alias("ord"), "title", F.coalesce("i_body", "e_body").alias("body"))


OPS = "array<struct<op:string,section:string,content:string>>"


def profile_ops(answers: DataFrame) -> DataFrame:
    """The operations that a model's answer (scope_key, text) names: scope_key, ord, op, title, body. The first bracket span is read as
    JSON; what is no operation, or has no section or content, is left out, and an answer that isn't JSON has none."""
    e = answers.select("scope_key", F.posexplode(F.from_json(F.regexp_extract("text", r"(?s)\[.*\]", 0), OPS)).alias("ord", "o"))
    e = e.select("scope_key", "ord", "o.op", T.trim("o.section").alias("title"), T.trim("o.content").alias("body"))
    return e.filter((F.coalesce("title", F.lit("")) != "") & ((F.col("op") == "remove_section") | F.col("op").isin("set_section", "append_to_section") & (F.coalesce("body", F.lit("")) != "")))


def profile_changed(existing: DataFrame, ops: DataFrame) -> DataFrame:
    """Sections (scope_key, ord, title, body) after operations in their order; sections that none names stay as they are.

    An operation bears on its own section only, so each section folds its own: from the last that sets or removes it on.
    """
    e = existing.filter("title is not null").groupBy("scope_key", "title").agg(F.min("ord").alias("e_ord"), F.min_by("body", "ord").alias("e_body"))
    g = ops.groupBy("scope_key", "title").agg(F.array_sort(F.collect_list(F.struct("ord", "op", "body"))).alias("ops"))
    j = e.join(g, ["scope_key", "title"], "full")
    kind = "struct<there:boolean,at:bigint,body:string>"
    start = F.struct(F.col("e_ord").isNotNull().alias("there"), F.coalesce(F.col("e_ord"), F.lit(0)).cast("bigint").alias("at"), F.coalesce("e_body", F.lit("")).alias("body")).cast(kind)
    at = lambda s, o: F.when(s.there, s.at).otherwise(o.ord.cast("bigint") + 1_000_000)
    more = lambda s, o: F.when(s.there, F.regexp_replace(F.concat(F.regexp_replace(s.body, r"\n+$", ""), F.lit("\n"), o.body), r"^\n+", "")).otherwise(o.body)
    step = lambda s, o: F.when(o.op == "remove_section", F.struct(F.lit(False).alias("there"), F.lit(0).cast("bigint").alias("at"), F.lit("").alias("body")).cast(kind)).otherwise(
        F.struct(F.lit(True).alias("there"), at(s, o).alias("at"), F.when(o.op == "set_section", o.body).otherwise(more(s, o)).alias("body")).cast(kind)
    )
    none = F.array().cast("array<struct<ord:int,op:string,body:string>>")
    out = j.withColumn("s", F.aggregate(F.coalesce("ops", none), start, step)).filter("s.there")
    return out.select("scope_key", F.row_number().over(Window.partitionBy("scope_key").orderBy("s.at")).alias("ord"), "title", F.col("s.body").alias("body"))


def profile_text(sections: DataFrame, preambles: DataFrame) -> DataFrame:
    """Profile documents from their sections and preambles (scope_key, body): scope_key, content."""
    part = F.concat(F.lit("## "), "title", F.lit("\n"), F.regexp_replace("body", r"\n+$", ""))
    s = sections.groupBy("scope_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))), lambda x: x.part).alias("parts"))
    j = s.join(preambles.filter(T.trim("body") != "").select("scope_key", T.rtrim("body").alias("head")), "scope_key", "full")
    none = F.array().cast("array<string>")
    return j.select("scope_key", F.concat(F.array_join(F.concat(F.array_compact(F.array("head")), F.coalesce("parts", none)), "\n\n"), F.lit("\n")).alias("content"))
