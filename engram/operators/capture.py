"""What a turn is worth remembering: proposals by rules, coding conventions, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as T
from engram.operators import storage

#: Cues of the rules.
REMEMBER = r"(?i)^(remember(?: that| this)?|please remember|记住|记一下|请记住)\s*[:,\-]?\s*"
PREFERENCE = r"(?i)(i prefer|i like|please reply|use chinese|use english|我更喜欢|请用|以后用|不要用)"
DECISION = r"(?i)(we decided|let'?s use|we will use|改用|我们决定|我们以后用)"
IDENTITY = r"(?i)^(?:(?:你好|您好|hi|hello|hey)[,，!！\s]*)?(?:我是|我的名字是|my name is|i am(?![A-Za-z0-9_]))"
ACTION = r"我是(?:通过|用|在|正在|从|去|想|要|来|靠|按|按照|先|刚|因为|为了|觉得|认为)|(?i:(?<![A-Za-z0-9_])i am (?:going to|trying to|using|working|living|staying|accessing)(?![A-Za-z0-9_]))"
QUOTED = "(?i)[\"“']我是[\"”']|[\"“']i am[\"”']"
CODING = [
    (r"(?i)(this repo uses|we use|our repo|项目使用|这个仓库用)", "repo_convention", ["repo", "convention"]),
    (r"(?i)(run tests|build with|deploy using|package manager|测试用|构建用|部署用)", "workflow_rule", ["workflow"]),
    (r"(?i)(do not edit|don't edit|never modify|不要编辑|不要修改|禁止)", "repo_convention", ["repo", "rule"]),
    (r"(?i)(prefer|always use|we follow|style guide|代码风格|始终使用|遵循)", "repo_convention", ["repo", "style"]),
    (r"(?i)(non-interactive|no prompt|自动|无交互)", "workflow_rule", ["workflow", "automation"]),
]


def _proposal(cond: Column, kind: str, content: Column, confidence: float, importance: float, source: str, tags: list[str]) -> Column:
    made = F.struct(F.lit(kind).alias("kind"), content.alias("content"), F.lit(confidence).alias("confidence"), F.lit(importance).alias("importance"), F.lit(source).alias("source"), F.array(*map(F.lit, tags)).alias("tags"))
    return F.when(cond, made)


def proposals(turns: DataFrame, text_col: str = "user_message", floor: bool = True) -> DataFrame:
    """Proposed records of each turn (turn_id): explicit requests, preferences, decisions, identities; without repeats and, unless ``floor`` is off, empty shells."""
    text = T.trim(F.regexp_replace(F.regexp_replace(F.coalesce(T.col(text_col), F.lit("")), r"@image#?\d*:\S+", " "), f"{T.WS}+", " "))
    t = turns.select("turn_id", text.alias("t"))
    rest = T.trim(F.regexp_replace("t", REMEMBER, ""))
    t = t.withColumn("asked", F.when((rest != "") & (rest != F.col("t")), T.first_statement(rest)).otherwise("")).withColumn("plain", T.first_statement("t"))
    asked, plain, c = F.col("asked"), F.col("plain"), F.col("t")
    question = c.rlike("[？?]") | c.rlike(r"[吗呢吧呀]\s*$")
    made = F.array_compact(F.array(
        _proposal(asked != "", "fact", asked, 0.92, 0.85, "explicit_remember", ["explicit", "remember"]),
        _proposal(c.rlike(PREFERENCE), "preference", F.when((asked != "") & asked.rlike(PREFERENCE), asked).otherwise(plain), 0.82, 0.8, "turn_inference", ["preference"]),
        _proposal(c.rlike(DECISION), "decision", plain, 0.78, 0.78, "turn_inference", ["decision"]),
        _proposal(c.rlike(IDENTITY) & ~c.rlike(ACTION) & ~question & ~c.rlike(QUOTED) & (F.length(c) <= 100), "identity", plain, 0.76, 0.75, "turn_inference", ["identity"]),
    ))
    real = t.select("turn_id", (F.filter(made, lambda p: T.substantive(p["content"])) if floor else made).alias("made"))
    keys = F.transform("made", lambda p: F.struct(p["kind"], F.lower(T.trim(p["content"]))))
    first = F.filter("made", lambda p, i: F.array_position(keys, F.struct(p["kind"], F.lower(T.trim(p["content"])))) == i + 1)
    return real.select("turn_id", F.posexplode(first).alias("ord", "p")).select("turn_id", "ord", "p.*")


def coding_proposals(turns: DataFrame, text_col: str = "user_message") -> DataFrame:
    """The first coding rule that a message matches: turn_id, kind, summary, tags."""
    t = T.trim(text_col)
    hit = F.when(F.lit(False), F.lit(None).cast("struct<kind:string,tags:array<string>>"))
    for pattern, kind, tags in CODING:
        hit = hit.when(t.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.array(F.lit("coding"), *map(F.lit, tags)).alias("tags")))
    short = F.when(F.length(t) <= 120, t).otherwise(F.concat(F.substring(t, 1, 117), F.lit("...")))
    return turns.select("turn_id", short.alias("summary"), hit.alias("h")).filter(F.col("h").isNotNull()).select("turn_id", "h.kind", "summary", "h.tags")


def stop_gate(sessions: DataFrame, least: int = 15) -> DataFrame:
    """Whether a session may stop: blocked where nothing was written of a conversation worth it.

    A session has stop_active, last_user, driven, agent_writes.
    """
    said = F.coalesce(T.trim("last_user"), F.lit(""))
    allow = F.col("stop_active") | said.rlike("[?？]$") | F.col("driven") | (F.length(said) < least) | (F.col("agent_writes") > 0)
    return sessions.select("session_id", F.when(allow, "allow").otherwise("block").alias("decision"))


# -- entities

#: Names known without a vocabulary.
TECH = ["typescript", "javascript", "python", "rust", "go", "java", "kotlin", "swift", "react", "vue", "angular", "svelte", "next.js", "nextjs", "nuxt", "vite", "node.js", "nodejs", "deno", "bun", "postgresql", "mysql", "sqlite", "mongodb", "redis", "qdrant", "docker", "kubernetes", "terraform", "graphql", "rest", "grpc", "websocket", "tailwindcss", "css", "html", "supabase", "firebase", "aws", "gcp", "azure", "openai", "gemini", "claude", "anthropic", "langchain", "crewai", "vercel"]
TOOLS = ["pnpm", "npm", "yarn", "bun", "cargo", "pip", "poetry", "git", "github", "gitlab", "bitbucket", "vim", "neovim", "vscode", "cursor", "zed", "eslint", "prettier", "biome", "vitest", "jest", "docker", "make", "cmake"]
GENERIC_MENTIONS = ["media", "rest", "www", "http", "https", "com", "cn", "org", "net", "localhost"]


def entities(records: DataFrame, vocabulary: list[tuple[str, str]] = (), strict: bool = False, text_col: str = "content", whole_words: bool = False) -> DataFrame:
    """Entities of each record (id): name, name_key, kind, prio; the first rule that finds a name gives its kind.

    Rules: vocabulary, known technologies, known tools, @mentions (domains are organisations), quoted names, joined capitalised
    words; the last two not with ``strict``. Dictionary names match as substrings unless ``whole_words``.
    """
    records = records.select("id", text_col, F.lower(F.col(text_col)).alias("low_text"))  # once a row, as it is asked for each name
    low = F.col("low_text")
    border = "" if not whole_words else r"(?<![a-z0-9])"
    has = lambda name: F.contains(low, F.lit(name.lower())) if not whole_words else low.rlike(border + "\\Q" + name.lower() + "\\E(?![a-z0-9])")
    one = lambda name, kind, prio: F.struct(name.alias("name"), F.lower(name).alias("name_key"), kind.alias("kind"), F.lit(prio).alias("prio"))
    known = [(n, k, 0) for n, k in sorted(vocabulary, key=lambda x: -len(x[0]))] + [(n, "tech", 1) for n in TECH] + [(n, "tool", 2) for n in TOOLS]
    parts = [F.array_compact(F.array(*[F.when(has(n), one(F.lit(n), F.lit(k), p)) for n, k, p in known]))]
    every = lambda pattern, sign: F.when(sign, F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))  # noqa: E731  (most texts lack the sign, and aren't searched)
    mentions = F.transform(every(r"@([A-Za-z0-9_][A-Za-z0-9_.-]*[A-Za-z0-9_]|[A-Za-z0-9_])", F.contains(F.col(text_col), F.lit("@"))), lambda m: one(m, F.when(m.rlike(r"(?i)^[a-z0-9-]+(\.[a-z]{2,})+$"), "org").otherwise("person"), 3))
    parts.append(F.filter(mentions, lambda m: ~m["name"].rlike(r"^\d+(\.\d+)*$") & ~m["name_key"].isin(*GENERIC_MENTIONS) & ~m["name_key"].isin(*TECH, *TOOLS)))
    if not strict:
        quoted = F.transform(every('"([^"]+?)"', F.contains(F.col(text_col), F.lit('"'))), lambda q: one(T.trim(q), F.lit("project"), 4))
        parts.append(F.filter(quoted, lambda q: F.length(q["name"]).between(2, 40) & ~q["name"].rlike(r"^\d+(\.\d+)*$")))
        pascal = F.transform(every(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", F.rlike(F.col(text_col), F.lit("[a-z][A-Z]"))), lambda p: one(p, F.lit("tech"), 5))
        parts.append(F.filter(pascal, lambda p: ~p["name_key"].isin(*TECH)))
    found = records.select("id", F.concat(*parts).alias("found"))
    keys = F.transform("found", lambda e: e["name_key"])
    first = F.filter("found", lambda e, i: F.array_position(keys, e["name_key"]) == i + 1)
    return found.select("id", F.posexplode(first).alias("ord", "e")).select("id", "ord", "e.*")


def entity_table(found: DataFrame) -> DataFrame:
    """Entities of a corpus: name_key, name and kind by the first rule, number of linked records."""
    return found.groupBy("name_key").agg(F.min_by("name", F.struct("prio", "name")).alias("name"), F.min_by("kind", F.struct("prio", "name")).alias("kind"), F.count_distinct("id").alias("links"))


def co_occurrences(found: DataFrame) -> DataFrame:
    """Pairs of entities within a record, in order of the names: source, target, n records. Pairs are within one record's own entities."""
    a = found.select("id", F.col("name_key").alias("source"))
    b = found.select("id", F.col("name_key").alias("target"))
    return a.join(b, "id").filter("source < target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def node_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (name_key)."""
    keys = nodes.select("name_key").distinct()
    return edges.join(keys.select(F.col("name_key").alias("source")), "source", "left_semi").join(keys.select(F.col("name_key").alias("target")), "target", "left_semi")


def refreshed_links(links: DataFrame, changed: DataFrame, vocabulary: list[tuple[str, str]] = (), strict: bool = True) -> DataFrame:
    """Links (id, name_key, kind, ...) after the records ``changed`` (id, content) were written: theirs are found anew, all others stay."""
    kept = links.join(changed.select("id"), "id", "left_anti")
    return kept.unionByName(entities(changed, vocabulary, strict).select(*[c for c in links.columns]), allowMissingColumns=False)


def forgotten(links: DataFrame, relations: DataFrame, vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, relations (memory_id: the record that they come from) and vectors without those of forgotten records."""
    gone = ids.select("id").distinct()
    return (
        links.join(gone, "id", "left_anti"), relations.join(gone.select(F.col("id").alias("memory_id")), "memory_id", "left_anti"), vectors.join(gone, "id", "left_anti"),
    )


def upserted_entities(table: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Entities (name_key, name, aliases, kind, created_at, updated_at) after upserts (ord, name, aliases, kind): a known key or alias takes the
    aliases and, where one is given, the kind; its name stays. Changes of one batch are applied by ord; a new key is made once."""
    keys = table.select(F.explode(F.array_union(F.array("name_key"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))).alias("k"), F.col("name_key").alias("known")).groupBy("k").agg(F.min("known").alias("known"))
    c = changes.withColumn("k", F.lower(T.trim("name"))).filter("k <> ''").join(keys, "k", "left").withColumn("name_key", F.coalesce("known", "k"))
    g = c.groupBy("name_key").agg(F.min_by(T.trim("name"), "ord").alias("c_name"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("ord"))).alias("c_kind"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("aliases", F.array().cast("array<string>")).alias("a")))), lambda x: x.a))).alias("c_aliases"))
    j = table.join(g, "name_key", "full")
    none = F.array().cast("array<string>")
    return j.select(
        "name_key", F.coalesce("name", "c_name").alias("name"), F.array_union(F.coalesce("aliases", none), F.coalesce("c_aliases", none)).alias("aliases"), F.coalesce("c_kind", "kind").alias("kind"),
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("c_aliases").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of chosen entities with direction and the other end: two equi-joins."""
    out = edges.join(nodes.select(F.col("name_key").alias("source")), "source").select(F.col("source").alias("entity"), F.lit("out").alias("direction"), F.col("target").alias("other"), "n")
    into = edges.join(nodes.select(F.col("name_key").alias("target")), "target").select(F.col("target").alias("entity"), F.lit("in").alias("direction"), F.col("source").alias("other"), "n")
    return out.unionAll(into)


def newest_relations(relations: DataFrame, n: int = 4) -> DataFrame:
    w = Window.partitionBy("entity").orderBy(F.col("n").desc(), "other", "direction")
    return relations.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


#: Letters of the grams by which a part of a name meets the names that contain it.
GRAM = 3


def resolve_names(names: DataFrame, table: DataFrame, n: int = 8) -> DataFrame:
    """Entities of ``table`` (name_key, aliases if it has them) that a name (query_id, name) means: an equal key or alias first, then keys that contain it.

    Names meet keys on their first ``GRAM`` letters, so both sides are shuffled and neither is sent to all tasks.
    """
    asked = names.select("query_id", F.lower(T.trim("name")).alias("part")).filter("part <> ''")
    keys = table.select("name_key", F.col("name_key").alias("part"))
    if "aliases" in table.columns:
        keys = keys.unionByName(table.select("name_key", F.explode("aliases").alias("part")).withColumn("part", F.lower(T.trim("part"))))
    exact = asked.join(keys.distinct(), "part").select("query_id", "name_key", F.lit(0).alias("how"))
    size = F.length("name_key")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda g: F.transform(F.sequence(F.lit(1), F.greatest(size - g + 1, F.lit(1))), lambda i: F.substr("name_key", i, g)))))
    cut = table.select("name_key").distinct().select("name_key", F.explode(grams).alias("gram"))
    inner = asked.withColumn("gram", F.substring("part", 1, GRAM)).join(cut, "gram").filter(F.contains("name_key", F.col("part"))).select("query_id", "name_key", F.lit(1).alias("how"))
    w = Window.partitionBy("query_id").orderBy("how", "name_key")
    both = exact.unionAll(inner).groupBy("query_id", "name_key").agg(F.min("how").alias("how"))
    return both.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")


def asked_links(resolved: DataFrame, found: DataFrame, k: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """What names are worth to queries, 1 / (1 + links / k): (query_id, name_key, b), and which of the names asked for each record has: (id, names).

    Both are written. A name in very many records makes no large group: links are dealt by record.
    """
    asked = storage.written(resolved.select("query_id", "name_key").distinct(), "asked")
    held = found.select("id", "name_key").join(asked.select("name_key").distinct(), "name_key", "left_semi")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = storage.written(held.repartition(parts, "id").groupBy("id").agg(F.collect_set("name_key").alias("names")), "links")
    worth = links.select(F.explode("names").alias("name_key")).groupBy("name_key").agg((1 / (1 + F.count(F.lit(1)) / k)).alias("b"))
    return storage.written(asked.join(worth, "name_key").select("query_id", "name_key", "b"), "worth"), links


def entity_boosts(resolved: DataFrame, found: DataFrame, k: float = 40.0) -> DataFrame:
    """(query_id, id, entity): each matched entity gives its records 1 / (1 + links / k), at most 1 in all.

    Queries that mean the same entities are one row, which meets a record at the first entity that both have, so pairs are made once and nothing gathers them.
    """
    worth, links = asked_links(resolved, found, k)
    same = worth.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("name_key", "b"))).alias("named")).groupBy("named").agg(F.collect_list("query_id").alias("queries"))
    by_name = storage.written(same.select(F.explode("named.name_key").alias("name_key"), "named", "queries"), "named")
    both = links.select("id", "names", F.explode("names").alias("name_key")).join(by_name, "name_key").withColumn("met", F.filter("named", lambda x: F.array_contains("names", x["name_key"])))
    once = both.filter(F.col("met")[0]["name_key"] == F.col("name_key")).select("queries", "id", F.aggregate("met", F.lit(0.0), lambda a, x: a + x["b"]).alias("b"))
    return once.select(F.explode("queries").alias("query_id"), "id", F.least("b", F.lit(1.0)).alias("entity"))
