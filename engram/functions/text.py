"""Text functions of the memory model as column expressions.

Lengths and slices count code points. White space is given explicitly, as Java's ``\\s`` knows ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same as characters to trim.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c) -> Column:
    """White space of any kind off both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def rtrim(c) -> Column:
    return F.rtrim(col(c), F.lit(BLANKS))


def spaced(c) -> Column:
    """Every white-space character as a blank, runs of blanks as one: the pattern meets only what has several."""
    return F.regexp_replace(F.translate(col(c), BLANKS, " " * len(BLANKS)), " {2,}", " ")


def collapse(c) -> Column:
    return trim(spaced(c))


def normalize(c) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return trim(spaced(F.lower(col(c))))


def clamp(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def tokens(c) -> Column:
    """Words of two or more letters or digits; in a word with CJK characters every character is a token."""
    words = F.split(trim(F.regexp_replace(normalize(c), r"[^\p{L}\p{N} ]", " ")), " +")
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(CJK), F.filter(F.split(w, ""), lambda x: x != "")).when(F.length(w) > 1, F.array(w)).otherwise(F.array().cast("array<string>"))))


def unique_tokens(c) -> Column:
    return F.array_distinct(tokens(c))


def overlap(query, candidate) -> Column:
    """Share of the query's distinct tokens that the candidate has; 0 where either has none. Both token arrays."""
    q, c = col(query), col(candidate)
    return F.when((F.size(q) == 0) | (F.size(c) == 0), 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.size(q))


def jaccard(a, b) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def long_words(c) -> Column:
    """Distinct words of three or more letters or digits, CJK not split: the tokens of experience attribution."""
    words = F.split(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}\s]", " "), f"{WS}+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def fnv1a32(c) -> Column:
    """FNV-1a of 32 bits over the UTF-16 units of a text, as a long."""
    hexes = F.hex(F.encode(col(c), "UTF-16BE"))
    n = F.length(hexes) / 4
    units = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.conv(F.substring(hexes, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)) % F.lit(4294967296))


def summarize(c, most: int = 120) -> Column:
    """The text with white space collapsed, cut to ``most``; of a long text the head suffices, unless that is white space for the most part."""
    c = col(c)
    cut = lambda s: F.concat(F.substring(s, 1, most - 3), F.lit("..."))
    head, whole = collapse(F.substring(c, 1, 8 * most)), collapse(c)
    return F.when(F.length(head) > most, cut(head)).when(F.length(c) <= 8 * most, head).otherwise(F.when(F.length(whole) <= most, whole).otherwise(cut(whole)))


def clamp_chars(c, most: int, trim_short: bool = False) -> Column:
    """The head of a text, white space off its end; ``trim_short`` trims texts that fit as well."""
    c = col(c)
    return F.when(F.length(c) <= most, trim(c) if trim_short else c).otherwise(rtrim(F.substring(c, 1, most)))


def estimate_tokens(c) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(col(c)) / 4)).cast("long")


def join_nonblank(separator: str, *columns) -> Column:
    """Columns that are neither null nor empty, joined."""
    return F.array_join(F.filter(F.array(*[col(c) for c in columns]), lambda x: x.isNotNull() & (x != "")), separator)


def search_text(kind="kind", summary="summary", content="content", tags="tags", scope_type="scope_type", scope_id="scope_id") -> Column:
    """What a record is matched by: kind, summary, content, tags and scope, a line each."""
    return join_nonblank("\n", kind, summary, content, F.array_join(col(tags), " "), scope_type, scope_id)


def tags(c) -> Column:
    """Tags in lower case without outer or double blanks, blank ones and repeats dropped."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), normalize), lambda t: t != ""))


def scope_key(scope_type="scope_type", scope_id="scope_id") -> Column:
    return F.lower(F.concat_ws(":", col(scope_type), trim(scope_id)))


def stable_hash36(c) -> Column:
    """The 31-multiplier string hash in 32-bit arithmetic, its absolute value in base 36."""
    hexes = F.hex(F.encode(col(c), "UTF-16BE"))
    n = (F.length(hexes) / 4).cast("int")
    units = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(hexes, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, u: (a * 31 + u) % F.lit(4294967296))
    return F.lower(F.conv(F.when(h >= 2147483648, 4294967296 - h).otherwise(h).cast("string"), 10, 36))


def message_hash(role, content) -> Column:
    """The first 16 hex digits of the SHA-256 of role, NUL and content."""
    return F.substring(F.sha2(F.concat(col(role), F.lit("\0"), col(content)), 256), 1, 16)


#: Blocks that hosts inject into captured text, taken out in this order.
INJECTED = [
    r"(?is)<system-reminder.*?</system-reminder>",
    r"(?is)<system-reminder[^>]*>(?!.*</system-reminder>).*",
    *[rf"(?is)<{t}>.*?</{t}>" for t in ("additional_data", "connector-status", "memory_and_skills_reminder", "identity_context", "project_context", "product_identity", "tone_and_style", "user_info")],
    r"(?is)<image[^>]*>.*?</image>",
    r"(?is)<image_local_path>.*?</image_local_path>",
]


def sanitize(c) -> Column:
    """What a person wrote of a captured message; empty where nothing of that is left."""
    c = F.coalesce(col(c), F.lit(""))
    body = F.regexp_extract(c, r"(?is)<user_query>(.*?)</user_query>", 1)
    out = F.when(trim(body) != "", body).otherwise(c)
    for pattern in INJECTED:
        out = F.regexp_replace(out, pattern, " ")
    out = trim(out)
    scaffold = out.rlike(r"(?i)^(#|##)\s*(SOUL\.md|IDENTITY\.md|USER\.md)") | F.substring(out, 1, 60).rlike(r"(?i)<(hook|user-context|memory(?![A-Za-z0-9_]))")
    return F.when(scaffold, "").otherwise(out)


def substantive(c) -> Column:
    """At least six characters besides punctuation."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), WS, ""), "[.,，。·…!！?？;；:：\\-—_#*`\"'“”‘’()（）\\[\\]【】]", "")) >= 6


#: Fixed value: openings by which a following sentence counts as a question.
QUESTION = r"(?i)^(?:(?:what|which|when|where|why|how|should|can|could|would|will|do|does|did|is|are|am|what's|what is)(?![A-Za-z0-9_])|(?:有没有|是否|要不要|该|应该|怎么|如何|什么|哪|能不能|可不可以)(?=[A-Za-z0-9_]))"


def first_statement(c) -> Column:
    """The text, or its first sentence where what follows is a question."""
    t = trim(F.coalesce(col(c), F.lit("")))
    sentences = F.filter(F.transform(F.split(t, f"(?<=[.!?。！？]){WS}+"), trim), lambda s: s != "")
    rest = F.array_join(F.slice(sentences, 2, F.greatest(F.size(sentences), F.lit(1))), " ")
    asks = rest.rlike("[?？]") | F.coalesce(F.get(sentences, F.lit(1)), F.lit("")).rlike(QUESTION)
    return F.when((F.size(sentences) < 2) | ~asks, t).otherwise(F.get(sentences, F.lit(0)))


#: Fixed value: words that mark a change of state; ASCII word borders.
TEMPORAL = r"(?i)(?:(?<![A-Za-z0-9_])(?:now|currently|changed to|switched to|no longer|instead)(?![A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?:现在|改成|不再|换成|更换|已经|已改)(?=[A-Za-z0-9_]))"


def json_array_text(c) -> Column:
    """The JSON array in a model's answer: a fenced block, else the outermost brackets, else the whole."""
    c = col(c)
    fence = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    span = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.when(F.contains(c, F.lit("```")) & (fence != ""), trim(fence)).when(span != "", span).otherwise(trim(c))
