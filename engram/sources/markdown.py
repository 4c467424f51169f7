"""Markdown memory files: entries in, budgeted lists out.

A file is read as a table of its lines. Each line gets a class from its own text; what a line's place in the file means
(front matter, fenced code, the lead-in that stands before it, the entry that it continues) follows from windows over the
lines before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import text as T

#: The patterns of a line's class.
DIVIDER = r"^(-{3,}|\*{3,}|_{3,})$"
TITLE, HEADING = f"^#{T.WS}", f"^#{{2,6}}{T.WS}+"
ITEM = f"^(?:[-*+]|[0-9]+\\.){T.WS}+"
LEAD_INS = [r"^(\*\*|__)[^*_]+(\*\*|__)[：:]?$", r"^[^#*`\n]{1,24}[：:]$"]


def _classed(files: DataFrame) -> DataFrame:
    """The lines of files (path, text): path, n, line (trimmed), indent, item (the text of a list item), cls."""
    lines = files.select("path", F.posexplode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), "\n")).alias("n", "raw"))
    lines = lines.withColumn("line", T.trim("raw")).withColumn("indent", F.length("raw") - F.length(F.ltrim(F.col("raw"), F.lit(T.BLANKS))))
    c, item = F.col("line"), T.trim(F.regexp_replace("line", ITEM, ""))
    is_item = c.rlike(ITEM)
    cls = (
        F.when(c == "", "blank").when(F.startswith(c, F.lit("```")), "fence").when(c.rlike(TITLE), "title").when(c.rlike(HEADING), "lead").when(c.rlike(DIVIDER), "divider")
        .when(is_item & ((item == "") | item.rlike(DIVIDER)), "empty item").when(is_item, "item").when(c.rlike(LEAD_INS[0]) | c.rlike(LEAD_INS[1]), "lead").otherwise("prose")
    )
    return lines.select("path", "n", "line", "indent", item.alias("item"), cls.alias("cls"))


def _live(lines: DataFrame) -> DataFrame:
    """Lines outside front matter and fenced code; blank lines count everywhere.

    Until a file's first content, lines ``---`` open and close front matter in turn; fences open and close code in turn.
    """
    file = Window.partitionBy("path")
    upto = file.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    odd = lambda flag: F.sum(flag.cast("int")).over(upto) % 2 == 1
    dash, fence = F.col("line") == "---", F.col("cls") == "fence"
    x = lines.withColumn("matter", odd(dash) | dash).withColumn("code", odd(fence & ~F.col("matter")) | fence)
    content = F.col("cls").isin("item", "prose") & ~F.col("matter") & ~F.col("code")
    x = x.withColumn("first", F.min(F.when(content, F.col("n"))).over(file))
    x = x.withColumn("matter", F.col("matter") & F.coalesce(F.col("n") < F.col("first"), F.lit(True))).withColumn("code", odd(fence & ~F.col("matter")) | fence)
    return x.filter((F.col("cls") == "blank") | ~F.col("matter") & ~F.col("code") & ~F.col("cls").isin("title", "divider")).select("path", "n", "line", "indent", "item", "cls")


def entries(files: DataFrame) -> DataFrame:
    """Entries of markdown memory files (path, text): path, ord, entry.

    An entry is a list item with the deeper items below it, or a paragraph. Front matter, fenced code, titles and dividers are left out. A
    lead-in (a heading, a bold line, a short line that ends in a colon) stands before each entry that follows it up to
    a blank line or the end of a paragraph. A null text has no entries.
    """
    x = _live(_classed(files))
    order = Window.partitionBy("path").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda cond, value="n": F.max(F.when(cond, F.col(value))).over(before)
    is_lead, is_item, is_prose = (F.col("cls") == c for c in ("lead", "item", "prose"))
    ends = (F.col("cls") == "blank") | is_lead  # of a group of items
    x = x.withColumn("section", F.sum(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("shallowest", F.min(F.when(is_item, F.col("indent"))).over(Window.partitionBy("path", "section").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)))
    nested = is_item & (F.col("indent") > F.col("shallowest"))
    starts = is_prose & F.coalesce(F.lag("cls").over(order) != "prose", F.lit(True)) | is_item & ~F.coalesce(nested, F.lit(False))
    x = x.withColumn("starts", starts).withColumn("lead_at", last(is_lead)).withColumn("cleared_at", last((F.col("cls") == "blank") | is_prose))
    lead = F.max_by(F.when(F.col("cls") == "lead", T.trim(F.regexp_replace("line", HEADING, ""))), F.when(F.col("cls") == "lead", F.col("n"))).over(before)
    x = x.withColumn("lead", F.when(F.col("lead_at") > F.coalesce("cleared_at", F.lit(-1)), lead))
    x = x.withColumn("head", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(is_item | is_prose)
    part = F.when(F.col("starts") & is_item, F.col("item")).otherwise(F.col("line"))
    made = x.groupBy("path", "head").agg(F.max(F.when(F.col("starts"), F.col("lead"))).alias("lead"), F.array_sort(F.collect_list(F.struct("n", part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p.part), " ")
    return made.select("path", (F.col("head") - 1).cast("int").alias("ord"), F.concat_ws(" ", F.when(F.col("lead") != "", F.col("lead")), text).alias("entry"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The markdown files of a folder, whatever case their extension has: path, text. A folder without any, or none at all, has no rows."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[mM][dD]").load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, text string")
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def import_entries(found: DataFrame, stored: DataFrame, kind: Column, scope_key: str) -> DataFrame:
    """Entries whose text no stored record of the scope has as content or summary, each once."""
    known = stored.filter(F.col("scope_key") == scope_key).select(F.explode(F.array(T.trim("content"), T.trim("summary"))).alias("entry")).distinct()
    first = found.groupBy(T.trim("entry").alias("entry")).agg(F.min(F.struct("path", "ord")).alias("at")).select("entry", "at.*")
    return first.join(known, "entry", "left_anti").select("path", "ord", "entry", kind.alias("kind"))


def budgeted_list(items: DataFrame, most: int, key: str = "target") -> DataFrame:
    """Per target a list of the newest items (ord descending) that fit ``most`` characters, oldest first: target, n, text.

    Always one item, cut if it alone is too long; the first that doesn't fit ends the list.
    """
    line = F.concat(F.lit("- "), T.trim("item"))
    w = Window.partitionBy(key).orderBy(F.col("ord").desc())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = items.filter(T.trim("item") != "").withColumn("line", line).withColumn("rn", F.row_number().over(w)).withColumn("used", F.sum(F.length("line") + 1).over(run) - 1)
    fits = F.when(F.col("rn") == 1, True).otherwise(F.col("used") <= most)
    x = x.withColumn("over", F.max((~fits | ((F.col("rn") > 1) & (F.first(F.length("line")).over(w) > most))).cast("int")).over(run)).filter("over = 0").withColumn("line", F.when((F.col("rn") == 1) & (F.length("line") > most), T.rtrim(F.substring("line", 1, most))).otherwise(F.col("line")))
    return x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("o"), "line"))), lambda y: y.line), "\n").alias("text"))


def fingerprint(files: DataFrame, key: str = "target", digits: int = 3) -> DataFrame:
    """A SHA-256 over the files (path, text) of each target, whatever their order, in two levels so that no row holds more than digests.

    Each file is hashed in its own row; the digests of paths whose hashes begin alike (``digits`` hexadecimal digits) are hashed in the order
    of paths, and then those digests in order. More digits make smaller groups.
    """
    one = F.sha2(F.concat(F.col("path"), F.lit("\0"), F.coalesce("text", F.lit("")), F.lit("\0")), 256)
    hashed = files.select(key, F.substring(F.sha2("path", 256), 1, digits).alias("range"), "path", one.alias("digest"))
    joined = lambda column: F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x.digest), "")
    ranges = hashed.groupBy(key, "range").agg(F.sha2(joined(F.struct("path", "digest")), 256).alias("digest"))
    return ranges.groupBy(key).agg(F.sha2(joined(F.struct("range", "digest")), 256).alias("fingerprint"))
