"""Consolidation: summaries of clusters and runs, level digests, skeletons of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import auto_summary

#: Lines of a text that say what was decided, touched, used, noticed, and comes next.
SECTIONS = {
    "decisions": r"(?i)\b(decided|chose|agreed|will use|decision)\b",
    "files": r"(?i)\b[\w./-]+\.(ts|js|tsx|jsx|py|md|json|yml|yaml|sql|sh|css|html)\b",
    "tools": r"(?i)\b(git|npm|bun|tsc|pytest|make|pip|python|node)\b",
    "patterns": r"(?i)\b(always|never|pattern|convention|rule)\b",
    "next": r"(?i)\b(todo|next|follow.?up|remaining)\b",
}


def _lines(text: Column, pattern: str, most: int) -> Column:
    hit = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))
    return F.slice(F.array_distinct(F.transform(hit, lambda x: F.substring(F.trim(F.regexp_replace(x, r"^[-*#\s]+", "")), 1, 160))), 1, most)


def structured_summary(rows: DataFrame, id_: str, text: str, most: int = 5) -> DataFrame:
    """(id, one array per section): the first distinct lines that belong there; a summary has at most so many by design."""
    return rows.select(F.col(id_).alias("id"), *[_lines(F.coalesce(text, F.lit("")), p, most).alias(n) for n, p in SECTIONS.items()])


#: What lines of a cluster's contents are about, and the names of files and tools in them.
DECIDES = "(?i)" + "|".join([
    r"decides?:?\s*",
    r"chose\s+\w+",
    r"agreed\s+(to|that)",
    r"settled\s+on",
    r"opted\s+(for|in)",
    r"will\s+use",
    r"using\s+\w+\s+for",
])
COMES_NEXT = "(?i)" + "|".join([
    r"^[-*]\s*(next|todo|will|should|need to|plan to)",
    r"next\s+step",
    r"pending",
    r"^#+\s*(next|todo|tasks?)",
])
TEACHES = "(?i)" + "|".join([
    r"learned:?\s*",
    r"pattern:?\s*",
    r"convention:?\s*",
    r"architecture",
    r"design\s+decision",
])
FILE_NAME = r"(?i)\b[\w-]+\.(?:ts|js|tsx|jsx|py|md|json|yml|yaml|sql|sh)\b"
TOOL_NAME = r"(?i)\b(?:memory_\w+|journal_\w+|bash|git|npm|bun|tsc|test)\b"


def cluster_summary(rows: DataFrame, by: str, id_: str, text: str, most: int = 10) -> DataFrame:
    """(by, section, item, rank): what the lines of each cluster decide, teach and leave to do, and the files, tools and headings in them.

    Each item once, in the order of rows and lines, so many of each section by design.
    """
    from ..functions.text import ascii_words

    lines = rows.select(by, F.col(id_).alias("id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    clean = F.substring(F.regexp_replace("line", r"^[-*#\s]+", ""), 1, 120)
    one = lambda name, pattern, least: F.when(F.col("line").rlike(pattern) & (F.length(clean) > least), F.array(F.struct(F.lit(name).alias("section"), clean.alias("item"))))
    named = lambda name, pattern: F.transform(F.regexp_extract_all("line", F.lit(ascii_words(pattern)), F.lit(0)), lambda x: F.struct(F.lit(name).alias("section"), x.alias("item")))
    heading = F.substring(F.regexp_extract("line", r"^#+\s+(.+)", 1), 1, 80)
    topic = F.when((heading != "") & ~F.lower(heading).contains("summary"), F.array(F.struct(F.lit("topics").alias("section"), heading.alias("item"))))
    none = F.array().cast("array<struct<section:string,item:string>>")
    every = F.concat(*[F.coalesce(x, none) for x in (one("decisions", DECIDES, 20), one("next", COMES_NEXT, 10), one("patterns", TEACHES, 10), named("files", FILE_NAME), named("tools", TOOL_NAME), topic)])
    found = lines.select(by, "id", "at", F.posexplode(every).alias("k", "x")).select(by, "id", "at", "k", "x.*")
    first = found.groupBy(by, "section", "item").agg(F.min(F.struct("id", "at", "k")).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(by, "section").orderBy("_first"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).select(by, "section", "item", "rank")


def _best_of(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The most important rows of each group; Spark cuts each task's share before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importance"), "id"))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= most)


def compress_clusters(members: DataFrame, nodes: DataFrame, most: int = 50) -> DataFrame:
    """members(id, cluster) -> (cluster, level, importance, size, content): one node for each cluster of two or more.

    It stands a level higher and is 0.9 times as important as its best member; its content is a line for
    each of the best members, fifty by default: a summary by design.
    """
    both = members.join(nodes, "id")
    made = both.groupBy("cluster").agg(F.max("level").alias("top"), F.max("importance").alias("best"), F.count("*").alias("size"))
    line = F.concat(F.lit("- "), F.coalesce(auto_summary(F.col("content")), F.substring("content", 1, 220)))
    text = _best_of(both, "cluster", most).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("_r", line.alias("line")))).alias("l"))
    text = text.select("cluster", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))
    return made.filter("size > 1").join(text, "cluster").select("cluster", (F.col("top") + 1).alias("level"), (F.col("best") * 0.9).alias("importance"), "size", "content")


def by_day(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(day, nodes, labels): what each day brought, its most important labels first."""
    days = nodes.withColumn("day", F.to_date(F.timestamp_millis("created_ms")))
    n = days.groupBy("day").agg(F.count("*").alias("nodes"))
    best = _best_of(days, "day", most).groupBy("day").agg(F.sort_array(F.collect_list(F.struct("_r", "label"))).alias("l"))
    return n.join(best, "day").select("day", "nodes", F.array_join(F.transform("l", lambda x: x["label"]), ", ").alias("labels"))


def by_theme(nodes: DataFrame) -> DataFrame:
    """(theme, nodes, importance): counts and mean importance of each type."""
    return nodes.groupBy(F.coalesce("type", F.lit("untyped")).alias("theme")).agg(F.count("*").alias("nodes"), F.avg("importance").alias("importance"))


def trend(nodes: DataFrame) -> DataFrame:
    """(month, nodes, importance) in order of months."""
    month = F.date_format(F.timestamp_millis("created_ms"), "yyyy-MM")
    return nodes.groupBy(month.alias("month")).agg(F.count("*").alias("nodes"), F.avg("importance").alias("importance"))


#: Lines of source that say what a file has.
SIGNATURE = r"^\s*(export |default |async |public |private |protected |static |abstract |final |pub )*(function|class|interface|type|enum|def|fn|struct|impl|trait|func|const \w+\s*=\s*(async\s*)?\()"
IMPORT = r"^\s*(import |from \S+ import|use |#include|require\(|package )"


def skeleton(files: DataFrame, path: str, text: str) -> DataFrame:
    """(path, skeleton): distinct imports and the signatures of each file."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    imports = F.array_distinct(F.filter(lines, lambda x: x.rlike(IMPORT)))
    heads = F.transform(F.filter(lines, lambda x: x.rlike(SIGNATURE)), lambda x: F.regexp_replace(x, r"\s*[{:]\s*$", ""))
    return files.select(F.col(path).alias("path"), F.array_join(F.concat(imports, heads), "\n").alias("skeleton"))
