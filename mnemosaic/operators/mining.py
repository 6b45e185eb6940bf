"""Text mining: intents, facts, patterns, lessons, rules, line runs, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import js_round

#: Intents in order, each with patterns and their weights.
INTENTS = (
    ("debug", ((r"\b(debug\w*|bug|fix\w*|error\w*|fail\w*|broken|crash\w*|traceback|exception\w*|regression\w*|404|500|not working|doesn'?t work|root.?cause)\b", 2), (r"\bdiagnos\w*\b", 1))),
    ("implement", ((r"\b(implement\w*|build\w*|creat\w*|add(?:s|ed|ing)?|writ\w*|cod\w*|port\w*|refactor\w*|integrat\w*|wire|module\w*|feature\w*)\b", 2), (r"\b(commit\w*|branch\w*|merg\w*|push\w*|publish\w*|releas\w*|deploy\w*|upgrad\w*|install\w*)\b", 1))),
    ("understand", ((r"\b(understand\w*|expla\w*|how does|why (?:is|does|do|are)|figure (?:out|it)|grasp\w*|concept\w*)\b", 2), (r"\b(inspect\w*|analys\w*|analyz\w*|investigat\w*|review\w*|reading|look(?:ing)? (?:at|into))\b", 1))),
    ("plan", ((r"\b(plan\w*|design\w*|architect\w*|roadmap\w*|organiz\w*|prepar\w*|scaffold\w*|blueprint\w*|strateg\w*|steps for)\b", 2),)),
    ("verify", ((r"\b(verif\w*|test\w*|confirm\w*|validat\w*|assert\w*|sanity|smoke\w*|qa)\b", 2), (r"\b(check\w*|lint\w*|typecheck\w*|tsc|benchmark\w*|coverage|reproduc\w*)\b", 1))),
    ("research", ((r"\b(search\w*|find(?:ing)? out|research\w*|fetch\w*|look(?:ing)? up)\b", 2), (r"\b(docs?|documentation|official|reference|paper\w*|specs?|upstream|google|stackoverflow)\b", 1))),
    ("decide", ((r"\b(decid\w*|choos\w*|option\w*|trade-?offs?|alternatives?|weigh\w*|prefer\w*)\b", 2), (r"\b(compar\w*|which (?:one|should|approach)|between)\b", 1))),
    ("reflect", ((r"\b(summar\w*|retro\w*|distill\w*|consolidat\w*|changelog\w*|journall?ing)\b", 2), (r"\b(stor\w+|record\w+|archiv\w+|captur\w+)\b[^.\n]*\b(memory|hub|journal|node|lesson)\b", 2), (r"\b(memory|lessons?|knowledge|session log)\b", 1))),
)


def classify_intent(text: Column) -> Column:
    """struct(intent, confidence): the highest total weight; ties go to the earliest match, then the given order."""
    text = F.coalesce(text, F.lit(""))
    scored = []
    for rank, (name, patterns) in enumerate(INTENTS):
        at = [F.regexp_instr(text, F.lit(tx.ascii_words("(?i)" + p))) for p, _ in patterns]
        score = reduce(lambda a, b: a + b, [F.when(x > 0, w).otherwise(0) for x, (_, w) in zip(at, patterns)])
        first = F.least(*[F.when(x > 0, x).otherwise(1 << 30) for x in at], F.lit(1 << 30))
        scored.append(F.struct((-score).alias("neg"), first.alias("first"), F.lit(rank).alias("rank"), F.lit(name).alias("intent")))
    best = F.array_min(F.array(*scored))
    total = F.aggregate(F.transform(F.array(*scored), lambda s: -s["neg"]), F.lit(0), lambda a, b: a + b)
    return F.when(total == 0, F.struct(F.lit("implement").alias("intent"), F.lit(0.0).alias("confidence"))).otherwise(
        F.struct(best["intent"].alias("intent"), (js_round(-best["neg"] / total * 100) / 100).alias("confidence"))
    )


def intent_distribution(rows: DataFrame, text: Column) -> DataFrame:
    """(intent, n, share, low): low counts confidences below a half."""
    c = rows.select(classify_intent(text).alias("c")).select("c.*")
    counts = c.groupBy("intent").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.5).alias("low"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("intent", "n", (F.col("n") / F.col("total")).alias("share"), "low")


#: Verbs that make a line a fact.
FACT = "(?i)(" + "|".join("is was has uses located stored created called defined implements extends returns requires depends provides handles contains supports".split()) + ")"


def lines(rows: DataFrame, id_: str, text: str, *keep: str) -> DataFrame:
    """(id, line_no from 0, line) and the columns to keep."""
    return rows.select(F.col(id_).alias("id"), *keep, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def fact_lines(rows: DataFrame, id_: str, text: str, by: str, most: int, shortest: int = 20) -> DataFrame:
    """(by, fact, rank): distinct fact lines of a cluster in the order of rows, at most so many of each by definition."""
    fact = F.trim(F.regexp_replace("line", r"^[-*\s]+", ""))
    found = lines(rows, id_, text, by).withColumn("fact", fact).filter((F.length("fact") >= shortest) & F.col("fact").rlike(FACT))
    once = found.groupBy(by, "fact").agg(F.min(F.struct("id", "line_no")).alias("at"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("at"))).filter(F.col("rank") <= most).select(by, "fact", "rank")


#: What names a file, a tool, a convention, a preference, a decision.
FILES = r"(?i)\b[\w-]+\.(?:ts|js|tsx|jsx|py|md|json|yml|yaml|sql|sh|css|html)\b"
TOOLS = r"(?i)\b(?:memory_\w+|journal_\w+|git|npm|bun|tsc|test|make|cmake|pip|python|node)\b"
SAYINGS = {
    category: "(?i)(?:" + "|".join(patterns_) + ")"
    for category, patterns_ in {
        "convention": [
            r"convention:?\s*",
            r"standard:?\s*",
            r"best\s+practice",
            r"always\s+(?:use|run|follow)",
            r"never\s+(?:use|do)",
            r"rule:?\s*",
        ],
        "preference": [
            r"user\s+(?:prefers?|likes?|wants?)",
            r"prefers?\s+\w+",
            r"likes?\s+\w+",
            r"uses?\s+\w+",
            r"favorite:?\s*",
        ],
        "decision": [
            r"decided?\s+(?:to|on|that)",
            r"chose\s+\w+",
            r"agreed?\s+(?:to|that)",
            r"will\s+use",
            r"using\s+\w+\s+for",
        ],
    }.items()
}


def _said(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, category, key): what each node says, each thing once."""
    ls = lines(rows, id_, text).select("id", "line")
    found = [_keys(c, F.regexp_extract_all("line", F.lit(tx.ascii_words(p)), F.lit(0))) for c, p in (("file", FILES), ("tool", TOOLS))]
    found += [F.when(F.col("line").rlike(p), _keys(c, F.array(F.substring(F.regexp_replace("line", r"^[-*#\s]+", ""), 1, 80)))) for c, p in SAYINGS.items()]
    none = F.array().cast("array<struct<category:string,key:string>>")
    every = F.concat(*[F.coalesce(x, none) for x in found])  # one pass over the lines for all categories
    return ls.select("id", F.explode(every).alias("k")).select("id", "k.category", "k.key").distinct()


def _keys(category: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(category).alias("category"), k.alias("key")))


def patterns(rows: DataFrame, id_: str, text: str, top: int = 10) -> DataFrame:
    """(category, key, nodes): how many nodes say a thing, the commonest of each category."""
    counted = _said(rows, id_, text).groupBy("category", "key").agg(F.count("*").alias("nodes"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("nodes"), "key"))
    return counted.withColumn("_r", rank).filter(F.col("_r") <= top).drop("_r")


def pattern_nodes(rows: DataFrame, id_: str, text: str, top: int = 10) -> DataFrame:
    """(category, key, id): the nodes that say the commonest things."""
    best = F.broadcast(patterns(rows, id_, text, top).select("category", "key"))  # top rows of five categories
    return _said(rows, id_, text).join(best, ["category", "key"], "left_semi")


def line_runs(rows: DataFrame, id_: str, text: str, shortest: int = 2) -> DataFrame:
    """(id, start, line, n): stretches of equal neighbouring lines."""
    w = Window.partitionBy("id").orderBy("line_no")
    new = F.coalesce((F.lag("line").over(w) != F.col("line")).cast("int"), F.lit(1))
    marked = lines(rows, id_, text).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("id", "_run").agg(F.min("line_no").alias("start"), F.first("line").alias("line"), F.count("*").alias("n")).filter(F.col("n") >= shortest).select("id", "start", "line", "n")


#: What marks a line as an error.
ERROR = r"(?i)(error|failed|fail|panic|traceback|exception|stack trace|test failed)"


def error_context(rows: DataFrame, id_: str, text: str, around: int = 3, pattern: str = ERROR) -> DataFrame:
    """(id, line_no, line, is_error): error lines with so many lines on either side."""
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(-around, around)
    marked = lines(rows, id_, text).withColumn("is_error", F.col("line").rlike(pattern))
    return marked.withColumn("_near", F.max("is_error").over(w)).filter("_near").drop("_near").select("id", "line_no", "line", "is_error")


#: Words that signal trouble in a line.
SIGNALS = ("error", "fail", "panic", "exception", "fatal", "traceback", "denied", "refused", "timeout", "cannot", "unable", "undefined", "unexpected", "warn", "abort", "missing", "not found", "stack")


def line_score(line: Column, terms: list[str], at: Column, total: Column) -> Column:
    low = F.lower(line)
    hit = lambda w, n: F.when(low.contains(w), n).otherwise(0)
    words = reduce(lambda a, b: a + b, [hit(w, 5) for w in SIGNALS] + [hit(t, 3) for t in terms])
    return words + F.when(at < 3, 4 - at).otherwise(0) + F.when(at + 3 >= total, 1).otherwise(0) - F.when(F.trim(line) == "", 1).otherwise(0)


def relevance_trim(rows: DataFrame, id_: str, text: str, terms: list[str], threshold: int = 15, head: int = 3, least: int = 5) -> DataFrame:
    """(id, line_no, line, score): the first lines, those that score enough, and the best others up to the least number."""
    total = F.size(F.split(F.coalesce(text, F.lit("")), "\n"))
    ls = lines(rows.withColumn("_n", total), id_, text, "_n").withColumn("score", line_score(F.col("line"), terms, F.col("line_no"), F.col("_n")))
    first = (F.col("line_no") < head) | (F.col("score") >= threshold)
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(first), F.desc("score"), "line_no"))
    return ls.withColumn("_r", order).filter(first | (F.col("_r") <= least) | (F.col("_n") <= least + head)).select("id", "line_no", "line", "score")


def exact_duplicates(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(hash, n, first_id) of texts that occur more than once."""
    return rows.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash")).agg(F.count("*").alias("n"), F.min(id_).alias("first_id")).filter("n > 1")


def failed_lessons(calls: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """(session_id, signature, failures): sessions with enough failures whose signature no lesson has yet, one per signature."""
    from .telemetry import failure_signatures

    new = failure_signatures(calls).filter(F.col("failures") >= least).join(known.select("signature"), "signature", "left_anti")
    return new.groupBy("signature").agg(F.min("session_id").alias("session_id"), F.max("failures").alias("failures"))


def work_captured(calls: DataFrame, least: int = 3, session: str = "session_id") -> DataFrame:
    """Sessions with enough successful edits: files, tools and their counts."""
    ok = calls.filter(F.col("success"))
    edits = F.count_if(F.col("tool").isin("edit", "write", "replace", "apply_patch"))
    return ok.groupBy(F.col(session).alias("session_id")).agg(edits.alias("edits"), F.sort_array(F.collect_set("file")).alias("files"), F.sort_array(F.collect_set("tool")).alias("tools")).filter(F.col("edits") >= least)


def distilled_rules(lessons: DataFrame, fixes: DataFrame, newest: int = 10) -> DataFrame:
    """(rule): distinct bullet lines of the fixes of the newest lessons."""
    recent = lessons.orderBy(F.desc("created_ms"), "id").limit(newest).select(F.concat("label", F.lit(":fix")).alias("label"))
    found = fixes.join(recent, "label", "left_semi").select(F.explode(F.split("content", "\n")).alias("line"))
    return found.select(F.regexp_extract("line", r"^- (.+)$", 1).alias("rule")).filter("rule <> ''").distinct()


def label_mentions(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """texts(id, text), labels(label, node_id): typed references that name a known label."""
    refs = texts.select("id", F.explode(tx.label_refs(F.col("text"))).alias("label"))
    return refs.join(labels, "label").select("id", "label", "node_id")


def lesson_nodes(calls: DataFrame, nodes: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """(session_id, label, signature, failures, cause, parent_id): a lesson for each new signature of failures, under the stored context of its session if there is one."""
    from .telemetry import root_causes

    new = failed_lessons(calls, known, least).withColumn("label", F.concat(F.lit("lesson:"), "session_id"))
    context = nodes.filter(F.col("label").startswith("storedcontext:")).groupBy("label").agg(F.min("id").alias("parent_id"))
    under = new.join(root_causes(calls), "session_id", "left").withColumn("_c", F.concat(F.lit("storedcontext:"), "session_id"))
    return under.join(context.withColumnRenamed("label", "_c"), "_c", "left").select("session_id", "label", "signature", "failures", "cause", "parent_id")
