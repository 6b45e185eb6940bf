"""Usage analytics: tool patterns and sequences, sessions, token totals, dashboards, feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_round


def tool_patterns(log: DataFrame, since, tool: str = "tool", ts: str = "ts") -> DataFrame:
    """Per tool since a time: calls, mean tokens and duration, warning and success rates in percent."""
    return (
        log.filter(F.col(ts) >= since)
        .groupBy(F.col(tool).alias("tool"))
        .agg(
            F.count("*").alias("calls"),
            js_round(F.avg("tokens")).cast("long").alias("avg_tokens"),
            js_round(F.avg("duration_ms")).cast("long").alias("avg_duration_ms"),
            js_round(F.avg(F.col("warning").cast("double")) * 100).cast("long").alias("warning_rate"),
            js_round(F.avg(F.col("success").cast("double")) * 100).cast("long").alias("success_rate"),
        )
    )


def tool_sequences(log: DataFrame, least: int = 2, top: int = 10, tool: str = "tool", order: tuple[str, ...] = ("ts", "id"), by: list[str] | None = None) -> DataFrame:
    """(first, second, n): what directly follows what, self-pairs skipped. Over one global order unless by is given.

    The global order is not one task's window: rows are range-partitioned by time, neighbours inside a
    partition pair up there, and the first and last row of each partition meet in a table of two rows a partition.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        pairs = log.select(F.col(tool).alias("first"), F.lead(tool).over(w).alias("second"))
    else:
        parts = log.select(F.col(tool).alias("_t"), *order).repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
        inside = Window.partitionBy("_p").orderBy(*order)
        paired = parts.select("_p", F.col("_t").alias("first"), F.lead("_t").over(inside).alias("second"))
        at = F.struct(*order)
        ends = parts.groupBy("_p").agg(F.min_by("_t", at).alias("head"), F.max_by("_t", at).alias("last"))
        seams = ends.select(F.col("last").alias("first"), F.lead("head").over(Window.orderBy("_p")).alias("second"))  # a row for each partition
        pairs = paired.select("first", "second").filter("second IS NOT NULL").unionByName(seams)
    counted = pairs.filter("second IS NOT NULL AND first <> second").groupBy("first", "second").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "first", "second").limit(top)


def session_counters(calls: DataFrame, session: str = "session_id", tool: str = "tool") -> DataFrame:
    """Per session: calls by category, failures, distinct files."""
    of = lambda *names: F.count_if(F.col(tool).isin(*names))
    return calls.groupBy(F.col(session).alias("session_id")).agg(
        F.count("*").alias("calls"),
        of("read", "view").alias("reads"),
        of("edit", "write", "purchase").alias("edits"),
        of("bash", "shell", "click").alias("shell"),
        F.count_if(~F.col("success")).alias("failed"),
        F.count_distinct("file").alias("files"),
    )


def failure_signatures(calls: DataFrame, session: str = "session_id", tool: str = "tool") -> DataFrame:
    """Sorted distinct failed tools of each session, comma-joined."""
    return calls.filter(~F.col("success")).groupBy(F.col(session).alias("session_id")).agg(F.array_join(F.sort_array(F.collect_set(tool)), ",").alias("signature"), F.count("*").alias("failures"))


def usage_totals(log: DataFrame, session: str, value: str) -> DataFrame:
    return log.agg(F.count_distinct(session).alias("sessions"), F.count("*").alias("turns"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def usage_by_session(log: DataFrame, session: str, value: str, top: int) -> DataFrame:
    return log.groupBy(F.col(session).alias("session_id")).agg(F.count("*").alias("turns"), F.sum(value).alias("total"), F.max("ts").alias("last_ts")).orderBy(F.desc("turns"), "session_id").limit(top)


def dashboard(nodes: DataFrame) -> DataFrame:
    """Nodes, characters and tokens by level and by type, and in all, from one pass of grouping sets."""
    g = nodes.groupingSets([["level"], ["type"], []], "level", "type")
    return g.agg(F.grouping_id().cast("long").alias("set_id"), F.count("*").alias("nodes"), F.sum(F.length("content")).cast("long").alias("chars"), F.sum(F.floor(F.length("content") / 4)).cast("long").alias("tokens"))


def histograms(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n) for many columns at once: unpivoted and grouped in one shuffle."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")
    return nodes.select(rows).groupBy(F.col("r.dimension").alias("dimension"), F.coalesce("r.value", F.lit("none")).alias("value")).agg(F.count("*").alias("n"))


def confidence_histogram(nodes: DataFrame) -> DataFrame:
    """Counts by tenths of confidence, each labelled by its rounded lower end."""
    at = js_round(F.col("confidence") * 10).cast("long") / 10
    label = F.concat(F.format_number(at, 1), F.lit("-"), F.format_number(at + 0.1, 1))
    return nodes.groupBy(label.alias("band")).agg(F.count("*").alias("n"))


def recent(rows: DataFrame, since, limit: int, ts: str = "ts", id_: str = "id") -> DataFrame:
    return rows.filter(F.col(ts) > since).orderBy(F.desc(ts), F.desc(id_)).limit(limit)


def latest_per(rows: DataFrame, by: str, ts: str, id_: str) -> DataFrame:
    """The newest row of each group, by a grouped maximum rather than a window over whole groups."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    newest = rows.groupBy(F.col(by).alias("_by")).agg(F.max_by(whole, F.struct(ts, id_)).alias("r"))
    return newest.select("r.*")


def level_ratios(nodes: DataFrame) -> DataFrame:
    """(level, n, ratio): counts of levels and each over the next one's; a window over a handful of rows."""
    counts = nodes.groupBy("level").agg(F.count("*").alias("n"))
    after = F.lead("n").over(Window.orderBy("level"))
    return counts.select("level", "n", (F.col("n") / after).alias("ratio"))


def json_stats(rows: DataFrame, json: str, key: str, by: str) -> DataFrame:
    """Mean and extremes of one number inside JSON text; malformed text counts as without."""
    v = F.try_variant_get(F.try_parse_json(F.col(json)), f"$.{key}", "double")
    return rows.withColumn("_v", v).groupBy(by).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.avg("_v").alias("mean"))


def injection_stats(log: DataFrame) -> dict[str, DataFrame]:
    """log(ts, strategy, types map<string,int>, scores array<double>): by strategy, by type, of scores, by day."""
    return {
        "strategy": log.groupBy("strategy").agg(F.count("*").alias("n")),
        "type": log.select(F.explode("types").alias("type", "k")).groupBy("type").agg(F.sum("k").cast("long").alias("n")),
        "score": log.select(F.explode("scores").alias("s")).agg(F.min("s").alias("low"), F.avg("s").alias("mean"), F.max("s").alias("high")),
        "day": log.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")),
    }


def attribution(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """feedback(node_id, at) -> the newest row of log(id, ts, ids array) at or before it that has the node; null if none has.

    Both are put in one order of time for each node, and a row takes the last log row before it: no row meets another.
    """
    none = F.lit(None).cast(log.schema["id"].dataType)
    shown = log.select(F.explode("ids").alias("node_id"), F.col("ts").alias("at"), F.lit(0).alias("_late"), "id")
    asked = feedback.select("node_id", "at", F.lit(1).alias("_late"), none.alias("id"))
    w = Window.partitionBy("node_id").orderBy("at", "_late", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = shown.unionByName(asked).withColumn("log_id", F.last("id", ignorenulls=True).over(w))
    return both.filter("_late = 1").select("node_id", "at", "log_id")


def subtask(calls: DataFrame, session: str = "session_id", tool: str = "tool", command: str = "command") -> DataFrame:
    """(session_id, subtask): the commonest phase of work; ties go to validation, editing, analysis, localization."""
    t, c = F.lower(F.col(tool)), F.coalesce(F.col(command), F.lit(""))
    #: Tools and commands of each phase.
    edits, reads, looks, shells = ("edit", "write", "replace", "apply_patch"), ("read",), ("grep", "glob", "search", "skeletonize"), ("bash", "shell")
    checks = r"(?i)\b(test|tests|build|lint|typecheck|tsc|pytest|jest|vitest|cargo (build|test)|go (build|test)|make)\b"
    e, r = t.isin(*edits), t.isin(*reads)
    a = ~e & ~r & (t.isin(*looks) | t.startswith("graph"))
    v = ~e & ~r & ~a & t.isin(*shells) & c.rlike(checks)
    n = calls.groupBy(F.col(session).alias("session_id")).agg(F.count_if(v).alias("validation"), F.count_if(e).alias("editing"), F.count_if(a).alias("analysis"), F.count_if(r).alias("localization"))
    top = F.greatest("validation", "editing", "analysis", "localization")
    pick = reduce(lambda w, k: w.when(F.col(k) == top, k), ["editing", "analysis", "localization"], F.when(F.col("validation") == top, "validation"))
    return n.select("session_id", F.when(top > 0, pick).alias("subtask"))


def pressure(turns: DataFrame, window_tokens: int, session: str = "session_id", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Running share of a context window by session, and the phase it puts the session in; first marks a phase's first turn.

    Sums count to the ninth decimal, so that one that reaches a bound exactly does so in whatever order it was added up.
    Turns without a time come last.
    """
    w = Window.partitionBy(session).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    used = F.round(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9) / window_tokens
    phase = F.when(F.col("used") >= 0.95, "critical").when(F.col("used") >= 0.85, "aggressive").when(F.col("used") >= 0.7, "warn").otherwise("normal")
    out = turns.withColumn("used", used).withColumn("phase", phase)
    return out.withColumn("first", ~F.coalesce(F.lag("phase").over(w) == F.col("phase"), F.lit(False)))


def compression_totals(log: DataFrame, since) -> DataFrame:
    """One row: calls, characters before and after, and whole percent saved."""
    t = log.filter(F.col("ts") >= since).agg(F.count("*").alias("calls"), F.coalesce(F.sum("raw"), F.lit(0)).cast("long").alias("raw"), F.coalesce(F.sum("compressed"), F.lit(0)).cast("long").alias("compressed"))
    return t.withColumn("saved", F.when(F.col("raw") > 0, js_round((1 - F.col("compressed") / F.col("raw")) * 100)).otherwise(0).cast("long"))


def compression_by(log: DataFrame, by: str, since, top: int | None = None) -> DataFrame:
    """log(ts, raw, compressed) by strategy or by command: calls, characters, mean percent saved; the commonest first."""
    share = F.avg(1 - F.col("compressed") / F.greatest(F.col("raw"), F.lit(1))) * 100
    out = log.filter(F.col("ts") >= since).groupBy(by).agg(F.count("*").alias("calls"), F.sum("raw").cast("long").alias("raw"), F.sum("compressed").cast("long").alias("compressed"), F.round(share, 1).alias("saved"))
    return out if top is None else out.orderBy(F.desc("calls"), by).limit(top)


def helpfulness(log: DataFrame) -> DataFrame:
    """log(tokens, effectiveness): injections, mean tokens, percent that were of use; nulls count as none."""
    return log.agg(
        F.count("*").alias("injections"),
        js_round(F.avg(F.coalesce("tokens", F.lit(0)))).cast("long").alias("tokens"),
        js_round(F.avg((F.coalesce("effectiveness", F.lit(0.0)) > 0).cast("double")) * 100).cast("long").alias("helpful"),
    )


def session_metrics(log: DataFrame, session: str = "session_id") -> DataFrame:
    """Per session: injections, tool calls, mean effectiveness over those that have one."""
    return log.groupBy(F.col(session).alias("session_id")).agg(F.count("*").alias("injections"), F.coalesce(F.sum("tool_calls"), F.lit(0)).cast("long").alias("tool_calls"), F.avg("effectiveness").alias("effectiveness"))


def strategy_history(trends: DataFrame) -> DataFrame:
    """trends(strategy, score) -> how often each was active, and its mean score."""
    return trends.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


def score_spread(scores: DataFrame, by: str, order: tuple[str, ...] = ("ts", "id"), last: int = 5, score: str = "score") -> DataFrame:
    """Adds the last scores so far (five), and the spread between the highest and the lowest of them."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - last, 0)
    return scores.withColumn("history", F.collect_list(score).over(w)).withColumn("spread", F.max(score).over(w) - F.min(score).over(w))


def injection_digest(records: DataFrame, most: int = 5) -> DataFrame:
    """records(feature, detail, at) -> (feature, n, digest): distinct details in the order they came, the first five of them."""
    first = records.groupBy("feature", "detail").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy("at", "detail"))
    shown = F.array_sort(F.collect_list(F.when(F.col("_r") <= most, F.struct("_r", "detail"))))
    out = first.withColumn("_r", rank).groupBy("feature").agg(F.count("*").alias("n"), shown.alias("d"))
    count = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n"), F.lit(")"))).otherwise("")
    return out.select("feature", "n", F.concat("feature", count, F.lit(": "), F.array_join(F.transform("d", lambda x: x["detail"]), "; ")).alias("digest"))


def injected_ids(log: DataFrame, rows: int = 20, most: int = 200, session: str = "session_id") -> DataFrame:
    """log(session, ts, id, after array, before array) -> (session_id, node_id, place): distinct ids of each session's newest injections, newest first.

    Ids after reranking count, those before it where there are none. At most so many rows and ids of a session, by definition.
    """
    newest = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("ts"), F.desc("id")))
    some = log.withColumn("_r", newest).filter(F.col("_r") <= rows)
    each = some.select(F.col(session).alias("session_id"), "_r", F.posexplode(F.coalesce("after", "before")).alias("_p", "node_id")).filter("node_id IS NOT NULL")
    first = each.groupBy("session_id", "node_id").agg(F.min(F.struct("_r", "_p")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("_at"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("session_id", "node_id", "place")


def all_tags(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, n) of all tags."""
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def intent_lines(lines: DataFrame, session, limit: int = 200) -> DataFrame:
    """The declared intents of a session in order of turns."""
    return lines.filter(F.col("session_id") == session).orderBy("turn", "id").limit(limit)


def working_cache(entries: DataFrame, now_ms: int, most: int = 8, ttl_ms: int = 7_200_000, longest: int = 2_000) -> DataFrame:
    """entries(session_id, id, label, content, importance, at_ms): what each session's cache holds now.

    Of entries of one label the newest counts; two hours later it is gone; the eight most important stay.
    """
    fresh = entries.filter(F.col("at_ms") > now_ms - ttl_ms)
    whole = F.struct(*[F.col(c) for c in entries.columns])
    once = fresh.groupBy(F.col("session_id").alias("_s"), F.col("label").alias("_l")).agg(F.max_by(whole, F.struct("at_ms", "id")).alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("importance"), "id"))
    return once.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r").withColumn("content", F.substring("content", 1, longest))


def fractal(nodes: DataFrame, depths: DataFrame, parents: str = "parent_ids") -> DataFrame:
    """One row: nodes, depth of the tree, log-ratio dimension, mean number of parents of those that have any."""
    deep = depths.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    many = F.avg(F.when(F.size(parents) > 0, F.size(parents)))
    base = nodes.agg(F.count("*").alias("nodes"), js_round(F.coalesce(many, F.lit(0.0)) * 100).alias("p"))
    ratio = F.when((F.col("nodes") > 1) & (F.col("depth") > 0), F.log("nodes") / F.log(1 + F.col("depth"))).otherwise(0.0)
    return base.join(deep).select("nodes", "depth", (js_round(ratio * 100) / 100).alias("dimension"), (F.col("p") / 100).alias("parents"))


def root_causes(calls: DataFrame, session: str = "session_id", tool: str = "tool") -> DataFrame:
    """(session_id, cause): one tool that fails again is a bad idea, several that fail once or twice are bugs, all else is unknown."""
    per = calls.filter(~F.col("success")).groupBy(F.col(session).alias("session_id"), F.col(tool).alias("t")).agg(F.count("*").alias("n"))
    both = per.groupBy("session_id").agg(F.count("*").alias("tools"), F.max("n").alias("most"))
    cause = F.when((F.col("tools") == 1) & (F.col("most") >= 2), "bad-idea").when((F.col("tools") >= 2) & (F.col("most") <= 2), "implementation-bug").otherwise("unknown")
    return both.select("session_id", cause.alias("cause"))


def clustered_signatures(signatures: DataFrame, least: int = 3) -> DataFrame:
    """(signature, n) of failures that many sessions share."""
    return signatures.groupBy("signature").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def rule_count(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("label").startswith("rule:")).agg(F.count("*").alias("rules"))


def top_strategies(log: DataFrame, top: int = 3) -> DataFrame:
    """log(strategy, mode, tokens, nodes): the commonest ways of injecting, by the strategy or else the mode, with mean tokens and nodes."""
    name = F.coalesce("strategy", "mode", F.lit("unknown"))
    out = log.groupBy(name.alias("strategy")).agg(F.count("*").alias("n"), js_round(F.avg("tokens")).cast("long").alias("tokens"), (js_round(F.avg("nodes") * 10) / 10).alias("nodes"))
    return out.orderBy(F.desc("n"), "strategy").limit(top)
