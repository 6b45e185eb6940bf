"""Registered queries over compressed command output. The outputs are the lines of all documents, each set in the words of a command.

The SQL is a table of lines: the tests of each line are columns, the kind follows from their counts, each strategy that a text may take
is a row, and the first that saves a tenth is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import compress as cp
from ..sources import nodes as src
from .catalogue import query

#: For each name a command, whether it failed, and what its lines are like; {} is a line of a document, {j} its number.
INPUTS = {
    "build-log": ("make all", False, ["webpack {}", "[{j}%] {}", "vite built in {j}s {}", "Module not found: {}"]),
    "compiler-diagnostics": ("tsc", False, ["src/a{j}.ts:{j}:7 error TS{j}: {}", "src/b.ts:{j}:1 warning W{j}: {}", "  {}"]),
    "test-output": ("make check", False, ["✓ {}", "✗ {}", "✓ {} ({j} ms)", "PASS t{j}.py {}"]),
    "coverage-log": ("nyc", False, ["File | % Stmts | {}", "src/f{j}.ts | 81.5 | {}", "src/g{j}.ts | 100 | {}", "All files | 71.2 | {}"]),
    "npm-install": ("make deps", False, ["+ {}@{j}", "added {j} packages", "npm warn deprecated {}", "+ p{j}@1.0 {}"]),
    "source-code": ("cat f", False, ["import m{j} # {}", "def f{j}(x):", "    return x + {j}  # {}"]),
    "dep-tree": ("npm ls", False, ["├── p{j}@1.0 {}", "│   └── q{j}@2.0 {}", "└── r{j} {}"]),
    "log-stream": ("tail log", False, ["2024-01-01T00:00:01Z INFO {}", "2024-01-01T00:00:02Z ERROR {}", "2024-01-01 00:00 DEBUG {}", "[2024/01/01 00:00] WARN {}"]),
    "config-content": ("cat c", False, ["[part.{j}]", "key{j} = {}", "# {}"]),
    "raw-text": ("cat t", False, ["{}", "", "", "failed {}"]),
    "errors": ("make all", True, [*["{}", "so {} {j}"] * 15, "ERROR {}"]),
    "json": ("curl", False, ['"k{j}": "{}"']),
    "csv": ("query", False, ["{j},x,y {j}"]),
    "stack": ("node x", False, ["Failure {j} {}", "    at f (a.js:{j}:2) {}"]),
    "tree": ("tree", False, ["├ {}", "└ {j}"]),
    "table": ("psql", False, ["| {j} | {} |"]),
    "grep": ("rg x", False, ["a.py:{j}: {}", "b.py:{j}: {}", "c{j}.py:1: {}"]),
    "ls": ("ls -l", False, ["-rw-r--r-- 1 a a {j} {}"]),
    "test": ("pytest -q", False, ["ok {j} {}", "FAIL {}", "Tests: {j} total"]),
    "git status": ("git status", False, ["On branch {}", " M src/{j}.py {}", "?? {}"]),
    "git log": ("git log", False, ["commit abc{j}", "Author: {}", "    {}"]),
    "git diff": ("git diff", False, ["diff --git a/{j} b/{j}", "@@ -{j} +{j} @@", "+{}", "-{}", " {}"]),
    "git push": ("git push", False, ["remote: {}", " abc..def main -> main {j}", "error: {}"]),
    "git pull": ("git pull", False, ["remote: {}", "{j} files changed", "CONFLICT {}"]),
    "git commit": ("git commit", False, ["[main abc{j}] {}", " create mode {j} {}", "{j} files changed"]),
    "git add": ("git add", False, ["warning: {}", "add {j} {}"]),
}

#: Kinds that only outputs of under five lines can be: their lines are quarters of a document.
FEW = ("log-stream", "config-content")

#: The query of each group of strategies.
GROUPS = {
    "compress_build_log": ["build-log"], "compress_diagnostics": ["compiler-diagnostics"], "compress_tests": ["test-output", "test"], "compress_coverage": ["coverage-log"], "compress_install": ["npm-install"],
    "compress_source": ["source-code"], "compress_tree": ["dep-tree"], "compress_log": ["log-stream"], "compress_config": ["config-content"], "compress_raw": ["raw-text"], "compress_errors": ["errors"],
    "compress_shapes": ["json", "csv", "stack", "tree", "table"], "compress_commands": ["grep", "ls"], "compress_git": [k for k in INPUTS if k.startswith("git ")],
}


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select((-1 - F.col("page_id")).alias("id"), F.lit("curl x").alias("command"), F.coalesce("html", F.lit("")).alias("output"), F.lit(False).alias("failed"))


_PAGES = " UNION ALL SELECT -1 - page_id, 'curl x', coalesce(html, ''), false FROM pages"


def _texts(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, command, output, failed) of every document, in the words of the kind that its number picks."""
    pick = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod("doc_id", F.lit(len(kinds))) + 1).cast("int"))

    def of(make) -> Column:
        out = F.when(F.lit(False), make(kinds[0]))
        for k in kinds:
            out = out.when(F.col("kind") == k, make(k))
        return out

    text = F.coalesce("text", F.lit(""))
    quarter = F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")
    quarters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), i * quarter + 1, quarter))
    parts = F.when(F.col("kind").isin(*FEW), quarters).otherwise(F.split(text, "[.\n]"))
    forms = of(lambda k: F.array(*[F.lit(x) for x in INPUTS[k][2]]))
    rows = docs.select("doc_id", "text", pick.alias("kind")).select("doc_id", "kind", parts.alias("parts")).withColumn("forms", forms)
    line = lambda x, j: F.replace(F.replace(F.element_at("forms", j % F.size("forms") + 1), F.lit("{}"), x), F.lit("{j}"), j.cast("string"))
    lines = F.transform("parts", line)
    whole = F.when(F.col("kind") == "json", F.array_join(lines, ",\n")).otherwise(F.array_join(lines, "\n"))
    output = F.when(F.col("kind") == "json", F.concat(F.lit("{"), F.regexp_replace(whole, r"[\x00-\x09\x0b-\x1f\\]", ""), F.lit("}"))).otherwise(whole)
    return rows.select(F.col("doc_id").alias("id"), of(lambda k: F.lit(INPUTS[k][0])).alias("command"), output.alias("output"), of(lambda k: F.lit(INPUTS[k][1])).alias("failed"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _texts_sql(kinds: list[str], more: str) -> str:
    case = lambda make: "CASE kind " + " ".join(f"WHEN {_q(k)} THEN {make(k)}" for k in kinds) + " END"
    forms = case(lambda k: "[" + ", ".join(map(_q, INPUTS[k][2])) + "]")
    pick = "[" + ", ".join(map(_q, kinds)) + f"][CAST(doc_id % {len(kinds)} + 1 AS INT)]"
    line = "[replace(replace(forms[(j - 1) % len(forms) + 1], '{}', x), '{j}', CAST(j - 1 AS VARCHAR)) for x, j in parts]"
    few = ", ".join(map(_q, FEW))
    quarter = "greatest(1, CAST(ceil(length(t) / 4e0) AS INT))"
    return rf"""n AS (SELECT doc_id, {pick} AS kind, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, kind, CASE WHEN kind IN ({few}) THEN [substring(replace(t, chr(10), ' '), i * {quarter} + 1, {quarter}) for i in range(4)] ELSE string_split_regex(t, '[.\n]') END AS parts FROM n),
f AS (SELECT *, {forms} AS forms FROM p),
w AS (SELECT *, CASE WHEN kind = 'json' THEN array_to_string({line}, ',' || chr(10)) ELSE array_to_string({line}, chr(10)) END AS whole FROM f),
o AS (SELECT doc_id AS id, {case(lambda k: _q(INPUTS[k][0]))} AS command, CASE WHEN kind = 'json' THEN '{{' || regexp_replace(whole, '[\x00-\x09\x0b-\x1f\\]', '', 'g') || '}}' ELSE whole END AS raw, {case(lambda k: str(INPUTS[k][1]))} AS failed FROM w{more})"""


def _match(line: str, patterns: list[str]) -> str:
    one = lambda p: f"(contains({line}, '[') AND contains({line}, ']') AND contains({line}, '%'))" if p.startswith("^(?=") else f"regexp_matches({line}, {_q(p)})"  # noqa: E731  there is no looking ahead in this SQL
    return "(" + " OR ".join(map(one, patterns)) + ")"


def _kinds_sql() -> str:
    """k(id, type): the kind of each text of l(id, at, line) and o."""
    bare, left = "trim(line, ' ')", "ltrim(line, ' ')"
    tests = {s: _match("line" if s in cp.WHOLE else left if s == "code mark" else bare, p) for s, p in cp.SIGNS.items() if s not in cp.EACH}
    tests["setting"] += f" AND NOT starts_with({left}, '//') AND NOT starts_with({left}, '#')"
    each = {s: " + ".join(f"CAST({_match(left, [p])} AS INT)" for p in cp.SIGNS[s]) for s in cp.EACH}
    columns = ", ".join(f'{t} AS "{s}"' for s, t in tests.items()) + ", " + ", ".join(f'{e} AS "{s}"' for s, e in each.items())
    n = lambda s: f'count(*) FILTER (WHERE "{s}")'
    sums = ", ".join(f'{n(s)} AS "{s}"' for s in tests) + ", " + ", ".join(f'coalesce(sum("{s}") FILTER (WHERE code), 0) AS "{s}"' for s in each)
    return f"""s AS (SELECT id, {columns}, {bare} <> '' AND NOT starts_with({left}, '```') AS code FROM l),
c AS (SELECT id, count(*) AS size, {sums}, count(*) FILTER (WHERE place AND severity AND NOT "windows path") AS diagnostics, count(*) FILTER (WHERE code AND ("code mark" OR indented)) AS structure, count(*) FILTER (WHERE tree OR indented) AS branches FROM s GROUP BY id),
k AS (SELECT o.id, CASE
  WHEN build >= 2 OR build >= 1 AND progress >= 1 THEN 'build-log'
  WHEN size >= 2 AND diagnostics >= 2 THEN 'compiler-diagnostics'
  WHEN size >= 3 AND ("test total" >= 1 OR test + "test mark" >= 2) THEN 'test-output'
  WHEN size >= 3 AND "coverage share" + "coverage row" + 2 * "coverage head" + "coverage total" >= 2 THEN 'coverage-log'
  WHEN size >= 2 AND (install >= 1 OR "install change" + "install state" >= 2 OR "install change" + "install state" >= 1 AND installed >= 1) THEN 'npm-install'
  WHEN size >= 3 AND (import >= 2 OR definition + remark >= 2 OR size >= 5 AND structure >= 0.4e0 * size) THEN 'source-code'
  WHEN size >= 2 AND branches > 0.6e0 * size AND package >= 1 THEN 'dep-tree'
  WHEN size >= 3 AND dated >= 0.7e0 * size THEN 'log-stream'
  WHEN size >= 3 AND (section >= 2 OR setting >= 0.4e0 * size) THEN 'config-content' ELSE 'raw-text' END AS type
FROM o LEFT JOIN c USING (id))"""


def _sql(kinds: list[str], more: str = "") -> str:
    views = ", ".join(f"({_q(v)}, {i}, {_q(name)}, {_q(pattern)}, {most})" for v, classes in cp.VIEWS.items() for i, (name, pattern, most) in enumerate(classes))
    git = " ".join(f"WHEN {_q(v.split()[1])} THEN {_q(v)}" for v in cp.VIEWS if v.startswith("git "))
    form = rf"""CASE WHEN regexp_matches(trim(raw, ' '), '^[\[{{]') AND json_valid(trim(raw, ' ')) THEN 'json'
  WHEN size >= 3 AND (contains(head, ',') AND commas = 1 OR contains(head, chr(9)) AND tabs = 1) THEN 'csv'
  WHEN size >= 2 AND frames >= 2 THEN 'stack' WHEN size >= 3 AND branches > 0.5e0 * size THEN 'tree'
  WHEN size >= 3 AND cells > 0.7e0 * size THEN 'table' ELSE 'none' END"""
    frame, trouble = _q(cp.FRAME), _q(cp.TROUBLE)
    return rf"""WITH {_texts_sql(kinds, more)},
a AS MATERIALIZED (SELECT id, unnest(string_split(raw, chr(10))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS i FROM o),
l AS MATERIALIZED (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i FROM a WHERE line <> ''),
{_kinds_sql()},
g AS (SELECT id, count(*) AS size, arg_min(line, i) AS head, count(DISTINCT len(line) - len(replace(line, ',', ''))) AS commas, count(DISTINCT len(line) - len(replace(line, chr(9), ''))) AS tabs,
  count(*) FILTER (WHERE regexp_matches(line, {frame})) AS frames, count(*) FILTER (WHERE regexp_matches(line, '^\s*[│├└]')) AS branches, count(*) FILTER (WHERE regexp_matches(line, '\|.*\||\S {{2,}}\S')) AS cells FROM l GROUP BY id),
h AS (SELECT o.*, type, string_split_regex(trim(command, ' '), '\s+') AS words, coalesce({form}, 'none') AS form FROM o JOIN k USING (id) LEFT JOIN g USING (id)),
st AS MATERIALIZED (
  SELECT id, 0 AS ord, 'error-first' AS strategy, '' AS kind FROM h WHERE failed
  UNION ALL SELECT id, 1, 'grep', '' FROM h WHERE words[1] IN ('grep', 'rg')
  UNION ALL SELECT id, 2, 'ls', 'ls' FROM h WHERE words[1] IN ('ls', 'dir')
  UNION ALL SELECT id, 3, 'git', v FROM (SELECT id, CASE words[2] {git} END AS v FROM h WHERE words[1] = 'git') WHERE v IS NOT NULL
  UNION ALL SELECT id, 4, 'test', 'test-output' FROM h WHERE words[1] IN ('pytest', 'jest', 'vitest') OR words[1] IN ('npm', 'bun', 'cargo', 'go') AND starts_with(words[2], 'test')
  UNION ALL SELECT id, 5, type, type FROM h WHERE type <> 'raw-text'
  UNION ALL SELECT id, 6, 'shape', form FROM h WHERE form <> 'none'
  UNION ALL SELECT id, 7, 'raw-text', '' FROM h),
cl(kind, n, name, pattern, most) AS (VALUES {views}),
hit AS MATERIALIZED (SELECT st.id, st.ord, cl.n, cl.most, l.i, l.line, row_number() OVER (PARTITION BY st.id, st.ord, cl.n ORDER BY l.i) AS r
  FROM st JOIN cl USING (kind) JOIN l ON l.id = st.id WHERE regexp_matches(l.line, cl.pattern)),
top AS (SELECT st.id, st.ord, st.kind, string_agg(cl.name || ' ' || coalesce(n.n, 0), ', ' ORDER BY cl.n) AS counts
  FROM st JOIN cl USING (kind) LEFT JOIN (SELECT id, ord, n AS c, count(*) AS n FROM hit GROUP BY ALL) n ON n.id = st.id AND n.ord = st.ord AND n.c = cl.n GROUP BY ALL),
fst AS (SELECT id, ord, line, min((n, i)) AS place FROM hit WHERE r <= most GROUP BY ALL),
shw AS (SELECT id, ord, string_agg(chr(10) || left(rtrim(line, ' '), 200), '' ORDER BY place) AS shown FROM fst GROUP BY ALL),
ns AS (SELECT id, count(*) AS size FROM l GROUP BY id),
vw AS (SELECT id, ord, '[' || kind || ': ' || coalesce(size, 0) || ' lines; ' || counts || ']' || coalesce(shown, '') AS output FROM top LEFT JOIN ns USING (id) LEFT JOIN shw USING (id, ord)),
na AS (SELECT id, count(*) AS size FROM a GROUP BY id),
bad AS (SELECT id, i, regexp_matches(line, {trouble}) OR regexp_matches(line, {frame}) AS b FROM a WHERE id IN (SELECT id FROM h WHERE failed)),
nr AS (SELECT a.id, a.i, a.line, size, max(b) OVER (PARTITION BY a.id ORDER BY a.i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM a JOIN bad ON bad.id = a.id AND bad.i = a.i JOIN na ON na.id = a.id),
gp AS (SELECT id, i, line, size, i - lag(i) OVER (PARTITION BY id ORDER BY i) - 1 AS gap FROM nr WHERE near OR i < 20 OR i >= size - 20),
er AS (SELECT id, 0 AS ord, '[errors first: ' || count(*) || ' of ' || any_value(size) || ' lines]' || chr(10) || string_agg(CASE WHEN gap > 0 THEN '... ' || gap || ' lines' || chr(10) ELSE '' END || line, chr(10) ORDER BY i) AS output FROM gp GROUP BY id),
gf AS (SELECT id, split_part(line, ':', 1) AS file, i, line, row_number() OVER (PARTITION BY id, split_part(line, ':', 1) ORDER BY i) AS r FROM l WHERE id IN (SELECT id FROM st WHERE ord = 1)),
gg AS (SELECT id, min(i) AS i, file || ' (' || count(*) || ')' || chr(10) || string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r <= 2) AS told FROM gf GROUP BY id, file),
gr AS (SELECT id, 1 AS ord, string_agg(told, chr(10) ORDER BY i) AS output FROM gg GROUP BY id),
fd AS (SELECT id, min(i) AS i, any_value(line) || CASE WHEN count(*) > 1 THEN ' (' || count(*) || ' times)' ELSE '' END AS line FROM (
  SELECT id, i, line, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT id, i, line, CASE WHEN line IS NOT DISTINCT FROM lag(line) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS new FROM a)) GROUP BY id, run),
fr AS (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY id) AS size FROM fd),
fk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN i < 3 OR i >= size - 2 THEN 0 WHEN regexp_matches(line, {trouble}) THEN 1 ELSE 2 END, i) AS r FROM fr),
rw AS (SELECT id, 7 AS ord, CASE WHEN any_value(size) > 60 THEN '[kept 60 of ' || any_value(size) || ' lines]' || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY i) FILTER (WHERE r <= 60) AS output FROM fk GROUP BY id),
every AS (SELECT * FROM vw UNION ALL SELECT * FROM er UNION ALL SELECT * FROM gr UNION ALL SELECT * FROM rw),
fit AS (SELECT e.id, min(e.ord) AS ord FROM every e JOIN o USING (id) WHERE len(e.output) < {cp.GAIN} * len(o.raw) AND len(o.raw) >= {cp.LEAST} GROUP BY e.id)
SELECT o.id, k.type, coalesce(st.strategy, 'none') AS strategy, sha256(coalesce(e.output, o.raw)) AS digest, len(coalesce(e.output, o.raw)) AS chars
FROM o JOIN k USING (id) LEFT JOIN fit USING (id) LEFT JOIN st ON st.id = fit.id AND st.ord = fit.ord LEFT JOIN every e ON e.id = fit.id AND e.ord = fit.ord"""


def _report(texts: DataFrame) -> DataFrame:
    return cp.compress_outputs(texts).select("id", "type", "strategy", F.sha2("output", 256).alias("digest"), F.length("output").cast("long").alias("chars"))


def _register(name: str, kinds: list[str]) -> None:
    @query(name, _sql(kinds))
    def run(spark, sf):
        return _report(_texts(src.table(spark, sf, "documents"), kinds))


for _name, _kinds in GROUPS.items():
    _register(_name, _kinds)


@query("output_compression", _sql(list(INPUTS), _PAGES))
def output_compression(spark, sf):
    """Every document in the words of one of all kinds, and every page as it is."""
    return _report(_texts(src.table(spark, sf, "documents"), list(INPUTS)).union(_pages(src.table(spark, sf, "pages"))))
