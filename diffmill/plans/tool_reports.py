"""Queries over reports of analysers, which are built from the driver's tables: a report for each order, an entry for each of its
lines. Entries without a line, entries of other files and broken reports are among them. The oracle reads lineitem alone."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import functions as F

from diffmill.functions.paths import is_reliable
from diffmill.operators import tools as t
from diffmill.plans import derived as d


@dataclass(frozen=True)
class Report:
    """A tool's report: the ending of its files, its forms (what stands before, between and after entries, and an entry; orders
    take turns), the levels that entries take turns with and the severities they mean, and DuckDB SQL of message and rule.

    In an entry, @ln@ is the line (or none), @f@ its file, @m@ a message, @l@ the level, @c@ a JSON code or null, @n@ a number,
    @t@ a code or nothing, @p@ the path of the report's file."""

    ending: str
    forms: tuple[tuple[str, str, str, str], ...]
    levels: tuple[str, ...] = ("-",)
    means: tuple[str, ...] = ("warning",)
    rule: str = "coalesce(code, '')"
    message: str = "msg"
    stream: str = "stdout"
    where: str = "TRUE"


def _list(item: str) -> tuple[str, str, str, str]:
    return "[", ",", "]", item


_LINE = '"line":@ln@,"message":" @m@ "'
#: Field names and forms of the tools' reports.
REPORTS = {
    "pylint": Report("py", (_list('{"line":@ln@,"msg":" @m@ ","type":"@l@","symbol":@c@,"msg_id":"M"}'),), ("convention", "warning", "error", "odd"), ("info", "warning", "error", "warning"), "coalesce(code, 'M')"),
    "ruff": Report("py", (_list('{"location":{"row":@ln@},"message":" @m@ ","code":@c@}'),)),
    "bandit": Report("py", (('{"results":[', ",", "]}", '{"line_number":@ln@,"issue_text":"@m@","issue_severity":"@l@","test_id":@c@}'),), ("HIGH", "Medium", "LOW", "X"), ("error", "warning", "info", "warning")),
    "eslint": Report("js", (('[{"messages":[', ",", ']},{"messages":null},7]', "{" + _LINE + ',"severity":@l@,"ruleId":@c@}'),), ("2", "1", "0", "2"), ("error", "warning", "warning", "error")),
    "oxlint": Report("ts", tuple((a, ",", b, "{" + x + '"filename":"@f@","message":"@m@ ","severity":"@l@","rule":@c@}') for a, b, x in (("[", "]", '"line":@ln@,'), ('{"diagnostics":[', "]}", '"start":{"row":@ln@},'), ('{"diagnostics":[],"messages":[', "]}", '"labels":[{"line":@ln@}],'))), ("Err", "warn", "note", "ERROR"), ("error", "warning", "info", "error")),
    "tsc": Report("ts", (("noise\n", "\n", "\n", "@f@(@ln@,3): @l@ @t@:  @m@"),), ("error", "warning", "error", "warning"), ("error",), "CASE WHEN code IS NULL THEN '' ELSE 'TS' || substr(code, 2) END", stream="stderr"),
    "go_vet": Report("go", (("# pkg\n", "\n", "", "@f@:@ln@: @m@"),), rule="''", stream="stderr"),
    "javac": Report("java", (("note\n", "\n", "", "x/@f@:@ln@: error: @m@"),), means=("error",), rule="'javac'", message="'error: ' || msg", stream="stderr", where="rc <> 0"),
    "rubocop": Report("rb", (('{"files":[{"path":"@p@","offenses":[', ",", ']},{"path":"z","offenses":[{"location":{"line":1}}]}]}', '{"location":{"line":@ln@},"message":"@m@","severity":"@l@","cop_name":@c@}'), ('{"files":[{"path":"./@p@","offenses":[', ",", "]}]}", '{"location":{"start_line":@ln@},"message":"@m@","severity":"@l@","cop_name":@c@}')), ("error", "Warning", "convention", ""), ("error", "warning", "info", "warning")),
    "rustc": Report("rs", (("noise\n", "\n", '\n{"message":"plain"}', '{"message":{"message":" @m@","level":"@l@","code":{"code":@c@},"spans":[{"line_start":@ln@,"file_name":"@f@"},{"file_name":"@p@"}]}}'),), ("error", "warning", "note", ""), ("error", "warning", "info", "error"), stream="stderr"),
    "mcs": Report("cs", (("", "\n", "", "@f@(@ln@,1): @l@ @t@: @m@"),), ("error", "warning"), ("error", "warning"), "CASE WHEN code IS NULL THEN '' ELSE 'CS' || substr(code, 2) END", stream="stderr"),
    "phpstan": Report("php", (('{"messages":[', ",", ",null]}", "{" + _LINE + ',"identifier":@c@}'),), means=("error",)),
    "swiftlint": Report("swift", (_list('{"line":@ln@,"reason":"@m@","rule_id":@c@}'), _list("{" + _LINE + ',"rule_id":@c@}'))),
    "ktlint": Report("kt", (_list('{"file":"@f@",' + _LINE + ',"ruleId":@c@}'), _list('{"file":"a/@f@","startLine":@ln@,"description":"@m@","rule":@c@}'))),
    "shellcheck": Report("sh", (_list("{" + _LINE + ',"level":"@l@","code":@n@}'),), ("error", "warning", "style", ""), ("error", "warning", "info", "warning"), "CAST(num AS VARCHAR)"),
    "stylelint": Report("css", (('[{"source":"@p@","warnings":[', ",", ']},{"source":"z","warnings":[{"line":1}]}]', '{"line":@ln@,"text":" @m@","severity":"@l@","rule":@c@}'), ('[{"source":"@p@","messages":[', ",", "]}]", "{" + _LINE + ',"severity":"@l@","ruleId":@c@}')), ("error", "warning", "Error", ""), ("error", "warning", "warning", "warning")),
    "yamllint": Report("yml", (("", "\n", "", "@f@:@ln@:2: [@l@] @m@@b@"),), ("error", "warning", "info"), ("error", "warning", "info")),
    "hadolint": Report("dockerfile", (_list("{" + _LINE + ',"code":@c@}'),)),
    "tflint": Report("tf", (('{"issues":[', ",", "]}", '{"range":{"start":{"line":@ln@}},"rule":{"name":@c@,"severity":"ERROR"},"message":"@m@"}'), _list('{"Range":{"Start":{"Line":@ln@}},"Rule":{"Name":@c@},"message":"@m@"}'))),
    "luacheck": Report("lua", (("Checking\n", "\n", "", "@f@:@ln@:3: (@l@12) @m@"),), ("E", "W"), ("error", "warning"), "''"),
    "elixirc": Report("ex", (("", "\n", "", "@f@:@ln@: @l@: @m@"),), ("error", "warning"), ("error", "warning"), "''", stream="stderr"),
    "lintr": Report("r", (("", "\n", "", "@f@:@ln@:4: @l@: @m@"),), ("style", "warning", "error", "two words"), rule="level"),
    "perlcritic": Report("pl", (("source OK\n", "\n", "", " @ln@ 5  P@n@ @m@ "),), rule="'P' || num"),
    "markdownlint": Report("md", (_list('{"lineNumber":@ln@,"ruleDescription":"@m@","ruleNames":["MD@n@","x"]}'), _list("{" + _LINE + ',"rule":@c@}')), rule="CASE WHEN id % 2 = 0 THEN 'MD' || num || ',x' ELSE coalesce(code, '') END"),
}
#: The numbers that reports have in the inventory of operators.
IDS = {"pylint": "X2", "ruff": "X3", "bandit": "X4", "eslint": "X6", "oxlint": "X7", "tsc": "X8", "go_vet": "X9", "javac": "X10", "rubocop": "X11", "rustc": "X12", "mcs": "X14", "phpstan": "X15", "swiftlint": "X16", "ktlint": "X17", "shellcheck": "X18", "stylelint": "X19", "yamllint": "X20", "hadolint": "X21", "tflint": "X22", "luacheck": "X23", "elixirc": "X24", "lintr": "X25", "perlcritic": "X26", "markdownlint": "X27"}
PACKAGE = '{\n "name": "d1",\n "dependencies": {\n  "d1": "1",\n  "d3": "1"\n },\n\n "devDependencies": {\n  "d2" : "*"\n }\n}'


def _entries(s, sf, item: str, levels: tuple[str, ...], ending: str, text: bool):
    """id, path, ln, part, sup and the entry of each line of an order, as its template says."""
    q = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    code = "IF(l_suppkey % 4 = 3, 'null', concat('\"C', l_partkey % 7, '\"'))"
    bare = "IF(l_suppkey % 4 = 3, '', concat({}, l_partkey % 7))"
    values = {
        "ln": f"IF(l_linenumber = 7, {q('x' if text else 'null')}, CAST(l_linenumber AS STRING))", "f": f"IF(l_linenumber = 6, 'other.x', concat('src/f', l_orderkey, '.{ending}'))", "p": f"concat('src/f', l_orderkey, '.{ending}')",
        "m": "concat('say ', l_partkey)", "l": f"element_at(array({', '.join(map(q, levels))}), CAST(l_suppkey % {len(levels)} AS INT) + 1)", "c": code, "n": "CAST(l_partkey % 7 + 1 AS STRING)",
        "t": bare.format("'TS'" if ending == "ts" else "'CS'"), "b": f"IF(l_suppkey % 4 = 3, '', concat(' (', {bare.format(chr(39) + 'C' + chr(39))}, ')'))",
    }
    parts = [q(x) if i % 2 == 0 else values[x] for i, x in enumerate(item.split("@")) if x or i % 2]
    return f"concat({', '.join(parts)})"


def reports(s, sf, tool: str):
    """(path, stdout, stderr, rc): a report for each order."""
    r = REPORTS[tool]
    text = "[" not in r.forms[0][0] and "{" not in r.forms[0][3]
    entry = "CASE l_orderkey % {n} ".format(n=len(r.forms)) + " ".join(f"WHEN {i} THEN {_entries(s, sf, form[3], r.levels, r.ending, text)}" for i, form in enumerate(r.forms)) + " END"
    lines = d.table(s, sf, "lineitem").selectExpr("l_orderkey AS id", f"concat('src/f', l_orderkey, '.{r.ending}') AS path", f"{entry} AS entry")
    rows = lines.groupBy("id", "path").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    turn = F.col("id") % len(r.forms)
    body = F.lit(None).cast("string")
    for i, (before, between, after, _) in enumerate(r.forms):
        around = lambda x: F.replace(F.lit(x), F.lit("@p@"), F.col("path"))
        body = F.when(turn == i, F.concat(around(before), F.array_join("entries", between), around(after))).otherwise(body)
    body = F.when(F.col("id") % 10 == 9, F.concat(F.lit("{broken "), F.substring(body, 1, 5) if not text else F.lit(""))).otherwise(body)
    other = F.lit("" if r.stream == "stderr" else "noise")
    out, err = (other, body) if r.stream == "stderr" else (body, other)
    return rows.select("path", out.alias("stdout"), err.alias("stderr"), F.when(F.col("id") % 10 == 8, 0).otherwise(1).alias("rc"))


def expected(tool: str) -> str:
    r = REPORTS[tool]
    sup = f"l_suppkey % {len(r.levels)}"
    case = lambda xs: f"CASE {sup} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs)) + " END" if len(xs) > 1 else f"'{xs[0]}'"
    other = "AND line <> 6" if any("@f@" in form[3] for form in r.forms) and tool not in ("javac", "perlcritic") else ""
    base = f"SELECT l_orderkey AS id, 'src/f' || l_orderkey || '.{r.ending}' AS path, l_linenumber AS line, 'say ' || l_partkey AS msg, {case(r.levels)} AS level, {case(r.means)} AS severity, CASE WHEN l_suppkey % 4 <> 3 THEN 'C' || (l_partkey % 7) END AS code, l_partkey % 7 + 1 AS num, CASE WHEN l_orderkey % 10 = 8 THEN 0 ELSE 1 END AS rc FROM lineitem"
    return f"SELECT path, line, {r.message} AS message, severity, {r.rule} AS rule_id FROM ({base}) WHERE id % 10 <> 9 AND line <> 7 {other} AND {r.where}"


COLUMNS = ("path", "line", "message", "severity", "rule_id")


def _named(s, sf, sql: str):
    """lineitem by a SQL expression over one row of each (order, line): id, ln, part, sup."""
    return d.table(s, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln")).agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("sup")).selectExpr("*", f"{sql} AS entry")


BASE = "b AS (SELECT l_orderkey AS id, l_linenumber AS ln, min(l_partkey) AS part, min(l_suppkey) AS sup FROM lineitem GROUP BY 1, 2)"
AUDIT_LEVELS = ("critical", "High", "moderate", "Low", "info")
LEVEL = "element_at(array('critical', 'High', 'moderate', 'Low', 'info'), CAST(sup % 5 AS INT) + 1)"
MEANS = "CASE sup % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warning' ELSE 'info' END"
LINE_OF = "CASE ln WHEN 1 THEN 4 WHEN 2 THEN 9 WHEN 3 THEN 5 ELSE 1 END"


def _package():
    return F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 == 0, "{broken").otherwise(PACKAGE).alias("package")


def _npm(s, sf):
    rows = _named(s, sf, f"""concat('"d', ln, '":', CASE WHEN part % 9 = 0 THEN '"odd"' ELSE concat('{{"severity":"', {LEVEL}, '"', IF(part % 3 = 0, ',"name":"n"', ''), ',"via":', CASE part % 4 WHEN 0 THEN '[{{"title":" t ","url":"u"}}]' WHEN 1 THEN '[{{"url":"u"}}]' WHEN 2 THEN '["x"]' ELSE 'null' END, '}}') END)""")
    body = F.concat(F.lit('{"vulnerabilities":{'), F.array_join(F.collect_list("entry"), ","), F.lit("}}"))
    return rows.groupBy("id").agg(body.alias("stdout")).select(F.concat(F.lit("p"), "id").alias("path"), "stdout", _package())


def _yarn(s, sf):
    rows = _named(s, sf, f"""concat('{{"type":"', IF(part % 9 = 0, 'auditSummary', 'auditAdvisory'), '","data":{{"advisory":{{"module_name":"', IF(ln = 7, '', concat('d', ln DIV 2)), '","title":"', IF(part % 3 = 0, '', concat('t', part)), '","severity":"', {LEVEL}, '"}}}}}}')""")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "entry"))), lambda x: x["entry"]), "\n")
    return rows.groupBy("id").agg(F.concat(F.lit("noise\n"), body).alias("stdout")).select(F.concat(F.lit("p"), "id").alias("path"), "stdout", _package())


def _xml(s, sf, tool: str):
    if tool == "spotbugs":
        entry = "concat('<BugInstance type=\"C', part % 7, '\"><ShortMessage>short</ShortMessage>', IF(sup % 4 = 3, '', concat('<LongMessage> say ', part, ' </LongMessage>')), IF(ln = 7, '', concat('<SourceLine start=\"', IF(ln = 5, 'x', CAST(ln AS STRING)), '\" sourcepath=\"', IF(ln = 6, 'Other.java', concat('a/f', id, '.java')), '\"/>')), '</BugInstance>')"
        around, path, streams = ("<BugCollection>", "</BugCollection>"), "java", 0
    else:
        entry = "concat('<error id=\"C', part % 7, '\"', element_at(array(' severity=\"error\"', ' severity=\"Warning\"', ' severity=\"style\"', ''), CAST(sup % 4 AS INT) + 1), ' msg=\" say ', part, '\">', IF(ln = 7, '', concat('<location file=\"', IF(ln = 6, 'other.c', concat('/tmp/src/f', id, '.c')), '\" line=\"', IF(ln = 5, 0, ln), '\"/><location file=\"z\" line=\"9\"/>')), '</error>')"
        around, path, streams = ("<?xml version=\"1.0\"?><results><errors>", "</errors></results>"), "c", 1
    rows = _named(s, sf, entry).groupBy("id").agg(F.array_join(F.collect_list("entry"), "").alias("body"))
    body = F.concat(F.lit(around[0]), "body", F.when(F.col("id") % 10 == 9, "<broken").otherwise(around[1]))
    out = (body, F.lit("")) if not streams else (F.lit(""), body)
    return rows.select(F.concat(F.lit("src/f"), "id", F.lit(f".{path}")).alias("path"), out[0].alias("stdout"), out[1].alias("stderr"), F.lit(0).alias("rc"))


def _checked(s, sf):
    said = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 4 == 1, " odd ").otherwise(F.concat(F.lit("Expecting value: LINE "), F.col("o_orderkey") % 9 + 2, F.lit(" column 3")))
    return d.table(s, sf, "orders").select(F.concat(F.lit("f"), "o_orderkey", F.lit(".json")).alias("path"), F.lit("").alias("stdout"), said.alias("stderr"), (F.col("o_orderkey") % 3).cast("int").alias("rc"))


def _scans(s, sf):
    """A scan of each order in a folder /w: results of its odd lines, errors of its even ones."""
    path = "concat(IF(part % 2 = 0, '/w/', ''), 'src/f', id, element_at(array('.py', '.yml'), CAST(part % 2 AS INT) + 1))"
    entry = f"""IF(ln % 2 = 1, concat('{{"path":"', {path}, '","check_id":"c', part, '","start":{{', IF(ln = 7, '', concat('"line":', ln)), '}},"extra":{{"message":"m', part, '"', IF(sup % 3 = 0, '', ',"severity":"ERROR"'), '}}}}'),
      concat('{{"path":"', {path}, '","message":"', IF(sup % 3 = 0, '', concat(' bad in ', {path}, ' here ')), '","spans":[', IF(ln = 6, '', concat('{{"start":{{"line":', ln, '}}}}')), ']}}'))"""
    rows = _named(s, sf, entry)
    pick = lambda odd: F.array_join(F.collect_list(F.when(F.col("ln") % 2 == odd, F.col("entry"))), ",")
    return rows.groupBy("id").agg(F.concat(F.lit('{"results":['), pick(1), F.lit('],"errors":['), pick(0), F.lit("]}")).alias("doc")).select(F.when(F.col("id") % 10 == 9, "broken").otherwise(F.col("doc")).alias("doc"), "id")


def _sarif(s, sf):
    """A SARIF document of each order: a result a line, at a place of its own, by an index, or at none."""
    entry = """concat('{"ruleId":"r', part, '",', IF(sup % 4 = 3, '', concat('"level":"', element_at(array('error', 'note', 'none'), CAST(sup % 4 AS INT) + 1), '",')), '"message":{"text":"m', ln, '"},"locations":[', CASE ln % 4 WHEN 0 THEN '' WHEN 1 THEN concat('{"physicalLocation":{"artifactLocation":{"uri":"file:///tmp/x/f', id, '.py"},"region":{"startLine":', ln, '}}}') WHEN 2 THEN '{"physicalLocation":{"artifactLocation":{"index":0}}},{"physicalLocation":{"artifactLocation":{"index":5}}}' ELSE '{"physicalLocation":{"artifactLocation":{"uri":"b.py"},"region":{"startLine":3}}}' END, ']}')"""
    rows = _named(s, sf, entry).groupBy("id").agg(F.array_join(F.collect_list("entry"), ",").alias("e"))
    return rows.select(F.when(F.col("id") % 10 == 9, "broken").otherwise(F.concat(F.lit('{"runs":[{"artifacts":[{"location":{"uri":"src/z'), "id", F.lit('.py"}}],"results":['), "e", F.lit("]}]}"))).alias("doc"), "id")


def _lint_files(s, sf):
    """Files of reviews with all endings, and the package file of some."""
    endings = ("py", "js", "tsx", "go", "java", "rb", "rs", "h", "cs", "yml", "zsh", "SASS", "tfvars", "mdx", "json", "txt", "dockerfile")
    of = F.element_at(F.array(*map(F.lit, endings)), (F.col("doc_id") % len(endings) + 1).cast("int"))
    docs = d.table(s, sf, "documents")
    own = docs.select((F.col("doc_id") % 40).cast("string").alias("review_id"), F.concat(F.lit("src/f"), "doc_id", F.lit("."), of).alias("path"), F.when(F.col("doc_id") % 6 == 0, "").otherwise("x").alias("content"))
    ids = docs.select((F.col("doc_id") % 40).cast("string").alias("review_id")).distinct()
    return own.unionByName(ids.where("CAST(review_id AS INT) % 3 = 0").select("review_id", F.explode(F.array(F.struct(F.lit("package.json").alias("path"), F.lit(PACKAGE).alias("content")), F.struct(F.lit("yarn.lock").alias("path"), F.lit("y").alias("content")))).alias("f")).select("review_id", "f.*")).unionByName(ids.where("CAST(review_id AS INT) % 4 = 0").select("review_id", F.lit("web/yarn.lock").alias("path"), F.lit("y").alias("content")))


def _lint_reports(s, sf):
    """What each tool said of each file: two equal issues and one more."""
    wanted = t.wanted_runs(_lint_files(s, sf)).select("review_id", "path", "tool")
    one = F.lit('{"line":2,"message":"a","severity":2,"ruleId":"r","rule":"r"}')
    script = F.when(F.col("tool") == "eslint", F.concat(F.lit('[{"messages":['), one, F.lit(","), one, F.lit(',{"line":3,"message":"b"}]}]'))).when(F.col("tool") == "oxlint", F.concat(F.lit("["), one, F.lit(',{"line":4,"message":"o"}]'))).when(F.col("tool") == "ruff", '[{"location":{"row":1},"message":"u"}]').when(F.col("tool") == "bandit", '{"results":[{"line_number":1,"issue_text":"u"}]}').when(F.col("tool") == "yarn_audit", '{"type":"auditAdvisory","data":{"advisory":{"module_name":"d3","severity":"high"}}}').otherwise("")
    said = F.when(F.col("tool") == "go_vet", F.concat("path", F.lit(":5: g"))).when(F.col("tool") == "json_tool", "line 8").otherwise("")
    return wanted.select("*", script.alias("stdout"), said.alias("stderr"), F.lit(1).alias("rc"))


def _runs(s, sf):
    return d.table(s, sf, "orders").selectExpr("o_orderkey AS run_id", "explode(sequence(1, IF(o_orderkey % 5 = 0, 1, 2))) AS attempt").selectExpr("run_id", "attempt", "CAST(IF(attempt = 1, run_id % 4, run_id % 3) AS INT) AS rc", "concat('doc', attempt) AS doc")


QUERIES = {f"{IDS[n]}_{n}": (lambda s, sf, n=n: t.issues(reports(s, sf, n), n).select(*COLUMNS)) for n in REPORTS}
QUERIES |= {
    "X5_python_issues": lambda s, sf: t.python_issues(reports(s, sf, "ruff"), reports(s, sf, "bandit")).select(*COLUMNS, "source"),
    "X10_spotbugs": lambda s, sf: t.issues(_xml(s, sf, "spotbugs"), "spotbugs").select(*COLUMNS),
    "X13_cppcheck": lambda s, sf: t.issues(_xml(s, sf, "cppcheck"), "cppcheck").select(*COLUMNS),
    "X28_json_tool": lambda s, sf: t.json_tool(_checked(s, sf)).select(*COLUMNS),
    "X29_T28_npm_audit": lambda s, sf: t.npm_audit(_npm(s, sf)).select(*COLUMNS),
    "X30_T28_yarn_audit": lambda s, sf: t.yarn_audit(_yarn(s, sf)).select(*COLUMNS),
    "X33_linted": lambda s, sf: t.linted(_lint_files(s, sf), _lint_reports(s, sf)),
    "X34_X35_accepted_runs": lambda s, sf: t.accepted_runs(_runs(s, sf)),
    "S18_sarif": lambda s, sf: t.sarif(_sarif(s, sf)),
    "S19_scanner": lambda s, sf: t.scanner_findings(_scans(s, sf), is_reliable, "/w"),
}
NAMES = ("Dockerfile", "app.dockerfile", "a.py", "A.MJS", "b.jsx", "c.tsx", "package-lock.json", "yarn.lock", "go.go", "J.java", "r.rb", "l.rs", "h.h", "c.cxx", "n.cs", "p.php", "s.swift", "k.kts", "z.zsh", "y.sass", "q.yaml", "v.tfvars", "l.lua", "e.exs", "S.R", "m.pm", "d.mdx", "j.json", "t.txt", "none", ".py", "x.d.ts")


def _linted_names(s, sf):
    """The path of each document, with a name that documents take turns with."""
    return d.files(s, sf).select("doc_id", "content", F.concat(F.regexp_extract("path", r"^(.*/)", 1), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))).alias("path"))


def _languages(s, sf):
    return d.table(s, sf, "orders").selectExpr("o_orderkey AS id", "concat('o/r', o_orderkey % 9) AS repo", "concat('c', o_orderkey) AS commit", "filter(array('python', IF(o_orderkey % 2 = 0, 'go', NULL), 'java', 'go'), x -> x IS NOT NULL) AS languages")


def _known(s, sf):
    return d.table(s, sf, "orders").selectExpr("concat('src/f', o_orderkey, '.py') AS path", "o_orderkey AS seq").where("seq % 3 = 0").unionByName(s.range(1).selectExpr("'f3.py' AS path", "0L AS seq"))


QUERIES |= {
    "X1_linter_of_file": lambda s, sf: _linted_names(s, sf).select("doc_id", t.linter_of(F.col("path")).alias("linter")),
    "T6_scan_keys": lambda s, sf: _linted_names(s, sf).select("doc_id", t.scan_key("semgrep", F.col("content")).alias("scan_key"), t.lint_key(t.linter_of(F.col("path")), F.col("content")).alias("lint_key")),
    "T7_analysis_key": lambda s, sf: _languages(s, sf).select("id", t.analysis_key(F.col("repo"), F.col("commit"), F.lit("security-extended"), F.col("languages")).alias("key")),
    "J9_T26_rekeyed": lambda s, sf: t.rekeyed(t.scanner_findings(_scans(s, sf), is_reliable).select("path", "line"), _known(s, sf)).select("path", "line"),
}
LINTER = """CASE doc_id % 32 WHEN 0 THEN 'hadolint' WHEN 1 THEN 'hadolint' WHEN 2 THEN 'python' WHEN 3 THEN 'eslint' WHEN 4 THEN 'eslint' WHEN 5 THEN 'ts' WHEN 6 THEN 'npm_audit' WHEN 7 THEN 'yarn_audit' WHEN 8 THEN 'go' WHEN 9 THEN 'java' WHEN 10 THEN 'rubocop' WHEN 11 THEN 'rustc' WHEN 12 THEN 'cppcheck' WHEN 13 THEN 'cppcheck' WHEN 14 THEN 'csharp' WHEN 15 THEN 'phpstan'
 WHEN 16 THEN 'swiftlint' WHEN 17 THEN 'ktlint' WHEN 18 THEN 'shellcheck' WHEN 19 THEN 'stylelint' WHEN 20 THEN 'yamllint' WHEN 21 THEN 'tflint' WHEN 22 THEN 'luacheck' WHEN 23 THEN 'elixirc' WHEN 24 THEN 'lintr' WHEN 25 THEN 'perlcritic' WHEN 26 THEN 'markdownlint' WHEN 27 THEN 'json_syntax' WHEN 30 THEN 'python' WHEN 31 THEN 'ts' END"""
SCAN = f"""{BASE}, p AS (SELECT *, 'src/f' || id || CASE WHEN part % 2 = 0 THEN '.py' ELSE '.yml' END AS path FROM b WHERE id % 10 <> 9)"""
SCANNED = f"""WITH {SCAN} SELECT path, ln AS line, CASE WHEN sup % 3 = 0 THEN 'WARNING' ELSE 'ERROR' END AS severity, 'c' || part AS check_id, 'm' || part AS message FROM p WHERE ln % 2 = 1 AND ln <> 7
  UNION ALL SELECT path, ln, 'ERROR', 'semgrep-parse-error', CASE WHEN sup % 3 = 0 THEN 'Semgrep parsing/syntax error' ELSE 'bad in ' || path || ' here' END FROM p WHERE ln % 2 = 0 AND ln <> 6 AND part % 2 = 0"""
ORACLE = {f"{IDS[n]}_{n}": expected(n) for n in REPORTS}
_e = lambda x: x.replace("'", "''")
LF = """f AS (SELECT CAST(doc_id % 40 AS VARCHAR) AS review_id, 'src/f' || doc_id || '.' || (['py', 'js', 'tsx', 'go', 'java', 'rb', 'rs', 'h', 'cs', 'yml', 'zsh', 'SASS', 'tfvars', 'mdx', 'json', 'txt', 'dockerfile'])[doc_id % 17 + 1] AS path, doc_id % 17 AS e FROM documents WHERE doc_id % 6 <> 0), ids AS (SELECT DISTINCT doc_id % 40 AS i FROM documents)"""
ORACLE |= {
    "X5_python_issues": f"SELECT *, 'ruff' AS source FROM ({expected('ruff')}) UNION ALL SELECT *, 'bandit' FROM ({expected('bandit')})",
    "X10_spotbugs": f"WITH {BASE} SELECT 'src/f' || id || '.java' AS path, ln AS line, CASE WHEN sup % 4 = 3 THEN 'short' ELSE 'say ' || part END AS message, 'warning' AS severity, 'C' || (part % 7) AS rule_id FROM b WHERE id % 10 <> 9 AND ln < 5",
    "X13_cppcheck": f"WITH {BASE} SELECT 'src/f' || id || '.c' AS path, ln AS line, 'say ' || part AS message, CASE sup % 4 WHEN 0 THEN 'error' WHEN 2 THEN 'info' ELSE 'warning' END AS severity, 'C' || (part % 7) AS rule_id FROM b WHERE id % 10 <> 9 AND ln < 5",
    "X28_json_tool": "SELECT 'f' || o_orderkey || '.json' AS path, CAST(CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE o_orderkey % 9 + 2 END AS INTEGER) AS line, CASE o_orderkey % 4 WHEN 0 THEN 'Invalid JSON' WHEN 1 THEN 'odd' ELSE 'Expecting value: LINE ' || (o_orderkey % 9 + 2) || ' column 3' END AS message, 'error' AS severity, '' AS rule_id FROM orders WHERE o_orderkey % 3 <> 0",
    "X29_T28_npm_audit": f"WITH {BASE} SELECT 'p' || id AS path, CASE WHEN id % 7 = 0 THEN 1 ELSE {LINE_OF} END AS line, 'Vulnerable dependency: ' || CASE WHEN part % 3 = 0 THEN 'n' ELSE 'd' || ln END || CASE part % 4 WHEN 0 THEN ' — t' WHEN 1 THEN ' — u' ELSE '' END AS message, {MEANS} AS severity, 'npm-audit-d' || ln AS rule_id FROM b WHERE id % 5 <> 0 AND part % 9 <> 0 AND sup % 5 <> 3",
    "X30_T28_yarn_audit": f"WITH {BASE}, k AS (SELECT *, ln // 2 AS dep FROM b WHERE id % 5 <> 0 AND part % 9 <> 0 AND sup % 5 <> 3 AND ln <> 7 QUALIFY row_number() OVER (PARTITION BY id, ln // 2 ORDER BY ln) = 1) SELECT 'p' || id AS path, CASE WHEN id % 7 = 0 THEN 1 ELSE CASE dep WHEN 1 THEN 4 WHEN 2 THEN 9 WHEN 3 THEN 5 ELSE 1 END END AS line, 'Vulnerable dependency: d' || dep || CASE WHEN part % 3 = 0 THEN '' ELSE ' — t' || part END AS message, {MEANS} AS severity, 'yarn-audit-d' || dep AS rule_id FROM k",
    "X33_linted": f"""WITH {LF} SELECT review_id, path, 2 AS line, 'a' AS message, 'error' AS severity, 'r' AS rule_id, 'eslint' AS source FROM f WHERE e IN (1, 2) UNION ALL SELECT review_id, path, 3, 'b', 'warning', '', 'eslint' FROM f WHERE e IN (1, 2) UNION ALL SELECT review_id, path, 4, 'o', 'warning', '', 'oxlint' FROM f WHERE e IN (1, 2)
      UNION ALL SELECT review_id, path, 1, 'u', 'warning', '', s FROM f, (VALUES ('ruff'), ('bandit')) v(s) WHERE e = 0 UNION ALL SELECT review_id, path, 5, 'g', 'warning', '', 'go vet' FROM f WHERE e = 3 UNION ALL SELECT review_id, path, 8, 'line 8', 'error', '', 'json.tool' FROM f WHERE e = 14
      UNION ALL SELECT CAST(i AS VARCHAR), 'package.json', 8, 'line 8', 'error', '', 'json.tool' FROM ids WHERE i % 3 = 0 UNION ALL SELECT CAST(i AS VARCHAR), 'package.json', 5, 'Vulnerable dependency: d3', 'error', 'yarn-audit-d3', 'yarn_audit' FROM ids, (VALUES (3), (12)) v(m) WHERE i % m = 0""",
    "X34_X35_accepted_runs": "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 < 2 OR o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS attempt, CAST(CASE WHEN o_orderkey % 4 < 2 OR o_orderkey % 5 = 0 THEN o_orderkey % 4 ELSE o_orderkey % 3 END AS INTEGER) AS rc, CASE WHEN o_orderkey % 4 < 2 OR o_orderkey % 5 = 0 THEN 'doc1' ELSE 'doc2' END AS doc FROM orders",
    "S18_sarif": f"WITH {BASE} SELECT CASE ln % 4 WHEN 1 THEN 'f' || id || '.py' WHEN 2 THEN 'src/z' || id || '.py' ELSE 'b.py' END AS path, CASE ln % 4 WHEN 1 THEN ln WHEN 2 THEN 1 ELSE 3 END AS line, CASE sup % 4 WHEN 0 THEN 'ERROR' WHEN 3 THEN 'WARNING' ELSE 'INFO' END AS severity, 'r' || part AS check_id, 'm' || ln AS message FROM b WHERE id % 10 <> 9 AND ln % 4 <> 0",
    "S19_scanner": SCANNED,
}
ORACLE |= {
    "X1_linter_of_file": f"SELECT doc_id, {LINTER} AS linter FROM documents",
    "T6_scan_keys": f"SELECT doc_id, sha256('semgrep' || coalesce(text, '')) AS scan_key, sha256('linter:' || {LINTER} || ':' || coalesce(text, '')) AS lint_key FROM documents",
    "T7_analysis_key": "SELECT o_orderkey AS id, sha256('codeql:o/r' || (o_orderkey % 9) || ':c' || o_orderkey || ':security-extended:' || CASE WHEN TRUE THEN 'go,java,python' END) AS key FROM orders",
    "J9_T26_rekeyed": f"WITH {SCAN}, r AS (SELECT 'src/f' || id || '.py' AS path, CASE WHEN part % 2 = 0 THEN id END AS id, ln AS line FROM p WHERE part % 2 = 0 AND (ln % 2 = 1 AND ln <> 7 OR ln % 2 = 0 AND ln <> 6)) SELECT CASE WHEN id = 3 THEN 'f3.py' ELSE r.path END AS path, line FROM r JOIN orders ON o_orderkey = id WHERE id % 3 = 0",
}
