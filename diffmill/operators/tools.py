"""Reports of analysers as relations: (path, stdout, stderr, rc) rows to issues (path, line, message, severity, rule_id, source).

A tool is a row of a table: which stream it writes to, the form of that stream, and how fields and severities are read. JSON is
read as variants, so fields may have other names or forms in other versions of a tool, and text by patterns; both inside Spark.
A report that cannot be read gives no issues, and an issue without a line is none. Reports of a whole folder name files: issues
of other files than the row's go.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.functions.paths import LINE_END
from diffmill.tables import written

ISSUE = ["path", "line", "message", "severity", "rule_id", "source"]
RAW = "path string, stdout string, stderr string, rc int"
SPACE = " \t\n\r\v\f"


@dataclass(frozen=True)
class Json:
    """A JSON report: the arrays to explode, outer to inner, each by the places it may be at; then the places of fields in an
    element, of which the first that says something counts. levels: severity by level, else other; no levels: always other."""

    steps: tuple[tuple[str, ...], ...]
    line: tuple[str, ...]
    message: tuple[str, ...]
    rule: tuple[str, ...]
    level: tuple[str, ...] = ()
    levels: tuple[tuple[str, str], ...] = ()
    other: str = "warning"
    streams: tuple[str, ...] = ("stdout",)
    each_line: bool = False
    file: tuple[str, ...] = ()
    like: str = "name"
    nameless: bool = False
    name: str = ""
    no_level: str = "warning"


@dataclass(frozen=True)
class Text:
    """A report as text: a pattern with named places of groups; 0 is none. Severity is that of the level, else other."""

    pattern: str
    line: int
    message: int
    level: int = 0
    rule: int = 0
    file: int = 0
    streams: tuple[str, ...] = ("stderr",)
    levels: tuple[tuple[str, str], ...] = ()
    other: str = "warning"
    fixed_rule: str = ""
    like: str = "name"
    each_line: bool = False
    failed_only: bool = False
    name: str = ""


BOTH = ("stdout", "stderr")
ERROR = (("error", "error"),)
ERROR_WARNING = (("error", "error"), ("warning", "warning"))
#: Places of fields, patterns and severities of each tool's report.
TOOLS: dict[str, Json | Text] = {
    "pylint": Json((("$",),), ("$.line",), ("$.msg",), ("$.symbol", "$.msg_id"), ("=$.type",), (("convention", "info"), ("refactor", "info"), *ERROR_WARNING)),
    "ruff": Json((("$",),), ("$.location.row",), ("$.message",), ("$.code",)),
    "bandit": Json((("$.results",),), ("$.line_number",), ("$.issue_text",), ("$.test_id",), ("$.issue_severity",), (("high", "error"), ("medium", "warning"), ("low", "info"))),
    "eslint": Json((("$",), ("$.messages",)), ("$.line",), ("$.message",), ("$.ruleId",), ("$.severity",), (("2", "error"),)),
    "oxlint": Json((("$", "$.diagnostics", "$.messages"),), ("$.start.line", "$.start.row", "$.start[0].line", "$.start[0].row", "$.labels.line", "$.labels.row", "$.labels[0].line", "$.labels[0].row", "$.line"), ("$.message",), ("$.rule", "$.code"), ("$.severity",), (("error", "error"), ("err", "error"), ("warning", "warning"), ("warn", "warning")), "info", file=("$.filename", "$.file"), nameless=True),
    "tsc": Text(r"^(.+?)\((\d+),(\d+)\):\s*(?:error|warning)\s+(TS\d+)?:\s*(.+)$", 2, 5, 0, 4, 1, other="error"),
    "go_vet": Text(r"^([^:]+):(\d+):\s*(.+)$", 2, 3, file=1, like="path", name="go vet"),
    "javac": Text(r"^(.+):(\d+):\s*(.+)$", 2, 3, other="error", fixed_rule="javac", each_line=True, failed_only=True, name="spotbugs"),
    "rubocop": Json((("$.files",), ("$.offenses",)), ("$.location.start_line", "$.location.line"), ("$.message",), ("$.cop_name",), ("$.severity",), ERROR_WARNING, "info", file=("^$.path",), like="path"),
    "rustc": Json((("$.message.spans",),), ("$.line_start", "$.line"), ("^$.message.message",), ("^$.message.code.code",), ("^$.message.level",), ERROR_WARNING, "info", ("stderr",), True, ("$.file_name",), no_level="error"),
    "mcs": Text(r"^(.+?)\((\d+),(\d+)\):\s*(error|warning)\s+(CS\d+)?:\s*(.+)$", 2, 6, 4, 5, 1, levels=ERROR),
    "phpstan": Json((("$.messages",),), ("$.line",), ("$.message",), ("$.identifier",), other="error"),
    "swiftlint": Json((("$",),), ("$.line",), ("$.reason", "$.message"), ("$.rule_id",)),
    "ktlint": Json((("$",),), ("$.line", "$.startLine"), ("$.message", "$.description"), ("$.ruleId", "$.rule"), file=("$.file",), like="path"),
    "shellcheck": Json((("$",),), ("$.line",), ("$.message",), ("$.code",), ("$.level",), ERROR_WARNING, "info"),
    "stylelint": Json((("$",), ("$.warnings", "$.messages")), ("$.line",), ("$.text", "$.message"), ("$.rule", "$.ruleId"), ("=$.severity",), ERROR, file=("^$.source",), like="same"),
    "yamllint": Text(r"^([^:]+):(\d+):(\d+):\s*\[(error|warning|info)\]\s*(.+)$", 2, 5, 4, -1, 1, BOTH, ERROR_WARNING, "info"),
    "hadolint": Json((("$",),), ("$.line",), ("$.message",), ("$.code", "$.rule")),
    "tflint": Json((("$", "$.issues"),), ("$.range.start.line", "$.range.start.Line", "$.range.Start.line", "$.range.Start.Line", "$.Range.start.line", "$.Range.start.Line", "$.Range.Start.line", "$.Range.Start.Line", "$.line"), ("$.message",), ("$.rule.name", "$.rule.Name", "$.Rule.name", "$.Rule.Name")),
    "luacheck": Text(r"^([^:]+):(\d+):(\d+):\s*\(([WE])\d+\)\s*(.+)$", 2, 5, 4, 0, 1, BOTH, (("e", "error"),)),
    "elixirc": Text(r"^([^:]+):(\d+):\s*(error|warning):\s*(.+)$", 2, 4, 3, 0, 1, levels=ERROR),
    "lintr": Text(r"^([^:]+):(\d+):(\d+):\s*([^:]+):\s*(.+)$", 2, 5, 0, 4, 1, BOTH),
    "perlcritic": Text(r"^(\d+)\s+(\d+)\s+([^\s]+)\s+(.+)$", 1, 4, 0, 3, streams=BOTH, each_line=True),
    "markdownlint": Json((("$",),), ("$.lineNumber", "$.line"), ("$.ruleDescription", "$.message", "$.description"), ("$.ruleNames", "$.rule", "$.ruleName"), streams=BOTH),
}
#: Which linter a file goes to, by the ending of its name.
LINTERS = {
    "python": "py", "eslint": "js mjs cjs jsx", "ts": "ts tsx", "go": "go", "java": "java", "rubocop": "rb", "rustc": "rs", "cppcheck": "c h cpp cc cxx hpp", "csharp": "cs", "phpstan": "php",
    "swiftlint": "swift", "ktlint": "kt kts", "shellcheck": "sh bash zsh", "stylelint": "css scss sass", "yamllint": "yml yaml", "tflint": "tf tfvars", "luacheck": "lua", "elixirc": "ex exs",
    "lintr": "r", "perlcritic": "pl pm", "markdownlint": "md mdx", "json_syntax": "json", "hadolint": "dockerfile",
}
#: The tools that a linter runs where it is not one of its own name.
RUNS = {"python": ("ruff", "bandit"), "eslint": ("eslint", "oxlint"), "ts": ("eslint", "tsc", "oxlint"), "go": ("go_vet",), "java": ("javac", "spotbugs"), "csharp": ("mcs",), "json_syntax": ("json_tool",)}


def audit_severity(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin("critical", "high"), "error").when(low == "moderate", "warning").otherwise("info")


def linter_of(path: Column) -> Column:
    """The linter of a file by its name, else by the ending of its path; null if there is none."""
    low = F.lower(path)
    name = F.regexp_extract(low, r"([^/]*)/*$", 1)
    ending = F.regexp_extract(low, r"\.([^./]+)$", 1)
    by_name = F.when(name == "dockerfile", "hadolint").when(name == "package-lock.json", "npm_audit").when(name == "yarn.lock", "yarn_audit")
    table = F.create_map(*(F.lit(x) for linter, endings in LINTERS.items() for e in endings.split() for x in (e, linter)))
    return F.coalesce(by_name, F.try_element_at(table, ending))


def _stripped(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def _stream(names: tuple[str, ...]) -> Column:
    """The first stream that says something."""
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def _of_file(file: Column, like: str) -> Column:
    """Whether a report's file is the row's: it names the same path, has the path in it, or (like name) has its base name in it."""
    norm, path = F.replace(F.coalesce(file, F.lit("")), F.lit("\\"), F.lit("/")), F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    if like == "same":
        return norm == path
    whole = F.contains(norm, path)
    return whole if like == "path" else whole | F.contains(norm, F.regexp_extract(path, r"([^/]*)/*$", 1))


def _at(place: str, kind: str, depth: int) -> Column:
    """What is at a place: of the innermost element, or with a ^ before it, of one further out; null where it is not to be read."""
    up = len(place) - len(place.lstrip("^"))
    return F.try_variant_get(F.col(f"x{depth - up}"), place.lstrip("^"), kind)


def _first(places: tuple[str, ...], kind: str, depth: int) -> Column:
    """The first of the places that says something; zero and the empty string say nothing, but for the last place."""
    nothing = F.lit(0) if kind == "int" else F.lit("")
    found = [_at(p, kind, depth) for p in places]
    return F.coalesce(*(F.nullif(f, nothing) for f in found[:-1]), found[-1])


def _kept(raw: DataFrame) -> list[str]:
    """What an issue keeps of its report's row: the path, and the review and linter if the row has them."""
    return [c for c in ("review_id", "linter", "path") if c in raw.columns]


def _json(raw: DataFrame, tool: str, t: Json) -> DataFrame:
    rows = raw.select(*_kept(raw), _stream(t.streams).alias("doc"))
    if t.each_line:
        rows = rows.select(*_kept(raw), F.explode(F.split("doc", LINE_END)).alias("doc"))
    rows = rows.select(*_kept(raw), F.try_parse_json("doc").alias("x0"))
    depth = 0
    for step in t.steps:
        arrays = [F.try_variant_get(F.col(f"x{depth}"), place, "array<variant>") for place in step]
        full = [F.when(F.size(a) > 0, a) for a in arrays]
        depth += 1
        rows = rows.select(*rows.columns, F.explode(F.coalesce(*full)).alias(f"x{depth}"))
    if t.file:
        file = _first(t.file, "string", depth)
        rows = rows.where(_of_file(file, t.like) | (F.coalesce(file, F.lit("")) == "" if t.nameless else F.lit(False)))
    if t.level:
        exact = t.level[0].startswith("=")
        level = _first(tuple(p.lstrip("=") for p in t.level), "string", depth)
        level = F.coalesce(F.nullif(level if exact else F.lower(level), F.lit("")), F.lit(t.no_level))
        severity = reduce(lambda w, kv: w.when(level == kv[0], kv[1]), t.levels, F.when(F.lit(False), "")).otherwise(t.other)
    else:
        severity = F.lit(t.other)
    rule = _first(t.rule, "string", depth)
    if tool == "markdownlint":  # names come as a list
        rule = F.coalesce(F.array_join(F.filter(_at(t.rule[0], "array<string>", depth), lambda n: n.isNotNull()), ","), rule)
    message = _stripped(F.coalesce(_first(t.message, "string", depth), F.lit("")))
    out = rows.select(*_kept(raw), _first(t.line, "int", depth).alias("line"), message.alias("message"), severity.alias("severity"), F.coalesce(rule, F.lit("")).alias("rule_id"))
    return out.where("line IS NOT NULL").withColumn("source", F.lit(t.name or tool))


def _text(raw: DataFrame, tool: str, t: Text) -> DataFrame:
    text = _stripped(_stream(t.streams))
    rows = raw.where("rc <> 0") if t.failed_only else raw
    if t.each_line:
        rows = rows.select(*_kept(raw), F.explode(F.split(text, LINE_END)).alias("text")).withColumn("text", _stripped(F.col("text")) if tool == "perlcritic" else F.col("text"))
    else:
        rows = rows.select(*_kept(raw), text.alias("text"))
    wanted = sorted({g for g in (t.line, t.message, t.level, t.rule, t.file) if g > 0})
    groups = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(f"(?dm){t.pattern}"), F.lit(g)).alias(f"g{g}") for g in wanted))
    rows = rows.select(*_kept(raw), F.explode(groups).alias("m"))
    group = lambda g: F.col(f"m.g{g}")
    if t.file:
        rows = rows.where(_of_file(group(t.file), t.like))
    message, rule = _stripped(group(t.message)), _stripped(group(t.rule)) if t.rule > 0 else F.lit(t.fixed_rule)
    if t.rule < 0:  # a last part in brackets is the rule
        tail = r"^(?s)(.*) \((.*)\)$"
        rule, message = _stripped(F.regexp_extract(message, tail, 2)), F.when(message.rlike(tail), _stripped(F.regexp_extract(message, tail, 1))).otherwise(message)
    severity = reduce(lambda w, kv: w.when(F.lower(group(t.level)) == kv[0], kv[1]), t.levels, F.when(F.lit(False), "")).otherwise(t.other) if t.level else F.lit(t.other)
    out = rows.select(*_kept(raw), F.expr(f"try_cast(m.g{t.line} AS INT)").alias("line"), message.alias("message"), severity.alias("severity"), rule.alias("rule_id"))
    return out.where("line IS NOT NULL").withColumn("source", F.lit(t.name or tool))


def issues(raw: DataFrame, tool: str) -> DataFrame:
    """Issues of one tool's reports (path, stdout, stderr, rc; audits also have package, the package file's content)."""
    if tool in XML:
        return xml_issues(raw, tool)
    if tool == "json_tool":
        return json_tool(raw)
    if tool in ("npm_audit", "yarn_audit"):
        return npm_audit(raw) if tool == "npm_audit" else yarn_audit(raw)
    t = TOOLS[tool]
    return (_json if isinstance(t, Json) else _text)(raw, tool, t)


def python_issues(raw: DataFrame, other: DataFrame) -> DataFrame:
    """Both Python tools, repeats kept."""
    return issues(raw, "ruff").unionByName(issues(other, "bandit"))


#: The stream, the schema and the elements of reports in XML.
XML = {
    "spotbugs": ("stdout", "BugInstance ARRAY<STRUCT<_type: STRING, LongMessage: STRING, ShortMessage: STRING, SourceLine: ARRAY<STRUCT<_start: STRING, _sourcepath: STRING>>>>", "e.BugInstance"),
    "cppcheck": ("stderr", "errors STRUCT<error: ARRAY<STRUCT<_id: STRING, _severity: STRING, _msg: STRING, location: ARRAY<STRUCT<_line: STRING, _file: STRING>>>>>", "e.errors.error"),
}


def xml_issues(raw: DataFrame, tool: str) -> DataFrame:
    """Issues of reports in XML, of the row's file only. A location's first line counts; cppcheck's has to be positive."""
    stream, schema, elements = XML[tool]
    rows = raw.select(*_kept(raw), F.explode(F.from_xml(F.trim(stream), schema)[elements.split(".")[1]] if tool == "spotbugs" else F.from_xml(F.trim(stream), schema)["errors"]["error"]).alias("x"))
    text = lambda c: F.coalesce(_stripped(F.col(c)), F.lit(""))
    if tool == "spotbugs":
        rows = rows.where(_of_file(F.expr("x.SourceLine[0]._sourcepath"), "name"))
        message = F.coalesce(F.nullif(text("x.LongMessage"), F.lit("")), text("x.ShortMessage"))
        out = rows.select(*_kept(raw), F.expr("try_cast(x.SourceLine[0]._start AS INT)").alias("line"), message.alias("message"), F.lit("warning").alias("severity"), F.coalesce("x._type", F.lit("")).alias("rule_id"))
        return out.where("line IS NOT NULL").withColumn("source", F.lit(tool))
    rows = rows.where(_of_file(F.expr("x.location[0]._file"), "name"))
    level = F.lower(F.coalesce(F.nullif(F.col("x._severity"), F.lit("")), F.lit("warning")))
    out = rows.select(*_kept(raw), F.expr("try_cast(x.location[0]._line AS INT)").alias("line"), text("x._msg").alias("message"), F.when(level.isin("error", "warning"), level).otherwise("info").alias("severity"), F.coalesce("x._id", F.lit("")).alias("rule_id"))
    return out.where("line > 0").withColumn("source", F.lit(tool))


def json_tool(raw: DataFrame) -> DataFrame:
    """A JSON file that does not parse: one error, at the line that the message names, else at 1."""
    text = _stripped(F.coalesce("stderr", F.lit("")))
    line = F.coalesce(F.expr(r"try_cast(regexp_extract(stderr, '(?i)line\\s+([0-9]+)', 1) AS INT)"), F.lit(1))
    said = F.when(text == "", "Invalid JSON").otherwise(text)
    return raw.where("rc <> 0").select(*_kept(raw), line.alias("line"), said.alias("message"), F.lit("error").alias("severity"), F.lit("").alias("rule_id"), F.lit("json.tool").alias("source"))


def package_line(package: Column, name: Column) -> Column:
    """The line of a dependency's key in a package file, from 1; 1 if the file is broken or lists no such dependency."""
    quoted = F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    at = F.regexp_instr(package, F.concat(F.lit('(?dm)^\\s*"\\Q'), quoted, F.lit('\\E"\\s*:')))
    lists = [F.map_contains_key(F.try_variant_get(F.try_parse_json(package), f"$.{k}", "map<string,variant>"), name) for k in ("dependencies", "devDependencies")]
    listed = F.coalesce(lists[0], F.lit(False)) | F.coalesce(lists[1], F.lit(False))
    return F.when(listed & (at > 0), F.size(F.split(F.substring(package, F.lit(1), at - 1), "\n"))).otherwise(1)


def _audited(rows: DataFrame, tool: str, title: Column, detail: Column) -> DataFrame:
    """Rows (path, package, dep, severity) as issues of an audit."""
    said = F.concat(F.lit("Vulnerable dependency: "), title, F.when(detail != "", F.concat(F.lit(" — "), detail)).otherwise(""))
    return rows.select(*_kept(rows), package_line(F.col("package"), F.col("dep")).alias("line"), said.alias("message"), audit_severity(F.col("severity")).alias("severity"), F.concat(F.lit(f"{tool.replace('_', '-')}-"), F.col("dep")).alias("rule_id"), F.lit(tool).alias("source"))


def npm_audit(raw: DataFrame) -> DataFrame:
    """Issues of an audit (path, stdout, package): a row for each dependency that is not of low severity. No package, no issues."""
    found = F.try_variant_get(F.try_parse_json("stdout"), "$.vulnerabilities", "map<string,variant>")
    rows = raw.where("package <> ''").select(*_kept(raw), "package", F.explode(found).alias("dep", "v")).where(F.try_variant_get("v", "$", "map<string,variant>").isNotNull())
    get = lambda place: F.coalesce(F.try_variant_get("v", place, "string"), F.lit(""))
    rows = rows.withColumn("severity", get("$.severity")).where(F.lower("severity") != "low")
    detail = _stripped(F.coalesce(F.nullif(get("$.via[0].title"), F.lit("")), get("$.via[0].url")))
    return _audited(rows, "npm_audit", F.coalesce(F.nullif(get("$.name"), F.lit("")), F.col("dep")), detail)


def yarn_audit(raw: DataFrame) -> DataFrame:
    """Issues of an audit by lines (path, stdout, package): of each dependency the first advisory that is not of low severity."""
    lines = raw.where("package <> ''").select(*_kept(raw), "package", F.posexplode(F.split("stdout", LINE_END)).alias("pos", "l")).withColumn("v", F.try_parse_json("l"))
    get = lambda place: F.coalesce(F.try_variant_get("v", place, "string"), F.lit(""))
    rows = lines.where(get("$.type") == "auditAdvisory").select(*_kept(raw), "package", "pos", get("$.data.advisory.module_name").alias("dep"), get("$.data.advisory.severity").alias("severity"), _stripped(get("$.data.advisory.title")).alias("title"))
    rows = rows.where((F.col("dep") != "") & (F.lower("severity") != "low"))
    first = rows.groupBy(*_kept(raw), "package", "dep").agg(F.min_by(F.struct("severity", "title"), "pos").alias("f")).select(*_kept(raw), "package", "dep", "f.*")
    return _audited(first, "yarn_audit", F.col("dep"), F.col("title"))


SARIF = "struct<runs:array<struct<artifacts:array<struct<location:struct<uri:string>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,index:int>,region:struct<startLine:int>>>>>>>>>"


def sarif(raw: DataFrame) -> DataFrame:
    """Findings of SARIF documents: runs, results, locations; an index names an artifact of its own run. error is ERROR, note and
    none are INFO, all else WARNING; absolute paths keep their last part."""
    runs = raw.select(F.explode(F.from_json("doc", SARIF)["runs"]).alias("run"))
    results = runs.select(F.col("run.artifacts").alias("a"), F.explode("run.results").alias("r"))
    rows = results.select("a", "r", F.explode("r.locations").alias("l")).select("a", "r", F.col("l.physicalLocation").alias("p"))
    uri = F.coalesce(F.col("p.artifactLocation.uri"), F.expr("try_element_at(a, p.artifactLocation.index + 1).location.uri"))
    clean = F.regexp_replace(uri, r"^file://", "")
    path = F.when(F.startswith(clean, F.lit("/")), F.regexp_extract(clean, r"([^/]*)$", 1)).otherwise(clean)
    level = F.when(F.col("r.level") == "error", "ERROR").when(F.col("r.level").isin("note", "none"), "INFO").otherwise("WARNING")
    return rows.select(path.alias("path"), F.coalesce("p.region.startLine", F.lit(1)).alias("line"), level.alias("severity"), F.col("r.ruleId").alias("check_id"), F.col("r.message.text").alias("message")).where("path IS NOT NULL")


def under(path: Column, root: str) -> Column:
    """A path below the folder that a tool ran in, as one relative to it; others stay."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path) if root else path


def scanner_findings(raw: DataFrame, reliable, root: str = "") -> DataFrame:
    """Results with a line, and parse errors with one in files of languages that the scanner reads well (reliable: a predicate
    over the path). root: the folder that the scanner ran in, taken off paths, and off the path in an error's message."""
    j = raw.select(F.try_parse_json("doc").alias("j"))
    every = lambda place: j.select(F.explode(F.try_variant_get("j", place, "array<variant>")).alias("x")).select("x", F.coalesce(F.try_variant_get("x", "$.path", "string"), F.lit("")).alias("raw"))
    get = lambda place, other="": F.coalesce(F.nullif(F.try_variant_get("x", place, "string"), F.lit("")), F.lit(other))
    found = every("$.results").select(under(F.col("raw"), root).alias("path"), F.try_variant_get("x", "$.start.line", "int").alias("line"), get("$.extra.severity", "WARNING").alias("severity"), get("$.check_id").alias("check_id"), get("$.extra.message").alias("message"))
    said, at = _stripped(get("$.message", "Semgrep parsing/syntax error")), under(F.col("raw"), root)
    place = F.instr(said, F.col("raw"))
    said = F.when((F.col("raw") != "") & (place > 0), F.concat(F.substring(said, F.lit(1), place - 1), at, F.substring(said, place + F.length("raw"), F.length(said)))).otherwise(said)
    broken = every("$.errors").select(at.alias("path"), F.try_variant_get("x", "$.spans[0].start.line", "int").alias("line"), F.lit("ERROR").alias("severity"), F.lit("semgrep-parse-error").alias("check_id"), said.alias("message"))
    return found.unionByName(broken.where(reliable(F.col("path")))).where("line IS NOT NULL")


def rekeyed(reported: DataFrame, known: DataFrame) -> DataFrame:
    """Reported paths as known ones: equal, or ending in one after a slash; the first known by seq wins. Equal base names make the
    hash join, the ending is what is left to test. Where nothing at all matches, reported paths stay."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    hits = reported.select("path").distinct().withColumn("b", base(F.col("path"))).join(known.select(F.col("path").alias("key"), "seq", base(F.col("path")).alias("b")), "b").where((F.col("path") == F.col("key")) | F.endswith("path", F.concat(F.lit("/"), "key")))
    best = hits.groupBy("path").agg(F.min_by("key", "seq").alias("key"))
    any_hit = best.agg((F.count(F.lit(1)) > 0).alias("any_hit"))
    return reported.join(best, "path", "left").crossJoin(F.broadcast(any_hit)).where("key IS NOT NULL OR NOT any_hit").withColumn("path", F.coalesce("key", "path")).drop("key", "any_hit")


def scan_key(tool: str, content: Column) -> Column:
    """The key of a scanner's cached result: of the tool and the content, not of the path."""
    return F.sha2(F.concat(F.lit(tool), content), 256)


def lint_key(linter: Column, content: Column) -> Column:
    """The key of a linter's cached result; null without a linter."""
    return F.sha2(F.concat(F.lit("linter:"), linter, F.lit(":"), content), 256)


def analysis_key(repo: Column, commit: Column, suite: Column, languages: Column) -> Column:
    """The key of a repository's cached analysis, of its languages in order."""
    return F.sha2(F.concat(F.lit("codeql:"), repo, F.lit(":"), commit, F.lit(":"), suite, F.lit(":"), F.array_join(F.array_sort(F.array_distinct(languages)), ",")), 256)


def wanted_runs(files: DataFrame) -> DataFrame:
    """(review_id, path, linter, tool) of the runs that files (review_id, path, content) need; files without content need none."""
    runs = F.create_map(*(x for k, v in RUNS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = files.where("content <> ''").select("review_id", "path", linter_of(F.col("path")).alias("linter")).where("linter IS NOT NULL")
    return rows.select("review_id", "path", "linter", F.explode(F.coalesce(F.try_element_at(runs, F.col("linter")), F.array("linter"))).alias("tool"))


def linted(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Issues of files by reports of the tools that they need: (review_id, path, tool, stdout, stderr, rc) rows, which whoever
    runs tools gives; other rows are not read, and a tool without a report has no issues. Where several tools read a script,
    the first of equal (line, rule_id) stays, in the order of the tools. Issues of audits are the package file's."""
    held = written(wanted_runs(files).join(reports, ["review_id", "path", "tool"]), "lint-reports")
    packages = files.where("path = 'package.json' AND content <> ''").select("review_id", F.col("content").alias("package"))
    order = {t: i for v in RUNS.values() for i, t in enumerate(v)}
    names = ["review_id", "path", "line", "message", "severity", "rule_id", "source"]
    parts = [issues(held.where(F.col("tool") == t), t).select(*names, "linter", F.lit(order.get(t, 0)).alias("seq")) for t in (*TOOLS, *XML, "json_tool") if t != "pylint"]
    out = reduce(DataFrame.unionByName, parts)
    scripts = F.col("linter").isin("eslint", "ts")
    first = out.where(scripts).groupBy("review_id", "path", "line", "rule_id").agg(F.min_by(F.struct("message", "severity", "source"), F.struct("seq", "message")).alias("f"))
    out = out.where(~scripts).select(*names).unionByName(first.select("review_id", "path", "line", "rule_id", "f.*"))
    for tool in ("npm_audit", "yarn_audit"):
        out = out.unionByName(issues(held.where(F.col("tool") == tool).join(packages, "review_id"), tool).withColumn("path", F.lit("package.json")).select(*names))
    return out


def accepted_runs(runs: DataFrame) -> DataFrame:
    """Of a scanner's attempts (run_id, attempt, rc, doc) the one that counts: the first, but the next one where it failed (rc is
    neither 0 nor 1); a second that failed too counts as it is."""
    return runs.where("attempt <= 2").groupBy("run_id").agg(F.min_by(F.struct("attempt", "rc", "doc"), F.when(F.col("attempt") == 1, F.when(F.col("rc").isin(0, 1), 0).otherwise(2)).otherwise(1)).alias("r")).select("run_id", "r.*")
