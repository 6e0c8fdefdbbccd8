"""Queries over files: types, tests, risk, routing, languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from diffmill.functions import paths as p
from diffmill.plans import derived as d
from diffmill.plans.derived import sql


def _kind():
    return p.file_type(F.col("path"))


def _files(spark, sf):
    return d.files(spark, sf)


def _scored(spark, sf):
    rows = _files(spark, sf).withColumn("kind", _kind()).withColumn("parts", p.risk_parts(F.col("path"), F.col("content"), F.col("kind")))
    total = sum((F.col(f"parts.{n}") for n in ("path", "size", "database", "api", "security", "dangerous_ops", "crypto")), F.lit(0))
    return rows.select("doc_id", "path", "kind", "parts", total.alias("risk"))


def _routed(spark, sf):
    rows = _scored(spark, sf).withColumn("level", p.risk_level(F.col("risk")))
    return rows.withColumn("tools", F.array_sort(p.tools(F.col("kind"), F.col("level"), F.col("path"), p.is_test(F.col("path")))))


def _names():
    return F.array(F.concat(F.lit("f"), F.col("doc_id")), F.when(F.col("doc_id") % 7 == 0, "Verify_It").otherwise("other"))


PATHS = (
    "Dockerfile", "a/b.Dockerfile", "x/.gitignore", "main.tf", "README.md", "config/.env", ".env", "prod.env", ".env.example", "a.tar.gz", "Makefile", "bin/Makefile", "x.", "img/a.PNG", "src\\win\\a.PY", "src/latest_config.py",
    "tests/a.go", "app/contest/main.go", "protester.java", "src/test/java/A.java", "a/conftest.py", "x.spec.ts", "UserTests.cs", "a_spec.rb", "HttpTest.php", "e2e/run.js", "fixtures/x.json", "a/testdata/b", "app/api/users.ts", "src/controllers/x.js", "k.kts", "z.rs", "s.ps1", "noext",
)


def _paths(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate(PATHS)], "id int, path string")


VALUES = "pv AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(PATHS)) + ") t(id, path))"
NAME = "regexp_extract({p}, '([^/]*)/*$', 1)"
EXT = "regexp_extract(lower(" + NAME + r"), '^.+\.([^.]+)$', 1)"
inlist = lambda xs: ", ".join(f"'{x}'" for x in xs)


def kind_sql(path: str) -> str:
    low = f"trim(lower(replace({path}, '\\', '/')))"
    name, ext = NAME.format(p=low), EXT.format(p=low)
    infra = " OR ".join(f"ends_with({x}, '{i}')" for i in p.INFRA for x in (name, low))
    return f"CASE WHEN {infra} THEN 'infrastructure' WHEN {ext} IN ({inlist(p.CODE)}) THEN 'code' WHEN {ext} IN ({inlist(p.CONFIG)}) THEN 'config' WHEN {ext} IN ({inlist(p.DOCS)}) THEN 'documentation' WHEN {ext} IN ({inlist(p.ASSETS)}) THEN 'assets' WHEN {ext} = '' AND contains({low}, '/') THEN 'documentation' ELSE 'code' END"


def match_sql(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


def test_sql(path: str) -> str:
    low = f"trim(replace({path}, '\\', '/'))"
    return f"({match_sql(low, p.TEST_DIR)} OR {match_sql(low, p.TEST_ROOT)} OR {match_sql(NAME.format(p=low), p.TEST_NAME)})"


def map_sql(values: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


LINES = f"CASE WHEN content = '' THEN 0 ELSE len(regexp_extract_all(content, '{p.LINE_END}')) + CASE WHEN regexp_matches(content, '(?:{p.LINE_END})\\z') THEN 0 ELSE 1 END END"


def part_sql(pattern: str, points: int) -> str:
    return f"CASE WHEN kind IN ('code', 'config') AND {match_sql(f'substr(content, 1, {p.SAMPLE})', pattern)} THEN {points} ELSE 0 END"


SCORED = f"""k AS (SELECT doc_id, path, content, {kind_sql('path')} AS kind, {LINES} AS lines FROM fl),
s AS (SELECT doc_id, path, kind, CASE WHEN {match_sql('path', p.PATH_HIGH)} THEN 30 WHEN {match_sql('path', p.PATH_MEDIUM)} THEN 15 WHEN {match_sql('path', p.PATH_FRAMEWORK)} THEN 10 ELSE 0 END AS path_points,
  CASE WHEN kind NOT IN ('code', 'config', 'infrastructure') THEN 0 WHEN lines > 1000 THEN 10 WHEN lines > 500 THEN 5 ELSE 0 END AS size_points,
  {part_sql(p.DATABASE, 15)} AS database, {part_sql(p.API, 20)} AS api, {part_sql(p.SECURITY, 25)} AS security, {part_sql(p.DANGEROUS, 20)} AS dangerous_ops, {part_sql(p.CRYPTO, 15)} AS crypto FROM k),
r AS (SELECT *, CAST(path_points + size_points + database + api + security + dangerous_ops + crypto AS INTEGER) AS risk FROM s),
v AS (SELECT *, CASE WHEN risk >= 55 THEN 'critical' WHEN risk >= 35 THEN 'high' WHEN risk >= 15 THEN 'medium' ELSE 'low' END AS level, {test_sql('path')} AS is_test FROM r)"""
ENV = "NOT contains(lower(path), '.env.example') AND (ends_with(lower(path), '.env') OR contains(lower(path), '/.env'))"
TOOLS = f"CASE WHEN kind IN ('documentation', 'assets') THEN '' WHEN kind = 'code' THEN CASE WHEN level = 'low' OR is_test THEN 'linter' WHEN level = 'critical' THEN 'codeql,linter,semgrep' ELSE 'linter,semgrep' END WHEN is_test THEN '' WHEN kind = 'config' THEN CASE WHEN {ENV} OR level <> 'low' THEN 'semgrep' ELSE '' END ELSE 'semgrep' END"
SCANNED = "src/a.js,b/c.py,d.kt,e.java,f.txt,g.ts"

QUERIES = {
    "F1_file_type": lambda s, sf: _files(s, sf).select("doc_id", _kind().alias("file_type")),
    "F1_F2_hard_paths": lambda s, sf: _paths(s).select("id", _kind().alias("file_type"), p.is_test(F.col("path")).alias("is_test")),
    "F2_is_test": lambda s, sf: _files(s, sf).select("doc_id", p.is_test(F.col("path")).alias("is_test")),
    "T1_risk_parts": lambda s, sf: _scored(s, sf).select("doc_id", F.col("parts.path").alias("path_points"), F.col("parts.size").alias("size_points"), "parts.database", "parts.api", "parts.security", "parts.dangerous_ops", "parts.crypto", "risk"),
    "F3_risk_level": lambda s, sf: _scored(s, sf).select("doc_id", p.risk_level(F.col("risk")).alias("level")),
    "F4_U3_tools": lambda s, sf: _routed(s, sf).select("doc_id", F.array_join("tools", ",").alias("tools")),
    "F6_path_gate": lambda s, sf: d.files(s, sf).select("doc_id", "path").join(_routed(s, sf).where(F.array_contains("tools", "semgrep")).select("path"), "path", "left_semi").select("doc_id"),
    "F7_reviewed_files": lambda s, sf: _files(s, sf).where(~_kind().isin("documentation", "assets")).select("doc_id"),
    "F20_server_side": lambda s, sf: _files(s, sf).where(p.is_server_side(F.col("path"), F.col("content"))).select("doc_id").union(_paths(s).where(p.is_server_side(F.col("path"), F.lit(""))).selectExpr("-1L - id")),
    "F21_reliable_language": lambda s, sf: _paths(s).unionByName(_files(s, sf).selectExpr("CAST(doc_id + 1000 AS INT) AS id", "path")).select("id", p.is_reliable(F.col("path")).alias("reliable")),
    "F22_language": lambda s, sf: _files(s, sf).withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#!/usr/bin/env "), F.element_at(F.array(F.lit("python3"), F.lit("node"), F.lit("zsh"), F.lit("perl")), (F.col("doc_id") % 4 + 1).cast("int")), F.lit("\n"), F.col("content"))).otherwise(F.col("content"))).select("doc_id", p.language(F.col("path"), F.col("content")).alias("language")),
    "F23_scanner_languages": lambda s, sf: s.sql(f"SELECT posexplode(split('{SCANNED}', ',')) AS (pos, path)").select("pos", p.scanner_language(F.col("path")).alias("language")).where("language IS NOT NULL").groupBy("language").agg(F.min("pos").alias("pos")).select("language", F.expr("CAST(row_number() OVER (ORDER BY pos) AS INT)").alias("place")),
    "F25_sensitive_names": lambda s, sf: _files(s, sf).select("doc_id", p.has_sensitive_name(_names()).alias("sensitive")),
}
ORACLE = {
    "F1_file_type": sql("fl", f"SELECT doc_id, {kind_sql('path')} AS file_type FROM fl"),
    "F1_F2_hard_paths": f"WITH {VALUES} SELECT id, {kind_sql('path')} AS file_type, {test_sql('path')} AS is_test FROM pv",
    "F2_is_test": sql("fl", f"SELECT doc_id, {test_sql('path')} AS is_test FROM fl"),
    "T1_risk_parts": sql("fl", f"{SCORED} SELECT doc_id, path_points, size_points, database, api, security, dangerous_ops, crypto, risk FROM v"),
    "F3_risk_level": sql("fl", f"{SCORED} SELECT doc_id, level FROM v"),
    "F4_U3_tools": sql("fl", f"{SCORED} SELECT doc_id, {TOOLS} AS tools FROM v"),
    "F6_path_gate": sql("fl", f"{SCORED} SELECT doc_id FROM v WHERE contains({TOOLS}, 'semgrep')"),
    "F7_reviewed_files": sql("fl", f"SELECT doc_id FROM fl WHERE ({kind_sql('path')}) NOT IN ('documentation', 'assets')"),
    "F20_server_side": sql("fl", f"{VALUES} SELECT doc_id FROM fl WHERE {match_sql('path', p.SERVER_PATH)} OR {match_sql('content', p.SERVER_IMPORT)} UNION ALL SELECT -1 - id FROM pv WHERE {match_sql('path', p.SERVER_PATH)}"),
    "F21_reliable_language": sql("fl", f"{VALUES}, u AS (SELECT id, path FROM pv UNION ALL SELECT doc_id + 1000, path FROM fl) SELECT CAST(id AS INTEGER) AS id, coalesce(({map_sql(p.LANGUAGES, EXT.format(p='path'))}) IN ({inlist(p.RELIABLE)}), false) AS reliable FROM u"),
    "F22_language": sql("fl", f"SELECT doc_id, coalesce({map_sql(p.LANGUAGES, EXT.format(p='path'))}, CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'bash' END END) AS language FROM fl"),
    "F23_scanner_languages": "SELECT * FROM (VALUES ('javascript', 1), ('python', 2), ('java', 3)) t(language, place)",
    "F25_sensitive_names": "SELECT doc_id, doc_id % 7 = 0 AS sensitive FROM documents",
}
