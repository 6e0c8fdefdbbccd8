"""Scalar functions over paths and contents of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sets of extensions and names.
CODE = "py pyw js mjs cjs jsx ts tsx go java kt kts cpp cc cxx c h hpp hh cs rb swift php scala rs hs lua sh bash zsh ps1".split()
CONFIG = "yml yaml env json".split()
DOCS = "md txt rst adoc".split()
ASSETS = "png svg jpg jpeg gif ico webp woff woff2 ttf eot mp4 webm mp3 wav".split()
INFRA = ("dockerfile", ".dockerignore", ".gitignore", ".tf", ".tfvars")
LANGUAGES = {
    "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "tsx", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "java": "java",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "cs": "c_sharp", "php": "php", "rb": "ruby", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "hs": "haskell", "lua": "lua", "sh": "bash", "bash": "bash", "zsh": "bash", "ps1": "powershell",
}
RELIABLE = "python javascript typescript tsx go java ruby php c cpp c_sharp rust kotlin scala".split()
SCANNER_LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript", "go": "go", "java": "java", "kt": "java",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "swift": "swift",
}

# Patterns, all without regard to case; they hold in the dialects of Java and RE2 alike.
TEST_DIR = r"(?:^|/)(?:tests?|__tests__|__mocks__|spec|specs|testdata|fixtures?|e2e)(?:/|$)"
TEST_ROOT = r"(?:^|/)src/(?:test|androidtest)(?:/|$)"
TEST_NAME = r"^test_[^/]*\.py$|_test\.(?:py|go|rb)$|^conftest\.py$|\.(?:test|spec)\.[jt]sx?$|tests?\.(?:java|kt|cs)$|_spec\.rb$|test\.php$"
PATH_HIGH = r"(?:^|/)(?:auth|login|payment|admin|security|crypto|keys|secrets|oauth|session|billing|checkout)(?:/|$)"
PATH_MEDIUM = r"(?:^|/)(?:middleware|webhook|migration|permissions|rbac|acl|gateway|proxy|cert)(?:/|$)|(?:^|/)api/v[0-9]"
PATH_FRAMEWORK = r"(?:^|/)(?:routes|controllers|handlers|views)(?:/|$)"
SERVER_PATH = r"(?:^|/)(?:pages/api|app/api|src/routes|src/controllers|src/middleware|src/handlers)(?:/|$)"
SERVER_IMPORT = r"""from\s+['"]express['"]|require\s*\(\s*['"]express['"]\)|@nestjs/|from\s+['"]fastify['"]|from\s+['"]koa['"]|http\.createServer|app\.listen\s*\("""
WORD, EDGE = r"[\p{L}\p{N}_]", r"(?:^|[^\p{L}\p{N}_])"
AFTER = r"(?:[^\p{L}\p{N}_]|$)"
DATABASE = EDGE + r"(?:execute|cursor|query|sql|database|orm|raw\s*\()"
API = EDGE + r"(?:api|endpoint|route|request|flask|fastapi|express|app\.get|app\.post|router\.)"
SECURITY = EDGE + r"(?:password|token|crypto|secret|credential)" + AFTER
DANGEROUS = EDGE + r"(?:(?:eval|exec|subprocess|os\.system|os\.popen|pickle\.loads|innerHTML|dangerouslySetInnerHTML|__import__|deserialize)" + AFTER + r"|(?:yaml\.load|Function|compile)\s*\(" + WORD + ")"
CRYPTO = EDGE + r"(?:md5|sha1|ECB|DES|verify\s*=\s*False|CERTIFICATE_VERIFY_FAILED|ssl\._create_unverified_context)" + AFTER
SENSITIVE_NAMES = "auth verify validate encrypt decrypt login check_permission sanitize hash".split()
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Code points of a content that patterns see, a limit that the rules themselves have.
SAMPLE = 50_000


def found(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def let(value: Column, body) -> Column:
    """body of the value, which is evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(name: Column) -> Column:
    """The last extension without its dot; a name that only begins with a dot has none."""
    return F.regexp_extract(F.lower(name), r"^.+\.([^.]+)$", 1)


def file_type(path: Column) -> Column:
    p = F.trim(F.lower(slashes(path)))
    name = base_name(p)
    ext = extension(name)
    infra = F.lit(False)
    for x in INFRA:
        infra = infra | F.endswith(name, F.lit(x)) | F.endswith(p, F.lit(x))
    return (
        F.when(infra, "infrastructure").when(ext.isin(CODE), "code").when(ext.isin(CONFIG), "config").when(ext.isin(DOCS), "documentation").when(ext.isin(ASSETS), "assets")
        .when((ext == "") & F.contains(p, F.lit("/")), "documentation").otherwise("code")
    )


def is_test(path: Column) -> Column:
    p = F.trim(slashes(path))
    return found(p, TEST_DIR) | found(p, TEST_ROOT) | found(base_name(p), TEST_NAME)


def _language(values: dict, ext: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), ext)


def language(path: Column, content: Column) -> Column:
    """By extension, else by the interpreter of the first line."""
    first = F.trim(F.regexp_extract(content, r"^([^\n\r]*)", 1))
    bang = F.startswith(first, F.lit("#!"))
    shebang = F.when(bang & F.contains(first, F.lit("python")), "python").when(bang & first.rlike("node|deno"), "javascript").when(bang & F.contains(first, F.lit("sh")), "bash")
    return F.coalesce(_language(LANGUAGES, extension(base_name(path))), shebang)


def scanner_language(path: Column) -> Column:
    return _language(SCANNER_LANGUAGES, extension(base_name(path)))


def is_reliable(path: Column) -> Column:
    return F.coalesce(_language(LANGUAGES, extension(base_name(path))).isin(RELIABLE), F.lit(False))


def is_server_side(path: Column, content: Column) -> Column:
    return found(slashes(path), SERVER_PATH) | found(F.substring(content, 1, SAMPLE), SERVER_IMPORT)


def line_count(content: Column) -> Column:
    """Lines as a text is split at all line ends, without an empty one after the last."""
    pattern = F.lit(LINE_END)
    return F.when(content == "", 0).otherwise(F.regexp_count(content, pattern) + F.when(content.rlike(f"(?:{LINE_END})\\z"), 0).otherwise(1)).cast("int")


def risk_parts(path: Column, content: Column, kind: Column) -> Column:
    """The parts of a risk score as a struct."""
    p, sample, lines = slashes(path), F.substring(content, 1, SAMPLE), line_count(content)
    told = kind.isin("code", "config")

    def part(pattern: str, points: int) -> Column:
        return F.when(told & found(sample, pattern), points).otherwise(0)

    return F.struct(
        F.when(found(p, PATH_HIGH), 30).when(found(p, PATH_MEDIUM), 15).when(found(p, PATH_FRAMEWORK), 10).otherwise(0).alias("path"),
        F.when(~kind.isin("code", "config", "infrastructure"), 0).when(lines > 1000, 10).when(lines > 500, 5).otherwise(0).alias("size"),
        part(DATABASE, 15).alias("database"), part(API, 20).alias("api"), part(SECURITY, 25).alias("security"), part(DANGEROUS, 20).alias("dangerous_ops"), part(CRYPTO, 15).alias("crypto"),
    )


def risk_level(score: Column) -> Column:
    return let(score, lambda s: F.when(s >= 55, "critical").when(s >= 35, "high").when(s >= 15, "medium").otherwise("low"))


def tools(kind: Column, level: Column, path: Column, test: Column) -> Column:
    """Tools that a file is routed to. Tests keep the linter alone."""
    p = F.lower(slashes(path))
    env = ~F.contains(p, F.lit(".env.example")) & (F.endswith(p, F.lit(".env")) | F.contains(p, F.lit("/.env")))
    none = F.array().cast("array<string>")
    one = lambda *x: F.array(*(F.lit(v) for v in x))

    def by_level(v: Column) -> Column:
        code = F.when(v == "low", one("linter")).when(v == "critical", one("linter", "semgrep", "codeql")).otherwise(one("linter", "semgrep"))
        config = F.when(env | (v != "low"), one("semgrep")).otherwise(none)
        return let(kind, lambda k: F.when(k.isin("documentation", "assets"), none).when(k == "code", code).when(k == "config", config).otherwise(one("semgrep")))

    routed = let(level, by_level)
    return F.when(test, F.array_except(routed, one("semgrep", "codeql"))).otherwise(routed)


def diff_points(added: Column, deleted: Column, new_file: Column) -> Column:
    """Points of a diff's size: more for many added lines or a new file, fewer for one that mostly deletes."""
    size = F.when(added > 200, 8).when(added > 50, 5).when(added > 10, 3).otherwise(0)
    heavy = F.when((added + deleted > 0) & (deleted >= 0.8 * (added + deleted)), -5).otherwise(0)
    return size + F.when(new_file, 5).otherwise(0) + heavy


def has_sensitive_name(names: Column) -> Column:
    """Whether any of the names has one of the keywords in it."""
    return F.exists(names, lambda n: F.lower(n).rlike("|".join(SENSITIVE_NAMES)))
