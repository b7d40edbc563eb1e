"""Line rules as data.

A pattern is a regular expression searched in one source line; one issue per (rule, line).  ``needs`` is a
literal that every match of the pattern must contain (``needs_folded``: once lower-cased; its letters have no
special case pairs in Unicode): a cheap byte search that keeps the regex engine off most lines.  ``Pack`` fixes the order of issues within a file: ``check`` is the pack's position in the run,
``by_line`` says whether the pack lists line by line (True) or pattern by pattern (False).
"""

from __future__ import annotations

from dataclasses import dataclass

from codegauge.constants import JS_INVENTED_METHODS, JS_VULNERABLE_PACKAGES, MAX_LINE_LENGTH


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    severity: str
    message: str
    pattern: str | None = None
    suggestion: str | None = None
    needs: str | None = None
    needs_folded: str | None = None  # same, looked for in the lower-cased line
    contains_any: tuple[str, ...] = ()  # plain text alternatives instead of a pattern
    longer_than: int | None = None  # line length rule instead of a pattern


@dataclass(frozen=True)
class Pack:
    name: str
    category: str
    check: int
    rules: tuple[LineRule, ...]
    by_line: bool = False
    skip_comments: tuple[str, ...] = ()  # trimmed line prefixes that exempt a line


_FOLDED = {r"(?i)raise NotImplementedError": "rror"}


def _pack(name, category, check, rows, by_line=False, skip_comments=(), suggestion=None):
    rules = tuple(
        LineRule(f"{name}.{i + 1}", sev, msg, pat, rest[1] if len(rest) > 1 else suggestion, rest[0] if rest else None,
                 _FOLDED.get(pat))
        for i, (sev, msg, pat, *rest) in enumerate(rows)
    )
    return Pack(name, category, check, rules, by_line, tuple(skip_comments))


# --- fixed values: the patterns, severities and texts below define the results ------------------------------

SECRETS = _pack("line_secrets", "security", 1, [
    ("high", "Hardcoded password", r"""(?i)(password|passwd|pwd)\s*=\s*["'][^"']+(["'])""", "="),
    ("high", "Hardcoded API key", r"""(?i)(api_key|apikey|api-key)\s*=\s*["'][^"']+(["'])""", "="),
    ("high", "Hardcoded secret/token", r"""(?i)(secret|token)\s*=\s*["'][^"']+(["'])""", "="),
    ("high", "Hardcoded AWS credentials", r"""(?i)(aws_access_key|aws_secret)\s*=\s*["'][^"']+(["'])""", "="),
], suggestion="Use environment variables or secret management")

PATH_TRAVERSAL = _pack("line_path_traversal", "security", 3, [
    ("high", "Potential path traversal via f-string in open()", r"""open\s*\(\s*f["']""", "open"),
    ("high", "Path traversal: '..' in file path", r"""open\s*\(\s*["'].*\.\.""", "open"),
    ("high", "Potential path traversal via f-string in Path()", r"""Path\s*\(\s*f["']""", "Path"),
])

_SSRF = "SSRF risk: user-controlled URL via f-string"
SSRF = _pack("line_ssrf", "security", 4, [
    ("high", _SSRF, r"""requests\.(get|post|put|delete|patch)\s*\(\s*f["']""", "requests."),
    ("high", _SSRF, r"""urllib\.request\.urlopen\s*\(\s*f["']""", "urllib.request.urlopen"),
    ("high", _SSRF, r"""httpx\.(get|post)\s*\(\s*f["']""", "httpx."),
])

DESERIALIZATION = _pack("line_deserialization", "security", 5, [
    ("critical", "yaml.load() without Loader is unsafe, use yaml.safe_load()", r"yaml\.load\s*\(", "yaml.load"),
    ("critical", "yaml.load with Loader=None is unsafe", r"yaml\.load\s*\([^)]*\bLoader\s*=\s*None\b", "yaml.load"),
    ("critical", "pickle.load() can execute arbitrary code, use json instead", r"pickle\.load\s*\(", "pickle.load"),
    ("critical", "pickle.loads() can execute arbitrary code", r"pickle\.loads\s*\(", "pickle.loads"),
])

INTERNAL_URL = _pack("line_internal_url", "security", 6, [
    ("medium", "Hardcoded internal URL detected",
     r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|10\.\d+|192\.168\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+)", "://"),
])

PLACEHOLDERS = _pack("line_placeholders", "hallucination", 9, [
    ("low", "Unimplemented TODO suggests incomplete AI code", r"(?i)# TODO: implement", "# "),
    ("low", "Placeholder comment suggests incomplete AI code", r"(?i)# Your code here", "# "),
    ("low", "Placeholder code", r"(?i)pass\s*# placeholder", "# "),
    ("low", "Unimplemented method", r"(?i)raise NotImplementedError", " "),
    ("low", "Ellipsis comment suggests incomplete code", r"(?i)# ...", "# "),  # the dots match any character
], by_line=True, suggestion="Complete the implementation or remove placeholder")

LONG_LINES = Pack("line_too_long", "best_practices", 25, (
    LineRule("line_too_long", "low", "Line too long ({n} chars)",
             suggestion=f"Break line to max {MAX_LINE_LENGTH} characters", longer_than=MAX_LINE_LENGTH),
))

SQL_STRINGS = _pack("line_sql_strings", "security", 7, [
    ("high", "Potential SQL injection in string", r"""execute\s*\(\s*f["']""", "execute"),
    ("high", "Potential SQL injection in string", r"""execute\s*\(\s*["'].*%s.*["'].*%""", "execute"),
    ("high", "Potential SQL injection in string", r"""\+\s*["'].*SELECT""", "SELECT"),
    ("high", "Potential SQL injection in string", r"""f["'].*SELECT.*\{""", "SELECT"),
])

JS_SECURITY = _pack("js_security", "security", 1, [
    ("critical", "eval() can execute arbitrary code", r"\beval\s*\(", "eval", "Avoid eval(). Use JSON.parse() for JSON."),
    ("high", "innerHTML assignment can lead to XSS", r"\.innerHTML\s*=", ".innerHTML", "Use textContent or DOMPurify."),
    ("high", "document.write() can lead to XSS", r"document\.write\s*\(", "document.write", "Use DOM manipulation methods."),
    ("high", "setTimeout with string executes code", r"""setTimeout\s*\(\s*["']""", "setTimeout",
     "Use setTimeout(() => {...}, delay)."),
    ("high", "Hardcoded secret detected", r"""(?i)(password|api_key|secret)\s*[=:]\s*["'][^"']+(["'])""", None,
     "Use environment variables."),
    ("critical", "__proto__ manipulation", r"__proto__\s*[=:]", "__proto__", "Use Object.create(null)."),
    ("critical", "Command injection risk", r"child_process\.exec\s*\(", "child_process.exec", "Use execFile() or spawn()."),
    ("medium", "@ts-ignore bypasses type checking", r"@ts-ignore", "@ts-ignore", "Fix the type error instead."),
], by_line=True, skip_comments=("//", "/*", "*"))

JS_VULNERABLE_DEPS = Pack("js_vulnerable_deps", "security", 2, tuple(
    LineRule(f"js_vulnerable_deps.{i + 1}", "high", f"Vulnerable dependency: {warning}",
             contains_any=(f"'{name}'", f'"{name}"'))
    for i, (name, warning) in enumerate(JS_VULNERABLE_PACKAGES)
), by_line=True)

JS_INVENTED_CALLS = Pack("js_fake_methods", "hallucination", 4, tuple(
    LineRule(f"js_fake_methods.{i + 1}", sev, f"Method '{name}()' may not exist",
             r"\." + name.split(".")[-1] + r"\s*\(", f"Use {alt}", "." + name.split(".")[-1])
    for i, (name, sev, alt) in enumerate(JS_INVENTED_METHODS)
))

JS_ENDPOINTS = _pack("js_placeholder_endpoints", "hallucination", 5, [
    ("high", "Placeholder API URL", r"""["']https?://your-api""", "://your-api"),
    ("high", "Example API URL", r"""["']https?://api\.example""", "://api.example"),
], by_line=True, suggestion="Replace with real API endpoint")

JS_LOGIC = _pack("js_logic", "logic", 6, [
    ("high", "Infinite loop without break", r"while\s*\(\s*true\s*\)\s*\{(?![^}]*break)", "while"),
    ("high", "Infinite for loop", r"for\s*\(\s*;\s*;\s*\)", "for"),
    ("low", "Async without error handling", r"await\s+\w+\s*;(?![^;]*catch)", "await"),
], by_line=True)

JS_STYLE = _pack("js_best_practices", "best_practices", 7, [
    ("info", "Use let or const instead of var", r"\bvar\s+\w+", "var"),
    ("medium", "Use === instead of ==", r"==\s*[^=]", "=="),
    ("info", "Remove console statements", r"console\.(log|debug|info)", "console."),
], by_line=True, skip_comments=("//",))

# Invented packages in import lines: one issue per match, found by JS_IMPORT and looked up by name.
JS_IMPORT = r"""(?:import|require)\s*\(?['"]([^'"]+)['"]"""
JS_IMPORT_CHECK = 3
JS_IMPORT_SKIP = ("//", "/*")

# Symbols of a JavaScript text: default imports, named imports, functions, classes.
JS_IMPORT_DEFAULT = r"""import\s+(\w+)\s+from\s*["']([^"']+)["']"""
JS_IMPORT_NAMED = r"""import\s+\{([^}]+)\}\s+from\s*["']([^"']+)["']"""
JS_FUNCTION = r"function\s+(\w+)\s*\(([^)]*)\)"
JS_CLASS = r"class\s+(\w+)(?:\s+extends\s+(\w+))?\s*\{"

# --- packs in run order -------------------------------------------------------------------------------------

PYTHON_PACKS = (SECRETS, PATH_TRAVERSAL, SSRF, DESERIALIZATION, INTERNAL_URL, PLACEHOLDERS, LONG_LINES)
JS_PACKS = (JS_SECURITY, JS_VULNERABLE_DEPS, JS_INVENTED_CALLS, JS_ENDPOINTS, JS_LOGIC, JS_STYLE)
OPT_IN_PACKS = (SQL_STRINGS,)
