"""What the line rules must find, for the SQL side.

Fixed values, written out so that the SQL does not take its patterns from the engine: pack, place in the pack,
severity, category, message, suggestion, check number, whether issues go by line, pattern.
"""

from __future__ import annotations

_ENV = "Use environment variables or secret management"
_DONE = "Complete the implementation or remove placeholder"
_SSRF = "SSRF risk: user-controlled URL via f-string"
_QUERY = "Potential SQL injection in string"

LINE_RULES = [
    ("line_secrets", 0, "high", "security", "Hardcoded password", _ENV, 1, False, r"""(?i)(password|passwd|pwd)\s*=\s*["'][^"']+(["'])"""),
    ("line_secrets", 1, "high", "security", "Hardcoded API key", _ENV, 1, False, r"""(?i)(api_key|apikey|api-key)\s*=\s*["'][^"']+(["'])"""),
    ("line_secrets", 2, "high", "security", "Hardcoded secret/token", _ENV, 1, False, r"""(?i)(secret|token)\s*=\s*["'][^"']+(["'])"""),
    ("line_secrets", 3, "high", "security", "Hardcoded AWS credentials", _ENV, 1, False, r"""(?i)(aws_access_key|aws_secret)\s*=\s*["'][^"']+(["'])"""),
    ("line_path_traversal", 0, "high", "security", "Potential path traversal via f-string in open()", None, 3, False, r"""open\s*\(\s*f["']"""),
    ("line_path_traversal", 1, "high", "security", "Path traversal: '..' in file path", None, 3, False, r"""open\s*\(\s*["'].*\.\."""),
    ("line_path_traversal", 2, "high", "security", "Potential path traversal via f-string in Path()", None, 3, False, r"""Path\s*\(\s*f["']"""),
    ("line_ssrf", 0, "high", "security", _SSRF, None, 4, False, r"""requests\.(get|post|put|delete|patch)\s*\(\s*f["']"""),
    ("line_ssrf", 1, "high", "security", _SSRF, None, 4, False, r"""urllib\.request\.urlopen\s*\(\s*f["']"""),
    ("line_ssrf", 2, "high", "security", _SSRF, None, 4, False, r"""httpx\.(get|post)\s*\(\s*f["']"""),
    ("line_deserialization", 0, "critical", "security", "yaml.load() without Loader is unsafe, use yaml.safe_load()", None, 5, False, r"yaml\.load\s*\("),
    ("line_deserialization", 1, "critical", "security", "yaml.load with Loader=None is unsafe", None, 5, False, r"yaml\.load\s*\([^)]*\bLoader\s*=\s*None\b"),
    ("line_deserialization", 2, "critical", "security", "pickle.load() can execute arbitrary code, use json instead", None, 5, False, r"pickle\.load\s*\("),
    ("line_deserialization", 3, "critical", "security", "pickle.loads() can execute arbitrary code", None, 5, False, r"pickle\.loads\s*\("),
    ("line_internal_url", 0, "medium", "security", "Hardcoded internal URL detected", None, 6, False,
     r"https?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0|10\.\d+|192\.168\.\d+|172\.(?:1[6-9]|2\d|3[01])\.\d+)"),
    ("line_placeholders", 0, "low", "hallucination", "Unimplemented TODO suggests incomplete AI code", _DONE, 9, True, r"(?i)# TODO: implement"),
    ("line_placeholders", 1, "low", "hallucination", "Placeholder comment suggests incomplete AI code", _DONE, 9, True, r"(?i)# Your code here"),
    ("line_placeholders", 2, "low", "hallucination", "Placeholder code", _DONE, 9, True, r"(?i)pass\s*# placeholder"),
    ("line_placeholders", 3, "low", "hallucination", "Unimplemented method", _DONE, 9, True, r"(?i)raise NotImplementedError"),
    ("line_placeholders", 4, "low", "hallucination", "Ellipsis comment suggests incomplete code", _DONE, 9, True, r"(?i)# ..."),
    ("line_sql_strings", 0, "high", "security", _QUERY, None, 7, False, r"""execute\s*\(\s*f["']"""),
    ("line_sql_strings", 1, "high", "security", _QUERY, None, 7, False, r"""execute\s*\(\s*["'].*%s.*["'].*%"""),
    ("line_sql_strings", 2, "high", "security", _QUERY, None, 7, False, r"""\+\s*["'].*SELECT"""),
    ("line_sql_strings", 3, "high", "security", _QUERY, None, 7, False, r"""f["'].*SELECT.*\{"""),
    ("js_best_practices", 0, "info", "best_practices", "Use let or const instead of var", None, 7, True, r"\bvar\s+\w+"),
    ("js_best_practices", 1, "medium", "best_practices", "Use === instead of ==", None, 7, True, r"==\s*[^=]"),
    ("js_best_practices", 2, "info", "best_practices", "Remove console statements", None, 7, True, r"console\.(log|debug|info)"),
]
#: The packs with patterns that run on every Python text, in run order; the long-line rule has none.
TEXT_PACKS = ("line_secrets", "line_path_traversal", "line_ssrf", "line_deserialization", "line_internal_url", "line_placeholders")
