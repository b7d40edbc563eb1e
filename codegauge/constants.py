"""Fixed values of the scoring model.  Results depend on them, so they are stated plainly here."""

# Severity -> points taken off a category score.  "info" and unknown severities cost nothing.
SEVERITY_PENALTY = {"critical": 25, "high": 15, "medium": 8, "low": 3, "info": 0}

# Severity -> SARIF level / editor diagnostic number.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_DEFAULT_LEVEL = "warning"
DIAGNOSTIC_SEVERITY = {"critical": 1, "high": 1, "medium": 2, "low": 3, "info": 4}
DIAGNOSTIC_DEFAULT = 2

# Category key (as used in weights and scores) -> category name carried by its issues, in run order.
CATEGORY_OF_KEY = {
    "security": "security",
    "hallucinations": "hallucination",
    "logic": "logic",
    "best_practices": "best_practices",
}
DEFAULT_WEIGHTS = {"security": 2.0, "hallucinations": 2.5, "logic": 1.0, "best_practices": 0.5}
OVERRIDE_WEIGHT = 1.0  # an override that names no weight

BASE_SCORE = 100
PASS_SCORE = 60  # per-file pass flag
GATE_SCORE = 70  # run gate, when no min_score is given
CACHE_TTL_DAYS = 7
MAX_LINE_LENGTH = 100
MAX_FUNCTION_LENGTH = 50
MAX_NESTING_DEPTH = 4

# Directories never watched, and the extension -> language table.
EXCLUDED_DIRS = ["__pycache__", ".git", "venv", "node_modules"]
LANGUAGE_OF_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
}
DEFAULT_LANGUAGE = "python"

# Modules that never count as missing when a project import cannot be resolved.
NEVER_MISSING = ["os", "sys", "json", "re", "datetime", "typing", "collections", "pathlib"]

# Popular third-party packages treated as known.
POPULAR_PACKAGES = """
numpy pandas matplotlib scipy sklearn tensorflow torch keras requests flask django fastapi pydantic
pytest selenium beautifulsoup4 bs4 pillow PIL sqlalchemy celery redis pymongo boto3 click rich tqdm
polars pyarrow opencv cv2 scikit-learn xgboost lightgbm transformers huggingface_hub langchain openai
anthropic
""".split()

# Fixed value: the standard-library modules that scores are defined on, whatever interpreter runs.
STANDARD_LIBRARY = """
_thread abc aifc argparse array ast asynchat asyncio asyncore atexit audioop base64 bdb binascii binhex bisect
builtins bz2 calendar cgi cgitb chunk cmath cmd code codecs codeop collections colorsys compileall concurrent
configparser contextlib contextvars copy copyreg cProfile crypt csv ctypes curses dataclasses datetime dbm decimal
difflib dis distutils doctest email encodings enum errno faulthandler fcntl filecmp fileinput fnmatch fractions
ftplib functools gc getopt getpass gettext glob graphlib grp gzip hashlib heapq hmac html http imaplib imghdr imp
importlib inspect io ipaddress itertools json keyword lib2to3 linecache locale logging lzma mailbox mailcap marshal
math mimetypes mmap modulefinder multiprocessing netrc nis nntplib numbers operator optparse os ossaudiodev pathlib
pdb pickle pickletools pipes pkgutil platform plistlib poplib posix posixpath pprint profile pstats pty pwd
py_compile pyclbr pydoc queue quopri random re readline reprlib resource rlcompleter runpy sched secrets select
selectors shelve shlex shutil signal site smtpd smtplib sndhdr socket socketserver spwd sqlite3 ssl stat statistics
string stringprep struct subprocess sunau symtable sys sysconfig syslog tabnanny tarfile telnetlib tempfile termios
test textwrap threading time timeit tkinter token tokenize trace traceback tracemalloc tty turtle turtledemo types
typing unicodedata unittest urllib uu uuid venv warnings wave weakref webbrowser winreg winsound wsgiref xdrlib xml
xmlrpc zipapp zipfile zipimport zlib
""".split()

# Fixed value: the built-in names a bare call may use.
BUILTIN_NAMES = """
ArithmeticError AssertionError AttributeError BaseException BaseExceptionGroup BlockingIOError BrokenPipeError
BufferError BytesWarning ChildProcessError ConnectionAbortedError ConnectionError ConnectionRefusedError
ConnectionResetError DeprecationWarning EOFError Ellipsis EncodingWarning EnvironmentError Exception ExceptionGroup
False FileExistsError FileNotFoundError FloatingPointError FutureWarning GeneratorExit IOError ImportError
ImportWarning IndentationError IndexError InterruptedError IsADirectoryError KeyError KeyboardInterrupt LookupError
MemoryError ModuleNotFoundError NameError None NotADirectoryError NotImplemented NotImplementedError OSError
OverflowError PendingDeprecationWarning PermissionError ProcessLookupError PythonFinalizationError RecursionError
ReferenceError ResourceWarning RuntimeError RuntimeWarning StopAsyncIteration StopIteration SyntaxError
SyntaxWarning SystemError SystemExit TabError TimeoutError True TypeError UnboundLocalError UnicodeDecodeError
UnicodeEncodeError UnicodeError UnicodeTranslateError UnicodeWarning UserWarning ValueError Warning
ZeroDivisionError _IncompleteInputError __build_class__ __debug__ __doc__ __import__ __loader__ __name__ __package__
__spec__ abs aiter all anext any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex
copyright credits delattr dict dir divmod enumerate eval exec exit filter float format frozenset getattr globals
hasattr hash help hex id input int isinstance issubclass iter len license list locals map max memoryview min next
object oct open ord pow print property quit range repr reversed round set setattr slice sorted staticmethod str sum
super tuple type vars zip
""".split()

# Import names that look invented, then import names that look like real packages, then bare call
# names that look invented.  All are matched on the lower-cased name.
SUSPICIOUS_MODULE_PATTERNS = [
    r"^ai_", r"^smart_", r"^auto_", r"^quick_", r"^easy_", r"_v\d+$", r"^lib\d+", r".*_utils_.*",
]
LIKELY_REAL_PATTERNS = [
    r"^django", r"^flask", r"^fastapi", r"^py", r"^python", r"^google", r"^aws", r"^azure", r"^boto", r"^kubernetes",
]
SUSPICIOUS_CALL_PATTERNS = [
    r"^quick\w+", r"^fast\w+", r"^smart\w+", r"^auto\w+", r"^easy\w+", r"^simple\w+", r"_v\d+$", r"\d+$",
]

# Calls that are risky by name: (severity, message).
RISKY_CALLS = {
    "eval": ("critical", "Use of eval() can execute arbitrary code"),
    "exec": ("critical", "Use of exec() can execute arbitrary code"),
    "compile": ("high", "Compiling strings can execute arbitrary code"),
    "__import__": ("high", "Dynamic imports can be exploited"),
    "input": ("high", "In Python 2, input() evaluates code (use raw_input)"),
}

# Invented module name part -> real module, first match wins.
MODULE_ALTERNATIVES = [
    ("quick_sort", "sorted"),
    ("fast_hash", "hashlib"),
    ("smart_parser", "json"),
    ("easy_http", "requests"),
    ("ai_utils", "openai"),
    ("ml_helpers", "sklearn"),
    ("data_processor", "pandas"),
    ("text_analyzer", "nltk"),
]

# Parameter name parts -> kind of sample value, first match wins.
PARAM_KINDS = [
    ("string", ["name", "str", "text", "msg", "message"]),
    ("number", ["count", "num", "size", "length", "index"]),
    ("bool", ["is_", "has_", "flag", "enable"]),
    ("list", ["list", "items", "values", "data"]),
    ("dict", ["dict", "config", "options", "kwargs"]),
]

# JavaScript packages: invented ones with a real alternative, and ones with a known problem.
JS_INVENTED_PACKAGES = [
    ("node-fetch-common", "critical", "node-fetch or undici"),
    ("lodash-helpers", "critical", "lodash"),
    ("axios-extensions", "critical", "axios or axios-cache-adapter"),
    ("moment-plus", "critical", "moment or dayjs"),
    ("javascript-utils", "high", "Native JS or lodash"),
]
JS_VULNERABLE_PACKAGES = [
    ("event-stream", "Known malicious package"),
    ("lodash", "Versions < 4.17.21 vulnerable"),
]
JS_INVENTED_METHODS = [
    ("quickSort", "high", "array.sort(compareFn)"),
    ("unique", "high", "[...new Set(array)]"),
    ("capitalize", "medium", "str.charAt(0).toUpperCase() + str.slice(1)"),
    ("contains", "medium", "str.includes()"),
    ("findAll", "high", "querySelectorAll()"),
    ("addClass", "high", "element.classList.add()"),
    ("fetch.get", "high", "fetch(url)"),
    ("fetch.post", "high", "fetch(url, { method: \"POST\" })"),
]
