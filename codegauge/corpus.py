"""A code corpus with known answers, one file per row of the part table.

Row k of ``part`` becomes a source file made from template ``k % len(TEMPLATES)``.  Each template lists, by
hand, every issue its code must give: ``rule severity line | message``; a missing line is written ``-``.
The lists are what the SQL oracles join, so they never parse code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTENSION = {"python": "py", "javascript": "js", "typescript": "ts"}


@dataclass(frozen=True)
class Template:
    language: str
    code: str
    issues: tuple[tuple[str, str, int | None, str], ...]


def _t(code: str, issues: str = "", language: str = "python") -> Template:
    rows = []
    for row in issues.strip().splitlines():
        head, message = row.strip().split(" | ", 1)
        rule, severity, line = head.split()
        rows.append((rule, severity, None if line == "-" else int(line), message))
    return Template(language, code, tuple(rows))


def _js(code: str, issues: str = "") -> Template:
    return _t(code, issues, "javascript")


LONG_BODY = "".join(f"    step_{i}(job)\n" for i in "abcdefghijklmnopqrstuvwxyz")
WIDE = "x" * 90

TEMPLATES: tuple[Template, ...] = (
    # --- security, by tree
    _t('"""Doc."""\ncur.execute(f"SELECT * FROM t WHERE id = {key} LIMIT 1")\ncur.execute("SELECT %s" % key)\n'
       'cur.execute("SELECT %s", (key,))\n', """
       ast_sql_injection critical 2 | Potential SQL injection via f-string
       ast_sql_injection high 3 | Potential SQL injection via string formatting"""),
    _t('"""Doc."""\ndb.executemany(f"{sql}", rows)\nraw(f"x{y}", 1)\nrun_query(f"x{y}")\nexecute(sql, f"{y}")\n', """
       ast_sql_injection critical 2 | Potential SQL injection via f-string
       ast_sql_injection critical 3 | Potential SQL injection via f-string"""),
    _t('"""Doc."""\neval(text)\nexec(program)\ncompile(src, "m", "exec")\n__import__(mod)\nre.compile(rx)\ninput()\n', """
       ast_dangerous_call critical 2 | Use of eval() can execute arbitrary code
       ast_dangerous_call critical 3 | Use of exec() can execute arbitrary code
       ast_dangerous_call high 4 | Compiling strings can execute arbitrary code
       ast_dangerous_call high 5 | Dynamic imports can be exploited
       ast_dangerous_call high 6 | Compiling strings can execute arbitrary code
       ast_dangerous_call high 7 | In Python 2, input() evaluates code (use raw_input)"""),
    _t('"""Doc."""\nimport subprocess\nsubprocess.run(cmd, shell=True)\nsubprocess.call(cmd, shell=1)\n'
       'subprocess.run(cmd, shell=False)\nsubprocess.Popen(cmd, shell=True)\n', """
       ast_shell_true high 3 | subprocess with shell=True is vulnerable to injection
       ast_shell_true high 4 | subprocess with shell=True is vulnerable to injection"""),
    _t('"""Doc."""\nimport os\nos.system("ls")\nsystem(f(1))\n', """
       ast_os_system high 3 | os.system() is vulnerable to command injection
       ast_os_system high 4 | os.system() is vulnerable to command injection"""),
    # --- security, by line
    _t('"""Doc."""\nDB_PASSWORD = "hunter22"\napi_key = "sk-1"\nAWS_SECRET = "x"\nprint(DB_PASSWORD, api_key, AWS_SECRET)\n'
       'password = get("DB")\nprint(password)\n', """
       line_secrets.1 high 2 | Hardcoded password
       line_secrets.2 high 3 | Hardcoded API key
       line_secrets.3 high 4 | Hardcoded secret/token
       line_secrets.4 high 4 | Hardcoded AWS credentials"""),
    _t('"""Doc."""\nopen(f"/srv/{name}")\nopen("/srv/../etc/shadow")\nPath(f"{root}/x")\nopen("/srv/data")\n', """
       line_path_traversal.1 high 2 | Potential path traversal via f-string in open()
       line_path_traversal.2 high 3 | Path traversal: '..' in file path
       line_path_traversal.3 high 4 | Potential path traversal via f-string in Path()"""),
    _t('"""Doc."""\nrequests.get(f"https://{host}/v1")\nurllib.request.urlopen( f"http://{host}")\nhttpx.post(f\'{u}\')\n'
       'requests.head(f"https://{host}")\n', """
       line_path_traversal.1 high 3 | Potential path traversal via f-string in open()
       line_ssrf.1 high 2 | SSRF risk: user-controlled URL via f-string
       line_ssrf.2 high 3 | SSRF risk: user-controlled URL via f-string
       line_ssrf.3 high 4 | SSRF risk: user-controlled URL via f-string"""),
    _t('"""Doc."""\nyaml.load(stream, Loader=None)\nyaml.load(stream)\npickle.load(handle)\npickle.loads(blob)\n'
       'yaml.safe_load(stream)\n', """
       line_deserialization.1 critical 2 | yaml.load() without Loader is unsafe, use yaml.safe_load()
       line_deserialization.2 critical 2 | yaml.load with Loader=None is unsafe
       line_deserialization.1 critical 3 | yaml.load() without Loader is unsafe, use yaml.safe_load()
       line_deserialization.3 critical 4 | pickle.load() can execute arbitrary code, use json instead
       line_deserialization.4 critical 5 | pickle.loads() can execute arbitrary code"""),
    _t('"""Doc."""\ncall("http://localhost:80")\ncall("https://10.1.2.3/x")\ncall("http://172.20.0.1")\n'
       'call("http://172.40.0.1")\ncall("http://192.168.7.7/admin")\n', """
       line_internal_url.1 medium 2 | Hardcoded internal URL detected
       line_internal_url.1 medium 3 | Hardcoded internal URL detected
       line_internal_url.1 medium 4 | Hardcoded internal URL detected
       line_internal_url.1 medium 6 | Hardcoded internal URL detected"""),
    # --- hallucinations
    _t('"""Doc."""\nimport ai_helper_kit\nimport fast_parser_v3 as fp\nfrom lib77 import x\nimport my_utils_pack.sub\n'
       'import json, numpy\nfrom pathlib import Path\nimport django_extra\nimport leftpadlib\n', """
       ast_fake_import critical - | Import 'ai_helper_kit' appears to be hallucinated
       ast_fake_import critical - | Import 'fast_parser_v3' appears to be hallucinated
       ast_fake_import critical - | Import 'lib77.x' appears to be hallucinated
       ast_fake_import critical - | Import 'my_utils_pack.sub' appears to be hallucinated
       ast_unknown_import medium - | Import 'leftpadlib' is not in standard/popular packages"""),
    _t('"""Doc."""\nimport smart_one as tool\nimport json as tool\nimport os as sys_like\nimport quick_one as sys_like\n', """
       ast_fake_import critical - | Import 'quick_one' appears to be hallucinated"""),
    _t('"""Doc."""\nout = quick_merge(data)\nprint(out)\nprocess2(out)\nprocess2(out)\nsorted(out)\nobj.fast_sort(out)\n', """
       ast_undefined_call critical 2 | Function 'quick_merge' appears hallucinated (not defined or imported)
       ast_undefined_call critical 4 | Function 'process2' appears hallucinated (not defined or imported)
       ast_undefined_call critical 5 | Function 'process2' appears hallucinated (not defined or imported)"""),
    _t('"""Doc."""\nfrom kit import easy_get\nimport base64\nauto_run = None\n\n\ndef fast_hash(x):\n    """D."""\n    return x\n\n\n'
       'fast_hash(1)\neasy_get(2)\nauto_run(3)\nsimple_map(base64, kit)\n', """
       ast_unknown_import medium - | Import 'kit.easy_get' is not in standard/popular packages
       ast_undefined_call critical 15 | Function 'simple_map' appears hallucinated (not defined or imported)"""),
    _t('"""Doc."""\nx = 1  # TODO: implement later\nprint(x)  #no\nraise NotImplementedError\n# YOUR CODE HERE\nif x:\n'
       '    pass  # placeholder\n', """
       line_placeholders.1 low 2 | Unimplemented TODO suggests incomplete AI code
       line_placeholders.5 low 2 | Ellipsis comment suggests incomplete code
       line_placeholders.4 low 4 | Unimplemented method
       line_placeholders.2 low 5 | Placeholder comment suggests incomplete AI code
       line_placeholders.5 low 5 | Ellipsis comment suggests incomplete code
       line_placeholders.3 low 7 | Placeholder code
       line_placeholders.5 low 7 | Ellipsis comment suggests incomplete code
       ast_empty_block info 6 | Empty If block"""),
    # --- logic
    _t('"""Doc."""\n\n\ndef done(x):\n    """D."""\n    return x\n    print(x)\n    print(1)\n\n\ndef fail(x):\n    """D."""\n'
       '    if x:\n        raise ValueError\n        print(x)\n    else:\n        return 2\n        print(3)\n', """
       ast_unreachable medium 7 | Unreachable code after return
       ast_unreachable medium 8 | Unreachable code after return
       ast_unreachable medium 15 | Unreachable code after raise
       ast_unreachable medium 18 | Unreachable code after return"""),
    _t('"""Doc."""\nfor x in rows:\n    continue\n    print(x)\nelse:\n    print(1)\nwhile rows:\n    break\n    return_code()\n'
       'try:\n    raise KeyError\n    print(2)\nexcept KeyError:\n    raise\n    print(3)\nfinally:\n    print(4)\n', """
       ast_unreachable medium 4 | Unreachable code after continue
       ast_unreachable medium 9 | Unreachable code after break
       ast_unreachable medium 12 | Unreachable code after raise
       ast_unreachable medium 15 | Unreachable code after raise"""),
    _t('"""Doc."""\n\n\ndef pick(x):\n    """D."""\n    if x:\n        return 1\n    return 2\n'),
    _t('"""Doc."""\nwhile True:\n    poll()\nwhile True:\n    if ready():\n        break\nwhile 1:\n    poll()\n'
       'while True:\n    for row in rows:\n        raise OSError\n', """
       ast_infinite_loop high 2 | Potential infinite loop (while True with no exit)"""),
    _t('"""Doc."""\n\n\ndef outer():\n    """D."""\n    while True:\n        def inner():\n            """D."""\n            return 1\n'
       '    while True:\n        while True:\n            poll()\n', """
       ast_infinite_loop high 10 | Potential infinite loop (while True with no exit)
       ast_infinite_loop high 11 | Potential infinite loop (while True with no exit)"""),
    _t('"""Doc."""\ntotal = compute()\n_ = compute()\nused = 1\nprint(used)\ntotal = again()\na = b = 2\nprint(a)\nn += 1\n', """
       ast_unused_var low 6 | Variable 'total' is assigned but never used
       ast_unused_var low 7 | Variable 'b' is assigned but never used"""),
    _t('"""Doc."""\nif True:\n    go()\nif 0:\n    go()\nif "":\n    go()\nelif 5:\n    go()\nwhile False:\n    go()\nwhile None:\n    go()\n', """
       ast_const_if low 2 | If condition is always True
       ast_const_if low 4 | If condition is always False (body never executes)
       ast_const_if low 6 | If condition is always False (body never executes)
       ast_const_if low 8 | If condition is always True
       ast_const_while medium 10 | While condition is always False (loop never executes)
       ast_const_while medium 12 | While condition is always False (loop never executes)"""),
    _t('"""Doc."""\nif x:\n    pass\nfor i in x:\n    pass\nwhile x:\n    pass\nwith x:\n    pass\nif y:\n    pass\n    go()\n', """
       ast_empty_block info 2 | Empty If block
       ast_empty_block info 4 | Empty For block
       ast_empty_block info 6 | Empty While block
       ast_empty_block info 8 | Empty With block"""),
    _t('"""Doc."""\n\n\ndef _a():\n    pass\n\n\ndef _b():\n    ...\n\n\ndef _c():\n    "..."\n\n\ndef _d():\n    "text"\n\n\nasync def e():\n    pass\n', """
       ast_empty_function medium 4 | Function '_a' is empty
       ast_ellipsis_function medium 8 | Function '_b' has ellipsis body
       ast_ellipsis_function medium 12 | Function '_c' has ellipsis body"""),
    _t('"""Doc."""\nprint(x == x)\nprint(x != x)\nprint(x == y)\nprint(x == x == y)\nprint(x is x)\nprint(x.a == x.a)\n', """
       ast_redundant_compare low 2 | Redundant comparison: x == x
       ast_redundant_compare low 3 | Redundant comparison: x != x"""),
    # --- best practices
    _t('import os\n\n\ndef public():\n    return os\n\n\ndef _private():\n    return 1\n\n\nclass Thing:\n    kind = 1\n\n    def method(self):\n'
       '        """D."""\n        return self.kind\n', """
       ast_missing_docstring info 1 | Module is missing docstring
       ast_missing_docstring info 4 | Function 'public' is missing docstring
       ast_missing_docstring info 12 | Class 'Thing' is missing docstring
       ast_unused_var low 13 | Variable 'kind' is assigned but never used"""),
    _t('"""Doc."""\n\n\ndef getUserName():\n    """D."""\n\n\ndef HTTPServer2():\n    """D."""\n\n\nclass my_class:\n    """D."""\n\n\n'
       'class Good1:\n    """D."""\n\n\nmyVar = 1\nMAX_SIZE = 2\n_hidden = 3\nprint(myVar, MAX_SIZE, _hidden)\n', """
       ast_function_naming low 4 | Function 'getUserName' should use snake_case
       ast_function_naming low 8 | Function 'HTTPServer2' should use snake_case
       ast_class_naming low 12 | Class 'my_class' should use PascalCase
       ast_variable_naming low 20 | Variable 'myVar' should use snake_case"""),
    _t('"""Doc."""\n\n\ndef busy(job):\n    """D."""\n' + LONG_BODY + LONG_BODY, """
       ast_function_length medium 4 | Function 'busy' is too long (54 lines)"""),
    _t('"""Doc."""\nif a:\n    for b in a:\n        while b:\n            with b:\n                if c:\n                    go()\n'
       '                try:\n                    go()\n                except OSError:\n                    if d:\n                        go()\n', """
       ast_deep_nesting medium 6 | Deep nesting detected (depth: 5)
       ast_deep_nesting medium 8 | Deep nesting detected (depth: 5)
       ast_deep_nesting medium 11 | Deep nesting detected (depth: 6)"""),
    _t('"""Doc."""\nif a:\n    go(1)\nelif b:\n    go(2)\nelif c:\n    go(3)\nelif d:\n    go(4)\nelif e:\n    go(5)\n', """
       ast_deep_nesting medium 10 | Deep nesting detected (depth: 5)"""),
    _t('"""Doc."""\ntry:\n    go()\nexcept:\n    stop()\ntry:\n    go()\nexcept (KeyError, OSError):\n    stop()\n', """
       ast_bare_except high 4 | Bare 'except:' catches all exceptions including KeyboardInterrupt"""),
    _t('"""Doc."""\n\n\ndef add(item, into=[], seen={}, *, extra=[]):\n    """D."""\n    return item\n\n\n'
       'def keep(item, into=None, names=set()):\n    """D."""\n    return item\n\n\nsort(key=lambda x=[]: x)\n', """
       ast_mutable_default medium 4 | Mutable default argument in 'add'
       ast_mutable_default medium 4 | Mutable default argument in 'add'"""),
    _t('"""Doc."""\nprint("' + WIDE + '", 1)\nprint("' + WIDE[:80] + '", 22)\n', """
       line_too_long low 2 | Line too long (102 chars)"""),
    # --- whole files
    _t('def broken(:\n    token = "abc"\n', """
       syntax_error critical 1 | Syntax error"""),
    _t('x = (1,\n', """
       syntax_error critical 1 | Syntax error"""),
    _t('', """
       ast_missing_docstring info 1 | Module is missing docstring"""),
    _t('"""Doc."""\nclass Ünit:\n    """D."""\n\n\ndef größe(wert: int, self, *rest, name_text="x") -> list[int]:\n    """D."""\n'
       '    return [wert]\n', """
       ast_class_naming low 2 | Class 'Ünit' should use PascalCase
       ast_function_naming low 6 | Function 'größe' should use snake_case"""),
    _t('"""Helpers that add things up."""\nfrom os import path\nimport os.path as p, sys\n\n\nclass Store:\n    """Keeps totals."""\n\n'
       '    def load(self, file_name, items, count):\n        """Read a file."""\n        return path.join(p.sep, file_name, items, count)\n\n'
       '    def _hide(self):\n        return sys\n\n\ndef total(values, is_net=False):\n    """Sum."""\n    return sum(values) + is_net\n'),
    _t('"""Doc."""\nunused_total = 1\n', """
       ast_unused_var low 2 | Variable 'unused_total' is assigned but never used"""),
    # --- JavaScript and TypeScript
    _js("eval(code)\n// eval(code)\nel.innerHTML = x\ndocument.write(x)\nsetTimeout('go()', 5)\nsetTimeout(() => go(), 5)\n"
        "const o = { password: 'abc' }\n", """
       js_security.1 critical 1 | eval() can execute arbitrary code
       js_security.2 high 3 | innerHTML assignment can lead to XSS
       js_security.3 high 4 | document.write() can lead to XSS
       js_security.4 high 5 | setTimeout with string executes code
       js_security.5 high 7 | Hardcoded secret detected"""),
    _js("a.__proto__ = b\nchild_process.exec(cmd)\nx = 1 // @ts-ignore\n/* eval(x) */\n * eval(x)\n", """
       js_security.6 critical 1 | __proto__ manipulation
       js_security.7 critical 2 | Command injection risk
       js_security.8 medium 3 | @ts-ignore bypasses type checking"""),
    _js("const a = require('event-stream')\nconst b = require(\"lodash\")\nconst c = require('lodash-helpers/core')\n"
        "import 'moment-plus'\nimport d from 'moment-plus'\n// require('javascript-utils')\nrequire('javascript-utils');require('axios-extensions')\n", """
       js_vulnerable_deps.1 high 1 | Vulnerable dependency: Known malicious package
       js_vulnerable_deps.2 high 2 | Vulnerable dependency: Versions < 4.17.21 vulnerable
       js_fake_packages critical 3 | Package 'lodash-helpers' likely doesn't exist
       js_fake_packages critical 4 | Package 'moment-plus' likely doesn't exist
       js_fake_packages high 7 | Package 'javascript-utils' likely doesn't exist
       js_fake_packages critical 7 | Package 'axios-extensions' likely doesn't exist"""),
    _js("list.quickSort()\nlist.unique()\nword.capitalize ()\nset.contains(x)\nfetch.get(url)\ncache.post(url)\n// dom.findAll(x)\nbox.addClass('a')\n", """
       js_fake_methods.1 high 1 | Method 'quickSort()' may not exist
       js_fake_methods.2 high 2 | Method 'unique()' may not exist
       js_fake_methods.3 medium 3 | Method 'capitalize()' may not exist
       js_fake_methods.4 medium 4 | Method 'contains()' may not exist
       js_fake_methods.7 high 5 | Method 'fetch.get()' may not exist
       js_fake_methods.8 high 6 | Method 'fetch.post()' may not exist
       js_fake_methods.5 high 7 | Method 'findAll()' may not exist
       js_fake_methods.6 high 8 | Method 'addClass()' may not exist"""),
    _js("call('https://your-api.dev/x')\ncall(\"http://api.example.org\")\ncall('https://api.real.org')\n", """
       js_placeholder_endpoints.1 high 1 | Placeholder API URL
       js_placeholder_endpoints.2 high 2 | Example API URL"""),
    _js("while (true) { go() }\nwhile (true) { if (x) break }\nfor (;;) { go() }\nawait job;\nawait job; // then catch\n", """
       js_logic.1 high 1 | Infinite loop without break
       js_logic.2 high 3 | Infinite for loop
       js_logic.3 low 4 | Async without error handling"""),
    _t("var a = 1\nlet b = a\nif (a == b) { go() }\nif (a === b) { go() }\nconsole.log(a)\n// var x\nclass Box extends Base {\n"
       "function grow(n) { return n }\nimport Tool from 'toolkit'\nimport { one, two } from \"pair\"\n", """
       js_best_practices.1 info 1 | Use let or const instead of var
       js_best_practices.2 medium 3 | Use === instead of ==
       js_best_practices.2 medium 4 | Use === instead of ==
       js_best_practices.3 info 5 | Remove console statements""", "typescript"),
)


def code_files(part: DataFrame) -> DataFrame:
    """``file_id, path, language, code, template`` for every row of ``part``."""
    n = len(TEMPLATES)
    table = F.array(*[
        F.struct(F.lit(t.language).alias("language"), F.lit(t.code).alias("code"), F.lit(EXTENSION[t.language]).alias("ext"))
        for t in TEMPLATES
    ])
    template = F.pmod("p_partkey", F.lit(n)).cast("int")
    rows = part.select(F.col("p_partkey").alias("file_id"), template.alias("template"))
    return rows.withColumn("t", F.element_at(table, F.col("template") + 1)).select(
        "file_id", F.concat(F.lit("src/file_"), "file_id", F.lit("."), "t.ext").alias("path"),
        F.col("t.language").alias("language"), F.col("t.code").alias("code"), "template")


def sql_text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def template_files_sql() -> str:
    """CTE ``code_files`` for the SQL side: file, template, language, path (no code)."""
    rows = ", ".join(f"({i}, '{t.language}', '{EXTENSION[t.language]}')" for i, t in enumerate(TEMPLATES))
    return (f"templates(template, language, ext) AS (VALUES {rows}), code_files AS ("
            f"SELECT p_partkey AS file_id, t.template, t.language, 'src/file_' || p_partkey || '.' || ext AS path "
            f"FROM part JOIN templates t ON t.template = p_partkey % {len(TEMPLATES)})")


def expected_sql(*rules: str) -> str:
    """CTE ``expected``: the hand-listed issues of the given rules (prefix match on ``rule.`` packs), per file."""
    rows = [
        f"({i}, {sql_text(rule)}, {sql_text(sev)}, {'NULL' if line is None else line}, {sql_text(msg)})"
        for i, t in enumerate(TEMPLATES) for rule, sev, line, msg in t.issues
        if not rules or rule in rules or rule.split(".")[0] in rules
    ]
    return (f"{template_files_sql()}, listed(template, rule_id, severity, line, message) AS (VALUES {', '.join(rows)}), "
            "expected AS (SELECT file_id, rule_id, severity, CAST(line AS INTEGER) AS line, message "
            "FROM code_files JOIN listed USING (template))")
