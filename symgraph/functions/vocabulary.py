"""Fixed values of the code-graph model."""

CANONICAL_KINDS = ["calls", "imports", "interaction", "component_use", "type_ref", "global_ref", "new_call", "extends", "implements", "inherits", "instantiates", "re_export"]
RECEIVER_KINDS = ["method_call", "MEMBER_ACCESS"]
RECEIVER_CONFIDENCE = 0.5
STOP_WORDS = ["a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "with", "by", "of", "from", "system", "feature", "code", "run", "user", "users", "use", "using", "used"]
HIGH_VALUE_TOKENS = ["notification", "notifications", "judge", "awareness", "cursor", "execution", "auth", "authentication", "collaborate", "collaboration", "sync", "presence", "websocket", "realtime", "api"]
CONCEPTS = {
    "auth": ["auth", "oauth", "login", "logout", "session", "signin", "signup", "supabase"],
    "realtime": ["websocket", "awareness", "yjs", "collaboration", "collaborative", "room", "broadcast", "presence"],
    "notifications": ["notification", "notify", "toast", "alert"],
    "database": ["postgres", "supabase", "prisma", "storage", "sqlite", "database", "db"],
}
CALLABLE_KINDS = ["function", "method", "route", "endpoint", "lambda", "macro"]
TYPE_KINDS = ["class", "interface", "struct", "enum", "type"]
LOCAL_KINDS = ["variable", "local", "parameter", "field", "property", "import"]
CONSTANT_KINDS = ["constant"]
#: Fixed: kinds that never enclose a reference; kinds whose references stay open without a candidate.
NOT_ENCLOSING_KINDS = ["variable", "constant", "parameter", "local", "property", "field", "import"]
DYNAMIC_KINDS = ["method_call", "MEMBER_ACCESS", "annotation", "generic_constraint"]
#: Fixed: other names of subsystems, and prefixes that their names lose.
SUBSYSTEM_ALIASES = {
    "auth": ["authentication", "authenticate", "login", "signin", "signup"],
    "database": ["database", "db", "postgres", "sql"],
    "api": ["api", "routes", "endpoints"],
    "ui": ["ui", "components", "frontend", "views"],
    "utils": ["utils", "helpers", "common", "shared"],
    "config": ["cfg", "config", "configuration"],
}
SUBSYSTEM_PREFIXES = ["packages/", "features/", "src/", "app/"]
#: Fixed: parts of a path that raise a search score, and those that lower it.
PRODUCTION_PARTS = ["app", "src", "server", "backend", "core", "api"]
SCRATCH_PARTS = ["scratch", "sandbox", "tmp", "examples", "test", "tests"]
#: Fixed: why a stage of resolution failed, by whether it can be mended.
EXPECTED_REASONS = ["BuiltinClassification", "ExternalDependencyClassification", "StandardLibraryClassification", "RepositoryMatch", "LexicalScopeMatch", "VariableAssignment", "MultipleCandidates", "DynamicDispatch"]
UNRECOVERABLE_REASONS = ["DynamicPropertyAccess", "Reflection"]
#: Cost in cents of a million tokens by a part of the model's name; first match wins, else the last value.
MODEL_CENTS = [("claude", 300.0), ("gpt", 250.0), ("gemini", 150.0), ("qwen", 50.0)]
DEFAULT_CENTS = 300.0
#: Fixed: modules that count as Python's standard library.
PYTHON_STDLIB = """abc ast asynchat asyncio asyncore atexit base64 bdb binascii bisect builtins bz2 calendar cgi chunk cmath cmd code codecs codeop
collections colorsys compileall concurrent configparser contextlib contextvars copy copyreg csv ctypes curses dataclasses datetime dbm decimal difflib dis
distutils doctest email encodings enum errno filecmp fileinput fnmatch fractions ftplib functools gc getopt getpass gettext glob grp gzip hashlib heapq hmac
html http imaplib importlib inspect io ipaddress itertools json keyword linecache locale logging lzma mailbox marshal math mimetypes mmap multiprocessing
netrc numbers operator optparse os pathlib pdb pickle pickletools pkgutil platform pprint profile pstats pty pwd queue random re readline reprlib resource
runpy sched secrets select selectors shelve shlex shutil signal site smtplib socket socketserver sqlite3 ssl stat statistics string stringprep struct
subprocess sys sysconfig tarfile tempfile test textwrap threading time timeit tkinter token tokenize tomllib traceback tracemalloc types typing unicodedata
unittest urllib uuid venv warnings wave weakref webbrowser xml xmlrpc zipapp zipfile zipimport zlib zoneinfo _thread typing_extensions pydantic""".split()
#: Fixed: modules that Node has built in.
NODE_BUILTINS = """assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https
inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm
worker_threads zlib""".split()
#: Fixed: receivers that browsers and Node have built in.
JS_RECEIVERS = """console Math Object JSON Array String Number Boolean Symbol BigInt Promise Date RegExp Error Map Set WeakMap WeakSet WeakRef Proxy Reflect process
window document globalThis self global performance crypto navigator location history localStorage sessionStorage indexedDB setTimeout clearTimeout
setInterval clearInterval queueMicrotask requestAnimationFrame cancelAnimationFrame parseInt parseFloat isNaN isFinite encodeURIComponent
decodeURIComponent encodeURI decodeURI fetch Response Request Headers URL URLSearchParams Blob File FileReader FormData XMLHttpRequest WebSocket
EventSource Buffer TextEncoder TextDecoder AbortController AbortSignal MutationObserver IntersectionObserver ResizeObserver Event CustomEvent EventTarget
require module exports __dirname __filename""".split()
JS_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "vue", "svelte"]
#: Fixed: kinds of type bindings.
BINDING_KINDS = ["var_type", "return_type", "field_type", "alias", "assignment", "destructuring", "object_literal", "import_alias"]
