"""Scalar functions on columns: names, slugs, escaping, hashes and tests on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that mark security-sensitive names.
SECURITY_KEYWORDS = (
    "auth", "password", "token", "secret", "key", "hash", "crypt", "sign", "jwt", "oauth", "credential", "session", "cookie", "csrf", "permission",
    "role", "admin", "sudo",
)
#: Names that frameworks call (case-sensitive regular expressions).
ENTRY_NAMES = (
    r"^main$", r"^__main__$", r"^test_", r"^Test[A-Z]", r"^on_", r"^handle_", r"^handler$", r"^handle$", r"^lambda_handler$", r"^upgrade$",
    r"^downgrade$", r"^lifespan$", r"^get_db$", r"^on(Create|Start|Resume|Pause|Stop|Destroy|Bind|Receive)", r"^do(Get|Post|Put|Delete)$",
    r"^do_(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$", r"^log_message$", r"^(middleware|errorHandler)$",
    r"^ng(OnInit|OnChanges|OnDestroy|DoCheck|AfterContentInit|AfterContentChecked|AfterViewInit|AfterViewChecked)$",
    r"^(transform|writeValue|registerOnChange|registerOnTouched|setDisabledState)$",
    r"^(canActivate|canDeactivate|canActivateChild|canLoad|canMatch|resolve)$",
    r"^(componentDidMount|componentDidUpdate|componentWillUnmount|shouldComponentUpdate|render)$",
)
#: Decorators of frameworks, without regard to case.
DECORATORS_ANY_CASE = (
    r"app\.(get|post|put|delete|patch|route|websocket|on_event)", r"router\.(get|post|put|delete|patch|route)", r"blueprint\.(route|before_request|after_request)",
    r"(before|after)_(request|response)", r"click\.(command|group)", r"\w+\.(command|group)\b", r"(field|model)_(serializer|validator)",
    r"(celery\.)?(task|shared_task|periodic_task)", r"receiver", r"api_view", r"\baction\b", r"(override_settings|modify_settings)", r"(event\.)?listens_for",
    r"(Get|Post|Put|Delete|Patch|RequestMapping)Mapping", r"(Scheduled|EventListener|Bean|Configuration)", r"(Component|Injectable|Controller|Module|Guard|Pipe)",
    r"(Subscribe|Mutation|Query|Resolver)", r"@(Override|OnLifecycleEvent|Composable)", r"(HiltViewModel|AndroidEntryPoint|Inject)",
    r"\w+\.(tool|tool_plain|system_prompt|result_validator)\b", r"\w+\.(middleware|exception_handler|on_exception)\b", r"\w+\.route\b",
)
#: Decorators of frameworks whose case counts.
DECORATORS_EXACT_CASE = (r"pytest\.(fixture|mark)", r"(app|router)\.(get|post|put|delete|patch|use|all)\b", r"^tool\b")
#: Names that are run from outside and so are never dead code.
LIVE_NAMES = (
    "main", "__main__", "__init__", "__new__", "__call__", "__enter__", "__exit__", "setup", "teardown", "app", "create_app", "handler",
    "lambda_handler", "run", "start", "serve", "cli",
)
#: Words that name no community.
COMMON_WORDS = (
    "get", "set", "self", "init", "new", "create", "update", "delete", "add", "remove", "make", "build", "from", "to", "for", "with", "the", "and", "test",
    "main", "run", "do", "is", "has", "on", "of", "in", "at", "by", "my", "this", "that", "all", "none",
)
#: Colours of node kinds.
COLORS = {"File": "#6366f1", "Class": "#10b981", "Function": "#f59e0b", "Test": "#3b82f6", "Type": "#8b5cf6"}
OTHER_COLOR = "#6b7280"
TEST_FILE = r"([\\/]__tests__[\\/]|\.spec\.[jt]sx?$|\.test\.[jt]sx?$|[\\/]test_[^/\\]*\.py$)"
TEST_COMMUNITY = r"(?i)(^test[-/]|[-/]test([:/]|$)|it:should|describe:|spec[-/]|[-/]spec$)"
GIT_REF = r"^[A-Za-z0-9_.~^/@{}\-]+$"
SVN_REVISION = r"(?i)^r?\d+(:r?\d+|:HEAD|:BASE|:COMMITTED)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def make_qualified(kind="kind", file_path="file_path", parent="parent_name", name="name") -> Column:
    """File: its path; in a parent: ``path::Parent.name``; else ``path::name``."""
    kind, file_path, parent, name = map(_col, (kind, file_path, parent, name))
    return F.when(kind == "File", file_path).when(F.length(parent) > 0, F.concat(file_path, F.lit("::"), parent, F.lit("."), name)).otherwise(F.concat(file_path, F.lit("::"), name))


def sanitize_name(c, length: int = 256) -> Column:
    """Drop control characters below 0x20 other than tab and newline, then cut."""
    return F.substring(F.regexp_replace(_col(c), r"[\x00-\x08\x0B-\x1F]", ""), 1, length)


def escape_html(c) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("`", "&#96;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def to_slug(c) -> Column:
    """Lower case, runs of other characters become one dash, outer dashes go, at most 30 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 30)


def split_name(c) -> Column:
    """Words of a camelCase or snake_case name."""
    return F.filter(F.split(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1_$2"), r"[_\-.\s]+"), lambda w: w != "")


def split_identifier(c) -> Column:
    """Words of an identifier, joined by single spaces."""
    spaced = F.regexp_replace(_col(c), r"(\p{Ll})(?=\p{Lu})", "$1 ")
    return F.trim(F.regexp_replace(spaced, r"[_./\-\s]+", " "))


def community_slug(name, cid) -> Column:
    return F.concat(F.lit("community_"), _col(cid).cast("string"), F.lit("_"), F.lower(F.regexp_replace(_col(name), r"[^\p{L}\p{N}-]", "_")))


def text_hash(c) -> Column:
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def node_color(kind) -> Column:
    mapped = F.create_map(*(F.lit(x) for pair in COLORS.items() for x in pair))
    return F.coalesce(F.try_element_at(mapped, _col(kind)), F.lit(OTHER_COLOR))


def fmt_count(c) -> Column:
    return F.format_number(_col(c), 0)


def is_security_relevant(*cols) -> Column:
    """Whether any of the columns holds a security keyword, without regard to case."""
    pattern = "|".join(SECURITY_KEYWORDS)
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.lower(_col(c)).rlike(pattern), F.lit(False))
    return out


def is_test_file(path="file_path") -> Column:
    return _col(path).rlike(TEST_FILE)


def matches_entry_name(name="name") -> Column:
    return _col(name).rlike("|".join(f"(?:{p})" for p in ENTRY_NAMES))


def is_live_name(name="name") -> Column:
    lower = F.lower(_col(name))
    return lower.isin(*LIVE_NAMES) | lower.startswith("test")


def has_framework_decorator(extra="extra") -> Column:
    """``extra.decorators`` is a JSON string or an array of strings; one that a framework knows is enough."""
    extra = _col(extra)
    listed = F.from_json(F.get_json_object(extra, "$.decorators"), "array<string>")
    single = F.array(F.get_json_object(extra, "$.decorators"))
    decorators = F.coalesce(listed, single)
    any_case = "(?i)" + "|".join(f"(?:{p})" for p in DECORATORS_ANY_CASE)
    exact = "|".join(f"(?:{p})" for p in DECORATORS_EXACT_CASE)
    return F.coalesce(F.exists(decorators, lambda d: d.rlike(any_case) | d.rlike(exact)), F.lit(False))


def is_test_name(name, role: str) -> Column:
    """Naming conventions of tests; role is ``function`` or ``class``."""
    name = _col(name)
    if role == "function":
        return name.startswith("test_") | name.startswith("Test") | name.endswith("_test") | name.endswith("_spec")
    if role == "class":
        return name.startswith("Test") | name.endswith("Test") | name.endswith("Tests") | name.endswith("TestCase") | name.endswith("Spec")
    return F.lit(False)


def json_or_empty(c) -> Column:
    """The JSON text, or ``{}`` where it is missing or malformed."""
    c = _col(c)
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.lit("{}"))


def is_valid_git_ref(c) -> Column:
    return _col(c).rlike(GIT_REF)


def is_valid_svn_revision(c) -> Column:
    return _col(c).rlike(SVN_REVISION)


def like_pattern(text: str) -> str:
    """A user's text for ILIKE as it stands: % and _ stay wildcards, a backslash is an ordinary character."""
    return text.replace("\\", "\\\\")


def round4(c) -> Column:
    """Four decimals, half away from zero."""
    return F.round(_col(c) * 10000) / 10000


def cosine(a, b) -> Column:
    """Cosine similarity in double precision; 0 for different lengths or a zero vector."""
    a, b = _col(a), _col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)
