"""Scalar functions over names, paths, URLs and properties: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviation and expansion, in pairs.
ABBREVIATIONS = """
err error, exc exception, ex exception, ctx context, cfg config, conf configuration, env environment, opt option,
opts options, req request, res response, resp response, rsp response, hdr header, hdrs headers, str string,
fmt format, msg message, txt text, lbl label, desc description, buf buffer, arr array, vec vector, lst list,
dict dictionary, tbl table, stk stack, que queue, fn function, func function, cb callback, proc procedure,
ctor constructor, dtor destructor, db database, col column, stmt statement, txn transaction, trx transaction,
repo repository, auth authentication, authz authorization, perm permission, cred credential, tok token,
pwd password, val value, num number, int integer, bool boolean, flt float, dbl double, idx index, iter iterator,
elem element, cnt count, len length, sz size, pos position, off offset, cap capacity, init initialize,
deinit deinitialize, alloc allocate, dealloc deallocate, del delete, rm remove, impl implementation,
iface interface, abs abstract, decl declaration, param parameter, arg argument, attr attribute, prop property,
ret return, src source, dst destination, tgt target, orig original, prev previous, cur current, tmp temporary,
temp temporary, conn connection, sess session, sock socket, addr address, url uniform, srv server, cli client,
svc service, ep endpoint, mgr manager, ctrl controller, hdlr handler, sched scheduler, disp dispatcher,
reg registry, chan channel, sem semaphore, mtx mutex, wg waitgroup, sig signal, evt event, sub subscriber,
pub publisher, spec specification, mock mock, stub stub, assert assertion, log logging, lvl level, dbg debug,
wrn warning, inf info, ts timestamp, dur duration, ttl timetolive, ver version, ns namespace, pkg package,
mod module, lib library, dep dependency, ref reference, ptr pointer, obj object, doc document, cmd command,
ops operations, util utility, hlp helper, ext extension
"""
#: Words that say nothing about a decorator.
DECORATOR_STOPWORDS = "get set new class method function value type param return public private for if the and or not with from app router".split()
#: Endings of configuration files.
CONFIG_EXTENSIONS = ".toml .ini .yaml .yml .cfg .properties .json .xml .conf .env".split()
#: Parts of the names of secrets.
SECRET_KEYS = "secret password passwd token api_key apikey private_key credential auth_token access_key client_secret signing_key encryption_key ssh_key deploy_key service_account bearer jwt_secret".split()
#: The forms of known secrets.
SECRET_VALUES = r"(?i)-----BEGIN|AKIA[A-Z0-9]{16}|sk-[A-Z0-9]{20}|ghp_[A-Z0-9]{36}|glpat-[A-Z0-9-]{20}|xox[bps]-[A-Z0-9-]"
#: Paths and names of tests.
TEST_PATH = r"(^|/)test_[^/]*$|_test\.(go|py|rs|cpp|lua)$|\.(test|spec)\.(ts|js|tsx)|Test\.(java|kt|cs|php)$|Spec\.scala$|__tests__/|(^|/)(tests|test|spec)/|_spec\.rb$"
TEST_NAME = r"^((Test|Benchmark|Example)([A-Z].*)?|test_.*|test[A-Z].*|test|it|describe|beforeAll|afterAll|beforeEach|afterEach|@testset|@test)$"
#: Bands of confidence.
BANDS = [("high", 0.7), ("medium", 0.45), ("speculative", 0.25)]
#: Risks by hop.
RISKS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def camel_split(c: Column) -> Column:
    """A blank between a lower and an upper case letter."""
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def identifier_tokens(c: Column) -> Column:
    """Lower-cased parts of a name, then the expansions of the abbreviations among them."""
    pairs = [x.split() for x in ABBREVIATIONS.replace("\n", " ").split(",")]
    to = F.create_map(*[F.lit(w) for p in pairs for w in p])
    spaced = F.regexp_replace(F.regexp_replace(c, r"[./_\- (),:]", " "), "([a-z])([A-Z])", "$1 $2")
    parts = F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9 ]", "")), " +"), lambda t: t != "")
    return F.concat(parts, F.filter(F.transform(parts, lambda t: to[t]), lambda t: t.isNotNull()))


def decorator_tokens(c: Column) -> Column:
    """The words of a decorator that say something, at least two letters long."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^@", ""), r"^#\[(.*)\]$", "$1"), r"\(.*$", "")
    words = F.split(F.lower(camel_split(F.regexp_replace(bare, r"[._:/\-]", " "))), " +")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(DECORATOR_STOPWORDS))


def config_key_norm(c: Column) -> Column:
    """snake_case of a configuration key."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(camel_split(F.regexp_replace(c, r"[_.\-]", " ")), " +", " ")), " ", "_"))


def is_env_var_name(c: Column) -> Column:
    return c.rlike("^[A-Z0-9_]{2,}$") & c.rlike("[A-Z]")


def has_config_extension(c: Column) -> Column:
    return F.regexp_extract(c, r"(\.[^./]*)$", 1).isin(CONFIG_EXTENSIONS)


def is_secret(key: Column, value: Column) -> Column:
    return F.coalesce(F.lower(key).rlike("|".join(SECRET_KEYS)), F.lit(False)) | F.coalesce(value.rlike(SECRET_VALUES), F.lit(False))


def glob_to_like(glob: str) -> str:
    """``**`` and ``*`` to ``%``, ``?`` to ``_``; directories between ``**/`` and ``/**`` match anywhere."""
    out = re.sub(r"^\*\*/(.*)/\*\*$", r"%\1%", glob) if re.fullmatch(r"\*\*/[^*]+/\*\*", glob) else re.sub(r"/\*\*$", "%", glob)
    return out.replace("**/", "%").replace("**", "%").replace("*", "%").replace("?", "_")


def regex_literals(pattern: str) -> list[str]:
    """Literal runs of at least three characters that every match holds; none if there is an alternative."""
    if "|" in pattern:
        return []
    bare = re.sub(r"\\[dwsDWSbB]|\[[^\]]*\]|\([^)]*\)|.[*?]|\{[^}]*\}", "\0", re.sub(r"^\(\?i\)", "", pattern))
    return [x for x in re.split(r"[\0.^$+()\\]+", bare) if len(x) >= 3]


def with_case(pattern: str, sensitive: bool) -> str:
    bare = re.sub(r"^\(\?i\)", "", pattern)
    return bare if sensitive else f"(?i){bare}"


def qn_package(c: Column) -> Column:
    """The third segment of a qualified name of four or more, else the second, else ''."""
    s = F.split(c, r"\.")
    return F.when(F.size(s) >= 4, F.get(s, F.lit(2))).when(F.size(s) >= 2, F.get(s, F.lit(1))).otherwise("")


def qn_top_package(c: Column) -> Column:
    s = F.split(c, r"\.")
    return F.when(F.size(s) >= 2, F.get(s, F.lit(1))).otherwise("")


def is_test_path(c: Column) -> Column:
    return F.coalesce(c.rlike(TEST_PATH), F.lit(False))


def is_test_file_path(c: Column) -> Column:
    """The form that reports use: fixtures in testdata/ count too."""
    return is_test_path(c) | F.coalesce(c.rlike(r"(^|/)testdata/"), F.lit(False))


def is_test_name(c: Column) -> Column:
    return F.coalesce(c.rlike(TEST_NAME), F.lit(False))


def test_to_prod_path(c: Column) -> Column:
    """The file that a test file tests, NULL if its name doesn't tell."""
    return (
        F.when(c.rlike(r"_test\.go$"), F.regexp_replace(c, r"_test\.go$", ".go"))
        .when(c.rlike(r"(^|/)test_[^/]*\.py$"), F.regexp_replace(c, r"(^|/)test_([^/]*\.py)$", "$1$2"))
        .when(c.rlike(r"[^/]*\.(test|spec)\.[^/]*$"), F.regexp_replace(c, r"\.(test|spec)\.([^/]*)$", ".$2"))
    )


def route_canon(c: Column) -> Column:
    """Every form of a path parameter to {}."""
    for pattern, to in ((r"\$\{[^}/]*\}?", "{}"), (r"\{[^}/]*\}?", "{}"), (r"<[^>/]*>?", "{}"), (r"(^|/):[A-Za-z0-9_]+", "$1{}")):
        c = F.regexp_replace(c, pattern, to)
    return c


def url_path(c: Column) -> Column:
    """What follows the third slash, with it, up to the query; '' if there are fewer slashes."""
    return F.regexp_extract(c, r"^[^/]*/[^/]*/[^/]*(/[^?]*)", 1)


def template_match(concrete: Column, template: Column) -> Column:
    """Segment by segment, a {} of the template standing for any non-empty one."""
    cut = lambda x: F.split(F.regexp_replace(F.regexp_replace(x, "^/", ""), "/+$", ""), "/")
    a, b = cut(concrete), cut(template)
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y) | (y.rlike(r"^\{.*\}$") & (x != "")), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda t: t)


def confidence_band(c: Column) -> Column:
    out = None
    for name, least in BANDS:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise("")


def risk(hop: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in RISKS]), F.least(F.greatest(hop.cast("int"), F.lit(1)), F.lit(4)))


def is_checked_exception(c: Column) -> Column:
    return ~c.rlike("Error|Panic")


def proximity(a: Column, b: Column) -> Column:
    """1 + 0.1 x shared leading directories / the deeper path's directories; 1 where a path is missing."""
    p, q = (F.slice(F.split(x, "/"), 1, F.size(F.split(x, "/")) - 1) for x in (a, b))
    deep = F.greatest(F.size(p), F.size(q))
    same = F.zip_with(p, q, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    shared = F.when(first > 0, first - 1).otherwise(F.least(F.size(p), F.size(q)))
    return F.lit(1.0) + F.when(a.isNotNull() & b.isNotNull() & (deep > 0), F.lit(0.1) * shared / deep).otherwise(0.0)


def fqn(project: Column, path: Column, name: Column | None = None) -> Column:
    """project.path.segments.name, without the file's extension.

    Symbols of a package's file (__init__, index) belong to the package. Without a
    name it is the module, which keeps that file's name, and for the name __file__
    the file, which keeps its ending too. '' without a project.
    """
    name = F.lit("") if name is None else F.coalesce(name, F.lit(""))
    path = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    path = F.when(name == "__file__", path).otherwise(F.regexp_replace(path, r"\.[^./]*$", ""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.when(F.coalesce(F.try_element_at(parts, F.lit(-1)).isin("__init__", "index"), F.lit(False)) & (name != ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = F.array_join(F.concat(F.array(project), parts, F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))), ".")
    return F.when(project.isNull(), "").otherwise(out)


def fqn_folder(project: Column, path: Column) -> Column:
    """project.path.segments of a directory."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/"), lambda x: x != "")
    return F.when(project.isNull(), "").otherwise(F.array_join(F.concat(F.array(project), parts), "."))


def project_name(path: Column) -> Column:
    """A directory's path as a project's name of letters, digits, '_', '.' and '-': other ASCII signs become '-', other letters the hexadecimal digits of their bytes; 'root' if nothing is left."""
    letters = F.transform(F.split(F.coalesce(path, F.lit("")), ""), lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.lower(F.hex(F.encode(x, "UTF-8")))).otherwise(x))
    out = F.array_join(letters, "")
    for pattern, to in ((r"[^A-Za-z0-9._-]", "-"), (r"-+", "-"), (r"\.+", "."), (r"^[.-]+|-+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return F.when(out == "", "root").otherwise(out)


def resolve_relative(path: str, target: str) -> str | None:
    """An import like ./x or ../y/z against the file that has it; None if it leaves the tree or isn't relative."""
    if not target.startswith("."):
        return None
    at = path.split("/")[:-1]
    for part in target.split("/"):
        if part == "..":
            if not at:
                return None
            at.pop()
        elif part not in (".", ""):
            at.append(part)
    return "/".join(at)


def minhash_hex(c: Column) -> Column:
    """64 numbers of 32 bits as 512 hexadecimal digits."""
    return F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def minhash_from_hex(c: Column) -> Column:
    # by a lambda of its own, so that c is made once and not once for each number
    numbers = F.transform(F.array(c), lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.conv(F.substring(h, k * 8 + 1, F.lit(8)), 16, 10).cast("long")))
    return F.element_at(numbers, 1)


def duration_ns(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), end.cast("long") - start.cast("long"))


def exact_p99(c: Column) -> Column:
    """Of a group: the value at place floor(0.99 n) of the sorted ones."""
    return F.element_at(F.sort_array(F.collect_list(c)), (F.least(F.floor(F.count(c) * 0.99), F.count(c) - 1) + 1).cast("int"))
