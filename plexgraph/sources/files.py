"""Files of a repository: discovery, ignore rules, languages, manifests, environment addresses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.functions.scalar import is_secret
from plexgraph.operators.architecture import LANGUAGES

#: Directories that no mode reads, and those that only the full one does.
SKIP = ".git .hg .svn node_modules __pycache__ .venv venv .tox .mypy_cache .pytest_cache .idea .vscode dist build target vendor .next .cache".split()
SKIP_FAST = "docs doc examples example samples fixtures testdata assets static public migrations".split()
#: Endings of what is no text.
BINARY = "png jpg jpeg gif ico pdf zip gz tar jar class so dll exe o a woff woff2 ttf mp3 mp4 bin lock".split()
#: Languages told by a name or a first line.
BY_NAME = {"Dockerfile": "Dockerfile", "Makefile": "Makefile", "CMakeLists.txt": "CMake", "Jenkinsfile": "Groovy", "go.mod": "GoMod"}
BY_SHEBANG = {"python": "Python", "bash": "Shell", "sh": "Shell", "node": "JavaScript", "ruby": "Ruby", "perl": "Perl", "lua": "Lua"}


class Ignore:
    """Rules of ignore files: the last one that matches decides, ``!`` takes back, nested files hold below their directory."""

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def add(self, text: str, base: str = "") -> Ignore:
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            rooted = "/" in line
            self.rules.append((base.strip("/"), re.compile(self._regex(line.lstrip("/"), rooted)), keep, only_dir))
        return self

    @staticmethod
    def _regex(glob: str, rooted: bool) -> str:
        out, k = "" if rooted else "(?:.*/)?", 0
        while k < len(glob):
            if glob.startswith("**/", k):
                out, k = out + "(?:.*/)?", k + 3
            elif glob.startswith("/**", k) and k + 3 == len(glob):
                out, k = out + "/.+", k + 3
            elif glob.startswith("**", k):
                out, k = out + ".*", k + 2
            elif glob[k] == "*":
                out, k = out + "[^/]*", k + 1
            elif glob[k] == "?":
                out, k = out + "[^/]", k + 1
            elif glob[k] == "[" and "]" in glob[k + 2 :]:
                end = glob.index("]", k + 2)
                body = glob[k + 1 : end].replace("\\", "\\\\")
                out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            else:
                k += glob[k] == "\\" and k + 1 < len(glob)
                out, k = out + re.escape(glob[k]), k + 1
        return f"^{out}$"

    def ignored(self, path: str) -> bool:
        """Is a file ignored, itself or by a directory above it?"""
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            if self._match("/".join(parts[:k]), k < len(parts)):
                return True
        return False

    def _match(self, path: str, is_dir: bool) -> bool:
        out = False
        for base, pattern, keep, only_dir in self.rules:
            if only_dir and not is_dir:
                continue
            if base and not path.startswith(base + "/"):
                continue
            if pattern.match(path[len(base) + 1 :] if base else path):
                out = not keep
        return out


def discover(paths: DataFrame, rules: dict[str, str] | None = None, mode: str = "full") -> DataFrame:
    """paths (path) with ``state``: kept, excluded (by directory or ending) or ignored (by rules, a map of directory to text)."""
    skip = SKIP + (SKIP_FAST if mode != "full" else [])
    excluded = F.col("path").rlike(rf"(^|/)({'|'.join(map(re.escape, skip))})/") | F.lower("path").rlike(rf"\.({'|'.join(BINARY)})$")
    state = F.when(excluded, "excluded")
    if rules:
        text = dict(rules)

        @F.pandas_udf("boolean")
        def ignored(p):
            own = Ignore()
            for base in sorted(text, key=len):
                own.add(text[base], base)
            return p.map(own.ignored)

        state = state.when(ignored(F.col("path")), "ignored")
    return paths.select("path", state.otherwise("kept").alias("state"))


def read_repository(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the files below a root, by Spark's own reader."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select("path", F.decode("content", "UTF-8").alias("text"))


def language(path, first_line=None, overrides: dict | None = None):
    """The language of a path, by the user's endings, its name, its ending or its first line."""
    to = {**LANGUAGES, **(overrides or {})}
    name = F.element_at(F.split(path, "/"), -1)
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    out = F.coalesce(m(BY_NAME)[name], m(to)[F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))])
    if first_line is not None:
        out = F.coalesce(out, m(BY_SHEBANG)[F.regexp_extract(first_line, r"^#!.*?(?:/|env +)(python|bash|sh|node|ruby|perl|lua)[\d.]*\b", 1)])
    return out


def count_at_most(df: DataFrame, n: int) -> int | None:
    """The count, or None if there are more than n."""
    got = df.limit(n + 1).count()
    return None if got > n else got


_ASSIGN = r"^\s*(?:ENV|ARG|export|-)?\s*[\"']?([A-Za-z_][A-Za-z0-9_.]*)[\"']?\s*(?:=|:|\s)\s*[\"']?(https?://[^\s\"']+)"


def env_urls(files: DataFrame) -> DataFrame:
    """(path, key, url): addresses set in Docker, YAML, Terraform, .env and shell files (path, text), secrets left out."""
    known = F.col("path").rlike(r"(?i)(^|/)Dockerfile[^/]*$|\.(ya?ml|tf|tfvars|env|sh|toml|properties|cfg|ini|conf)$|(^|/)\.env[^/]*$")
    lines = files.filter(known).select("path", F.explode(F.split("text", "\n")).alias("line"))
    hit = lines.select("path", F.regexp_extract("line", _ASSIGN, 1).alias("key"), F.regexp_extract("line", _ASSIGN, 2).alias("url"))
    return hit.filter((F.col("url") != "") & ~is_secret(F.col("key"), F.col("url"))).distinct()


def dockerfile(files: DataFrame) -> DataFrame:
    """(path, kind, value) of FROM, EXPOSE, CMD, ENTRYPOINT, WORKDIR and ENV lines."""
    lines = files.filter(F.col("path").rlike(r"(^|/)Dockerfile[^/]*$")).select("path", F.explode(F.split("text", "\n")).alias("line"))
    p = r"^\s*(FROM|EXPOSE|CMD|ENTRYPOINT|WORKDIR|ENV)\s+(.+?)\s*$"
    return lines.select("path", F.regexp_extract("line", p, 1).alias("kind"), F.regexp_extract("line", p, 2).alias("value")).filter("kind <> ''")


def terraform(files: DataFrame) -> DataFrame:
    """(path, kind, type, name) of resource, data, variable, module and output blocks."""
    p = r'(?m)^\s*(resource|data|variable|module|output)\s+"([^"]+)"(?:\s+"([^"]+)")?'
    rows = files.filter(F.endswith("path", F.lit(".tf"))).select("path", F.explode(F.regexp_extract_all("text", F.lit(p), 0)).alias("b"))
    two = F.regexp_extract("b", p, 3)
    return rows.select("path", F.regexp_extract("b", p, 1).alias("kind"), F.when(two != "", F.regexp_extract("b", p, 2)).alias("type"), F.when(two != "", two).otherwise(F.regexp_extract("b", p, 2)).alias("name"))


def yaml_documents(text: str) -> list:
    """A subset of YAML: maps, lists and scalars by indentation, quoted or bare; documents between ---."""
    def scalar(v: str):
        v = v.strip()
        if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(v, v)

    def block(lines, at, indent):
        if at >= len(lines):
            return None, at
        out = [] if lines[at][1].startswith("- ") or lines[at][1] == "-" else {}
        while at < len(lines) and lines[at][0] == indent:
            body = lines[at][1]
            if isinstance(out, list):
                if not body.startswith("-"):
                    break
                rest = body[1:].strip()
                if re.match(r"[^\"'{\[][^:]*:(\s|$)", rest):
                    inner = indent + len(body) - len(body[1:].lstrip())
                    lines[at] = (inner, rest)
                    value, at = block(lines, at, inner)
                    out.append(value)
                    continue
                if rest:
                    out.append(scalar(rest))
                    at += 1
                    continue
                at += 1
                value, at = block(lines, at, lines[at][0]) if at < len(lines) and lines[at][0] > indent else (None, at)
                out.append(value)
            else:
                m = re.match(r"[\"']?([^\"':]+)[\"']?\s*:\s*(.*)$", body)
                if not m:
                    at += 1
                    continue
                at += 1
                if m[2]:
                    out[m[1].strip()] = scalar(m[2])
                elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("-"))):
                    out[m[1].strip()], at = block(lines, at, lines[at][0])
                else:
                    out[m[1].strip()] = None
        return out, at

    docs = []
    for part in re.split(r"(?m)^---\s*$", text):
        lines = [(len(x) - len(x.lstrip()), re.sub(r"\s+#.*$", "", x).strip()) for x in part.splitlines() if x.strip() and not x.lstrip().startswith("#")]
        if lines:
            docs.append(block(lines, 0, lines[0][0])[0])
    return docs


def kubernetes(files: DataFrame) -> DataFrame:
    """(path, kind, name, selector, labels) of the objects in YAML files (path, text)."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                for d in yaml_documents(text or ""):
                    if isinstance(d, dict) and d.get("kind") and isinstance(d.get("metadata"), dict):
                        spec = d.get("spec") if isinstance(d.get("spec"), dict) else {}
                        sel = spec.get("selector") if isinstance(spec.get("selector"), dict) else {}
                        sel = sel.get("matchLabels", sel)
                        lab = d["metadata"].get("labels") or {}
                        rows.append((path, str(d["kind"]), str(d["metadata"].get("name")), {k: str(v) for k, v in sel.items()}, {k: str(v) for k, v in lab.items()}))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "selector", "labels"])

    yaml = files.filter(F.col("path").rlike(r"\.ya?ml$")).select("path", "text")
    return yaml.mapInPandas(run, "path string, kind string, name string, selector map<string,string>, labels map<string,string>")


def manifest_packages(path: str, text: str) -> list[tuple[str, str]]:
    """(kind, name) of the package that a manifest defines and those that it needs."""
    import json

    base = path.rsplit("/", 1)[-1]
    try:
        if base in ("package.json", "composer.json"):
            d = json.loads(text)
            need = [k for key in ("dependencies", "devDependencies", "peerDependencies", "require", "require-dev") for k in d.get(key, {})]
            return [("package", d["name"])] * ("name" in d) + [("dependency", k) for k in need]
    except (ValueError, AttributeError):
        return []
    rules = {
        "go.mod": (r"(?m)^module\s+(\S+)", r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v"),
        "Cargo.toml": (r"(?ms)^\[package\].*?^name\s*=\s*\"([^\"]+)\"", None),
        "pyproject.toml": (r"(?m)^name\s*=\s*\"([^\"]+)\"", r"(?m)^\s*\"([A-Za-z0-9_.-]+)\s*(?:[<>=!~\[;].*)?\",?\s*$"),
        "requirements.txt": (None, r"(?m)^([A-Za-z0-9_.-]+)"),
        "pubspec.yaml": (r"(?m)^name:\s*(\S+)", None),
        "pom.xml": (r"<artifactId>([^<]+)</artifactId>", r"(?s)<dependency>.*?<artifactId>([^<]+)</artifactId>"),
        "mix.exs": (r"app:\s*:(\w+)", r"\{:(\w+),"),
        "Package.swift": (r"name:\s*\"([^\"]+)\"", r"\.package\([^)]*?/([\w.-]+?)(?:\.git)?\""),
        "build.gradle": (None, r"(?:implementation|api|compile)[ (]+['\"][^:'\"]+:([^:'\"]+)"),
    }
    own, need = rules.get(base, rules.get("gemspec") or ((r"\.name\s*=\s*['\"]([^'\"]+)", r"add_(?:runtime_|development_)?dependency\s*\(?['\"]([^'\"]+)") if base.endswith(".gemspec") else (None, None)))
    out = [("package", m[1]) for m in ([re.search(own, text)] if own else []) if m]
    if base == "Cargo.toml":
        for part in re.findall(r"(?ms)^\[(?:dev-|build-)?dependencies\]\s*$(.*?)(?=^\[|\Z)", text):
            out += [("dependency", k) for k in re.findall(r"(?m)^([\w-]+)\s*=", part)]
    return out + [("dependency", k) for k in (re.findall(need, text) if need else [])]


def packages(files: DataFrame) -> DataFrame:
    """(path, kind, name) over manifests (path, text)."""
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, k, n) for p, t in zip(pdf["path"], pdf["text"]) for k, n in manifest_packages(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name"])

    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string")


#: Names of manifests and of the ecosystems they belong to.
ECOSYSTEMS = {"go.mod": "gomod", "requirements.txt": "pip", "Cargo.toml": "cargo", "package.json": "npm", "Chart.yaml": "helm"}


def depends_on(found: DataFrame, project: str) -> DataFrame:
    """(path, target_qn, name, ecosystem) of DEPENDS_ON edges, from packages (path, kind, name)."""
    base = F.element_at(F.split("path", "/"), -1)
    eco = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ECOSYSTEMS.items() for x in kv]), base), F.lit("external"))
    need = found.filter((F.col("kind") == "dependency") & (F.col("name") != "")).select("path", "name", eco.alias("ecosystem")).distinct()
    return need.select("path", F.concat(F.lit(f"{project}.__"), "ecosystem", F.lit("_dep__."), "name").alias("target_qn"), "name", "ecosystem")


def _from_yaml(files: DataFrame, pattern: str, rows_of, schema: str, columns: list[str]) -> DataFrame:
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, *r) for p, t in zip(pdf["path"], pdf["text"]) for d in yaml_documents(t or "") if isinstance(d, dict) for r in rows_of(d)]
            yield pd.DataFrame(rows, columns=columns)

    return files.filter(F.col("path").rlike(pattern)).select("path", "text").mapInPandas(run, schema)


def compose(files: DataFrame) -> DataFrame:
    """(path, service, kind, value) of the services in compose files: image, build, ports, environment and depends_on, one row for each value."""
    def rows_of(d):
        services = d.get("services") if isinstance(d.get("services"), dict) else {}
        for name, x in services.items():
            for kind in ("image", "build", "ports", "environment", "depends_on") if isinstance(x, dict) else ():
                v = x.get(kind)
                if kind == "build" and isinstance(v, dict):
                    v = v.get("context")
                values = [f"{k}={y}" if kind == "environment" else k for k, y in v.items()] if isinstance(v, dict) else v if isinstance(v, list) else [v]
                yield from ((name, kind, str(y)) for y in values if y is not None and not isinstance(y, dict))

    return _from_yaml(files, r"(?i)(^|/)(docker-compose[^/]*|compose)\.ya?ml$", rows_of, "path string, service string, kind string, value string", ["path", "service", "kind", "value"])


def helm_dependencies(files: DataFrame) -> DataFrame:
    """(path, chart, name, version, repository) of the dependencies in Chart.yaml and requirements.yaml files."""
    def rows_of(d):
        need = d.get("dependencies") if isinstance(d.get("dependencies"), list) else []
        text = lambda v: None if v is None else str(v)
        yield from ((text(d.get("name")), text(x.get("name")), text(x.get("version")), text(x.get("repository"))) for x in need if isinstance(x, dict) and x.get("name"))

    return _from_yaml(files, r"(^|/)(Chart|requirements)\.ya?ml$", rows_of, "path string, chart string, name string, version string, repository string", ["path", "chart", "name", "version", "repository"])


def alias_target(aliases: dict[str, list[str]], target: str, base: str = "") -> str | None:
    """A path behind an alias of a compiler's configuration: the longest prefix before * wins."""
    best = None
    for k, to in aliases.items():
        head, star, tail = k.partition("*")
        if (target == k if not star else target.startswith(head) and target.endswith(tail)) and (best is None or len(head) > best[0]):
            best = (len(head), to[0].replace("*", target[len(head) : len(target) - len(tail)]) if star else to[0])
    return None if best is None else "/".join(x for x in (base.strip("/"), best[1].removeprefix("./")) if x)


def compile_flags(commands: DataFrame) -> DataFrame:
    """(file, includes, defines) from compile_commands rows (file, command)."""
    return commands.select("file", F.regexp_extract_all("command", F.lit(r"-I\s*(\S+)"), 1).alias("includes"), F.regexp_extract_all("command", F.lit(r"-D\s*(\S+)"), 1).alias("defines"))


def sveltekit_routes(files: DataFrame) -> DataFrame:
    """(path, route): routes by where +page and +server files lie."""
    r = F.regexp_extract("path", r"(?:^|/)src/routes(/.*)?/\+(?:page|server)[^/]*$", 1)
    hit = files.filter(F.col("path").rlike(r"(^|/)src/routes(/.*)?/\+(page|server)[^/]*$"))
    route = F.regexp_replace(F.regexp_replace(r, r"/\([^)/]*\)", ""), r"\[+(?:\.\.\.)?[^\]]*\]+", "{}")
    return hit.select("path", F.when(route == "", "/").otherwise(route).alias("route"))
