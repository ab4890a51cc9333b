"""Column expressions over text: all run in the JVM, none is a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{Nd}]+"
#: Where an identifier run parts, in the order applied.
BOUNDARIES = (r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{Nd})", r"(\p{Nd})(\p{L})", r"(\p{Lu})(\p{Lu}\p{Ll})")
BOUNDARY = "|".join(b.replace("(", "").replace(")", "") for b in BOUNDARIES)


def word_runs(text: Column) -> Column:
    """Maximal runs of letters and decimal digits."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda x: x != "")


def run_parts(run: Column) -> Column:
    for boundary in BOUNDARIES:
        run = F.regexp_replace(run, boundary, "$1 $2")
    return F.split(run, " ")


def run_tokens(run: Column) -> Column:
    """A run and, where it has a boundary inside, its parts; lower case. Runs without one, most by far, are not taken apart."""
    return F.when(run.rlike(BOUNDARY), F.transform(F.concat(F.array(run), run_parts(run)), F.lower)).otherwise(F.array(F.lower(run)))


def tokens(text: Column) -> Column:
    """Identifier-aware tokens in order."""
    return F.flatten(F.transform(word_runs(text), run_tokens))


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(text)))


def lines(text: Column) -> Column:
    """Lines after CRLF becomes LF and one trailing LF goes; a blank text has none."""
    plain = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n\z", "")
    return F.when(F.trim(F.regexp_replace(text, r"\s", " ")) == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n"))


def declaration_header(text: Column, most_lines: int = 6, most_bytes: int = 768, cut: bool = True) -> Column:
    """The first lines, trimmed, that are neither blank nor comments alone: at most six, or as many as reach 768 bytes, cut there."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    kept = F.slice(F.filter(trimmed, lambda x: (x != "") & ~x.rlike(r"^(//|#|--|/\*|\*|<!--)")), 1, most_lines)
    head = F.aggregate(kept, F.lit(""), lambda held, x: F.when(held == "", x).when(F.octet_length(held) >= most_bytes, held).otherwise(F.concat(held, F.lit("\n"), x)))
    return F.decode(F.substring(F.encode(head, "UTF-8"), 1, most_bytes), "UTF-8") if cut else head


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def under(path: Column, prefix: str) -> Column:
    """The node itself or anything below it; both tests reach a Parquet scan."""
    return (path == prefix) | path.startswith(f"{prefix}/")


def document_kind(path: Column) -> Column:
    """Kind of a knowledge document by the first rule that holds."""
    lower, base = F.lower(path), F.lower(base_name(path))
    rule = F.when(lower.rlike(r"\.(yaml|yml|toml|json|ini|conf)$"), "config")
    rule = rule.when(lower.contains("/adr") | base.contains("adr-") | base.contains("decision"), "adr")
    for word in ("architecture", "planning", "issue", "export"):
        rule = rule.when(lower.contains(word), word)
    return rule.when(extension(path).isin(".txt", ".rst", ".adoc"), "text").otherwise("markdown")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def prose_heavy(text: Column) -> Column:
    """At least twelve words, and more than twice as many as structural characters."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return (n >= 12) & (n > 2 * count_of(text, ":{}[]"))


def minified(name: Column, content: Column) -> Column:
    """Web files of 16 KiB or more with four lines or fewer, or a line of 32 KiB or more."""
    web = extension(name).isin(".js", ".jsx", ".ts", ".tsx", ".css", ".scss", ".html", ".json", ".xml")
    parts = F.split(content, "\n")
    return web & (F.octet_length(content) >= 16384) & ((F.size(parts) <= 4) | (F.array_max(F.transform(parts, F.octet_length)) >= 32768))


#: Fixed value: what stands for a parameter in an HTTP route.
PLACEHOLDER = r"\{[^}/]+\}|:[A-Za-z_][A-Za-z0-9_]*|%\{[^}]+\}|%s|#\{[^}]+\}"


def clean_path(path: Column) -> Column:
    """A rooted path without empty, . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def http_path(value: Column) -> Column:
    """Normal form of a route: its path alone, placeholders as {param}; empty for the root and for engine resources."""
    v = F.trim(F.regexp_replace(value, r"\\/", "/"))
    whole = v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+") & ~v.rlike(r"%(?![0-9A-Fa-f]{2})")
    path = F.regexp_extract(v, r"^[^:]+://[^/?#]+([^?#]*)", 1)
    path = F.when(path.contains("%"), F.url_decode(F.regexp_replace(path, r"\+", "%2B"))).otherwise(path)
    rule = F.when(whole, path)
    for part in ("/api/", "/internal/", "/health", "/ws"):
        rule = rule.when(F.instr(v, part) > 0, v.substr(F.instr(v, part), F.length(v)))
    path = F.regexp_replace(F.regexp_replace(rule.otherwise(v), r"[?#][\s\S]*\z", ""), PLACEHOLDER, "{param}")
    path = clean_path(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    return F.when(F.lower(v).startswith("res://") | F.lower(v).startswith("user://") | (path == "/"), "").otherwise(path)


def http_shape(path: Column) -> Column:
    """What routes are joined by: placeholders without their names."""
    return F.regexp_replace(path, PLACEHOLDER, "{}")


def repository_path(path: Column) -> Column:
    """Slash-separated relative path without empty and . parts; . for none; null where empty, absolute, with .. or control characters."""
    p = F.regexp_replace(path, r"\\", "/")
    parts = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    bad = (p == "") | p.startswith("/") | p.rlike(r"^[A-Za-z]:") | F.exists(parts, lambda x: (x == "..") | x.rlike(r"\p{Cc}"))
    return F.when(~bad, F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/")))


def contains_word(text: Column, value: Column) -> Column:
    """value somewhere in text with no word character (ASCII) next to it on either side."""
    quoted = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?s)(?:\A|[^A-Za-z0-9_])"), quoted, F.lit(r"(?:\z|[^A-Za-z0-9_])")))


#: Words that a symbol query drops.
SYMBOL_STOPWORDS = "about after also and are does explain find from how into its the their through what where which with".split()


def symbol_query_terms(text: Column) -> Column:
    """Distinct runs of letters, digits and _ of three bytes or more, lower case, without stop words."""
    runs = F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}_]+"), lambda x: F.octet_length(x) >= 3)
    return F.array_except(F.array_distinct(runs), F.array(*map(F.lit, SYMBOL_STOPWORDS)))


def identifier_terms(name: Column) -> Column:
    """Parts of two characters or more of an identifier, cut between lower and upper case."""
    cut = F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.transform(F.filter(F.split(cut, r"[^\p{L}\p{Nd}]+"), lambda x: F.length(x) >= 2), F.lower)


#: What the hybrid ranking takes for one word, what it leaves out, and what says little alone.
HYBRID_ALIASES = {
    "embedded": "embed", "embedding": "embed", "embeddings": "embed", "rendered": "render", "rendering": "render", "ranked": "rank", "ranking": "rank",
    "ordered": "order", "ordering": "order", "resolved": "resolve", "resolving": "resolve", "resolution": "resolve", "relations": "relation",
    "relationship": "relation", "relationships": "relation", "dependencies": "dependent", "dependency": "dependent", "dependents": "dependent",
    "incoming": "inbound", "outgoing": "outbound", "uncertain": "unresolved", "uncertainty": "unresolved", "limited": "bound", "bounded": "bound",
    "limits": "bound", "callers": "call", "callee": "call", "callees": "call", "execution": "call",
}
HYBRID_STOPWORDS = "and are does for from how into then the this was were what when where which with without internal src test tests".split()
HYBRID_GENERIC = "anchor app call embed entry execute graph identity match node pack path query relation resolve search state".split()


def hybrid_text(value: Column) -> Column:
    """Words in lower case with one space between, cut before an upper-case letter after a lower-case one or a digit."""
    cut = F.regexp_replace(value, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(cut), r"[^\p{L}\p{Nd}]+", " "))


def hybrid_root(word: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for pair in HYBRID_ALIASES.items() for x in pair])
    n = F.octet_length(word)
    rule = F.when((n > 6) & word.endswith("ies"), F.concat(F.regexp_replace(word, "ies$", ""), F.lit("y")))
    rule = rule.when((n > 6) & word.endswith("ing"), F.regexp_replace(word, "ing$", "")).when((n > 5) & word.endswith("ed"), F.regexp_replace(word, "ed$", ""))
    rule = rule.when((n > 5) & word.endswith("es") & ~word.endswith("ses"), F.regexp_replace(word, "es$", ""))
    stem = rule.when((n > 4) & word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.coalesce(F.try_element_at(alias, word), F.try_element_at(alias, stem), stem)


def hybrid_tokens(value: Column) -> Column:
    """Distinct roots of three bytes or more that are no stop words."""
    roots = F.transform(F.split(hybrid_text(value), " "), hybrid_root)
    return F.array_except(F.array_distinct(F.filter(roots, lambda x: F.octet_length(x) >= 3)), F.array(*map(F.lit, HYBRID_STOPWORDS)))


#: Directories and file names of generated or vendored code, and phrases that mark a generated file.
GENERATED_DIRECTORIES = "node_modules vendor third_party third-party .next .nuxt coverage dist target out".split()
LOCK_FILES = (
    "package-lock.json npm-shrinkwrap.json pnpm-lock.yaml yarn.lock bun.lockb composer.lock poetry.lock pipfile.lock cargo.lock gemfile.lock"
).split()
GENERATED_SUFFIXES = (
    ".min.js .min.css .bundle.js .bundle.css .generated.go _generated.go .generated.js .generated.ts .gen.go .gen.js .gen.ts .pb.go _pb2.py .g.cs"
).split()
IGNORED_DIRECTORIES = ".git .go-cache .pytest_cache .tooling .tmp .worktrees .workingtrees bin build".split()


def in_directory(path: Column, names: list[str], lower: bool = False) -> Column:
    """Some directory of the path has one of the names."""
    folders = F.split(F.lower(path) if lower else path, "/")
    return F.arrays_overlap(F.slice(folders, 1, F.size(folders) - 1), F.array(*map(F.lit, names)))


def generated_name(path: Column) -> Column:
    name = F.lower(base_name(path))
    found = name.isin(LOCK_FILES)
    for suffix in GENERATED_SUFFIXES:
        found = found | name.endswith(suffix)
    return found


def generated_content(path: Column, content: Column) -> Column:
    """Marked as generated in its first 8 KiB (not for .md and .txt), or minified."""
    head, name = F.lower(F.substring(content, 1, 8192)), F.lower(path)
    edit = head.contains("do not edit")
    marked = head.contains("@generated") | (head.contains("code generated") & edit) | (head.contains("automatically generated") & edit)
    marked = marked | head.contains("this file was generated") | head.contains("this file is generated") | (head.contains("generated by") & edit)
    return (marked & ~name.endswith(".md") & ~name.endswith(".txt")) | minified(path, content)


#: Extensions and configuration files of the named languages, and extensions taken as generic source.
LANGUAGE_EXTENSIONS = {
    "c-family": ".c .cc .cp .cpp .cxx .c++ .h .hh .hpp .hxx .h++ .inc .inl .ipp .tpp", "gdscript": ".gd", "go": ".go", "csharp": ".cs", "java": ".java",
    "kotlin": ".kt .kts", "lotusscript": ".ls .lsa .lsdb .lss", "python": ".py", "ruby": ".rb .gemspec", "rust": ".rs",
    "typescript": ".ts .tsx .mts .cts .js .jsx .mjs .cjs .svelte",
}
LANGUAGE_FILES = {
    "c-family": "compile_commands.json CMakeLists.txt", "gdscript": "project.godot", "go": "go.mod go.sum",
    "csharp": ".sln .csproj Directory.Build.props Directory.Build.targets global.json",
    "java": "pom.xml build.gradle settings.gradle gradlew gradlew.bat mvnw mvnw.cmd", "kotlin": "build.gradle.kts settings.gradle.kts",
    "python": "pyproject.toml setup.cfg requirements.txt", "ruby": "Gemfile Gemfile.lock", "rust": "Cargo.toml Cargo.lock",
    "typescript": "package.json package-lock.json tsconfig.json jsconfig.json",
}
GENERIC_EXTENSIONS = (
    ".asm .bash .bat .clj .cljs .cmd .cr .dart .elm .erl .ex .exs .f03 .f90 .f95 .fish .fs .fsx .groovy .hs .jl .lhs .lua .m .ml .mli .mm .nim .nims "
    ".pas .php .pl .pm .proto .ps1 .r .scala .sc .s .sh .sol .sql .swift .sv .v .vb .vbs .vim .zig"
)


def languages(path: Column) -> Column:
    """Named languages, sorted, that own a path by its extension or name, else generic-<extension>, else none."""
    name, end = base_name(path), extension(path)
    found = []
    for language in sorted(LANGUAGE_EXTENSIONS):
        files = LANGUAGE_FILES.get(language, "").split()
        owned = end.isin(LANGUAGE_EXTENSIONS[language].split()) | name.isin(files) | end.isin([x for x in files if x.startswith(".")])
        found.append(F.when(owned, language))
    named = F.array_compact(F.array(*found))
    generic = F.when(end.isin(GENERIC_EXTENSIONS.split()), F.array(F.concat(F.lit("generic-"), F.substring(end, 2, 32)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(named) > 0, named).otherwise(generic)


def handle(payload: Column, scheme: str = "cairnwork:v1:") -> Column:
    """A struct as an opaque text: base64 for URLs, without padding, of its JSON."""
    return F.concat(F.lit(scheme), F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(F.to_json(payload), "UTF-8")), r"\s", ""), "+/", "-_"), "=+$", ""))


def handle_payload(value: Column, schema: str, scheme: str = "cairnwork:v1:") -> Column:
    """The struct of a handle; null where it has another scheme or is no handle."""
    body = F.translate(F.regexp_extract(F.trim(value), f"^{scheme}([A-Za-z0-9_-]+)$", 1), "-_", "+/")
    whole = F.concat(body, F.repeat(F.lit("="), (F.pmod(-F.length(body), F.lit(4))).cast("int")))
    return F.when(body != "", F.from_json(F.decode(F.try_to_binary(whole, F.lit("base64")), "UTF-8"), schema))
