"""Imports, declarations and line counts straight from source text, with Spark's own functions.

Files are matched as texts with the patterns of their language, so broken files work too and no parser is
needed. Imports may spread over lines and carry the names they bind; calls are counted by name;
declarations get their enclosing classes from their indentation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMPORTS = {  # language family -> patterns whose first group is the specifier
    "ecma": [("esm", r"""^\s*(?:import|export)\b[^'"]*?(?:from\s*)?["']([^"']+)["']"""), ("require", r"""\brequire\(\s*["']([^"']+)["']\s*\)"""), ("dynamic", r"""\bimport\(\s*["']([^"']+)["']\s*\)""")],
    "python": [("python", r"^\s*from\s+([.\w]+)\s+import\b"), ("python", r"^\s*import\s+([\w.]+)")],
    "java": [("java", r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;")],
    "go": [("go", r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./\-]+)"\s*$""")],
}
DECLARATIONS = {  # first group: the name
    "ecma": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)")],
    "python": [("class", r"^\s*class\s+([A-Za-z_]\w*)"), ("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)")],
    "java": [("class", r"^\s*(?:@\w+\s+)*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"), ("method", r"^\s*(?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+(?:<[^>]+>\s*)?[\w<>\[\], .?]+\s+([A-Za-z_]\w*)\s*\([^;]*\{\s*$")],
    "go": [("function", r"^func\s+([A-Za-z_]\w*)\s*[(\[]"), ("method", r"^func\s+\([^)]*\)\s*([A-Za-z_]\w*)\s*\("), ("class", r"^type\s+([A-Za-z_]\w*)")],
}


def family(language: str) -> Column:
    c = F.lower(F.col(language))
    return F.when(c.isin("javascript", "typescript", "tsx"), "ecma").when(c.isin("python", "java", "go"), c)


def loc(content: str) -> Column:
    """Lines as pieces between line ends: a line end at the end adds one; an empty text has none."""
    return F.when(F.col(content) == "", F.lit(0)).otherwise(F.size(F.split(F.col(content), "\n", -1)))


def lines(files: DataFrame, key: str, language: str, content: str) -> DataFrame:
    rows = files.select(key, family(language).alias("family"), F.col(content).alias("_c")).where("family IS NOT NULL AND _c IS NOT NULL")
    split = rows.select(key, "family", F.posexplode(F.split(F.regexp_replace("_c", "\r", ""), "\n", -1)).alias("_p", "text"))
    return split.select(key, "family", (F.col("_p") + 1).alias("line"), "text")


def matches(rows: DataFrame, key: str, patterns: dict, name: str, keep: list[str] | None = None) -> DataFrame:
    """One row for each line and first pattern of its language that matches: ``key, line, kind, name``."""
    what = F.lit(None).cast("struct<kind:string,v:string>")
    for fam, options in reversed(patterns.items()):
        for kind, pattern in reversed(options):
            got = F.regexp_extract("text", pattern, 1)
            what = F.when((F.col("family") == fam) & (got != ""), F.struct(F.lit(kind).alias("kind"), got.alias("v"))).otherwise(what)
    return rows.withColumn("_m", what).where("_m IS NOT NULL").select(key, "line", F.col("_m.kind").alias("kind"), F.col("_m.v").alias(name), *(keep or []))


# -- imports with the names they bind

IMPORT_MARKS = {  # language family -> one import, from its first word on
    "ecma": r"""\b(?:import|export)\s+(?:type\s+)?[\w$*{][^'"();=]*?\bfrom\s*["'][^"'\n]+["']|\bimport\s*["'][^"'\n]+["']|\b(?:require|import)\s*\(\s*["'][^"'\n]+["']\s*\)""",
    "python": r"(?m:^)[ \t]*(?:from[ \t]+[.\w]+[ \t]+import[ \t]+(?:\([^)]*\)|[^\n#;(]+)|import[ \t]+\w[\w. \t,]*)",
    "java": r"(?m:^)[ \t]*import[ \t]+(?:static[ \t]+)?[\w.]+(?:\.\*)?[ \t]*;",
    "go": r"""(?m:^)[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"[\w./\-]+"[ \t]*(?m:$)""",
}
COMMENT_LINES = r"(?m:^)[ \t]*(?://|\*|/\*)[^\n]*"  # of the C-like languages
GO_BODY = r"(?m:^)(?:func|type|var|const)\b"  # imports come before


def _pair(local: Column, origin: Column) -> Column:
    return F.struct(local.alias("local_name"), origin.alias("imported_name"))


def _renamed(item: Column, whole: bool) -> Column:
    """``a as b`` binds b to a; ``a`` binds itself, or only its last part."""
    to = F.regexp_extract(item, r"^([\w$.]+)\s+as\s+([\w$]+)$", 2)
    name = F.regexp_extract(item, r"^([\w$.*]+)", 1)
    return _pair(F.when(to != "", to).when(F.lit(whole), name).otherwise(F.substring_index(name, ".", -1)), name)


def _items(text: Column, drop: str = r"^\s+") -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", ""), drop, "")), lambda x: x != "")


def go_package(path: Column) -> Column:
    """The name a Go package goes by, from its path."""
    last = F.element_at(F.filter(F.split(path, "/"), lambda x: ~x.rlike(r"^v[0-9]+$")), -1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.v[0-9]+$", ""), "^go-", ""), "[-.]", "_")


def pieces(rows: DataFrame, key: str, text: Column, mark: str) -> DataFrame:
    """``key, line, m``: every match of ``mark`` and the line it begins on."""
    parts = rows.select(key, F.split(F.regexp_replace(text, f"({mark})", "\x01$1"), "\x01", -1).alias("_p")).where("size(_p) > 1")
    breaks = F.transform("_p", lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    at = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.struct((F.aggregate(F.slice("_b", 1, i), F.lit(0), lambda a, x: a + x) + 1).alias("line"), F.get("_p", i).alias("piece")))
    return parts.withColumn("_b", breaks).select(key, F.explode(at).alias("_m")).select(key, "_m.line", F.regexp_extract("_m.piece", f"^(?:{mark})", 0).alias("m"))


def imported(files: DataFrame, key: str, language: str, content: str) -> DataFrame:
    """``key, line, kind, specifier, names``: each import of each file with the names it binds (local and
    imported; ``default`` and ``*`` as in the languages). Python's ``import a, b`` is one for each; exports
    from another file and imports for their effects bind nothing. Files of other languages and null
    contents have no rows."""
    rows = files.select(key, family(language).alias("family"), F.regexp_replace(content, "\r", "").alias("_c")).where("family IS NOT NULL AND _c IS NOT NULL")
    of = lambda name: rows.where(F.col("family") == name)
    m, none = F.col("m"), F.array().cast("array<struct<local_name:string,imported_name:string>>")
    quoted = F.regexp_extract(m, r"""["']([^"'\n]+)["']""", 1)

    clause = F.regexp_extract(m, r"""^import\s+(?:type\s+)?([\s\S]*?)\s*\bfrom\s*["']""", 1)
    default, star = F.regexp_extract(clause, r"^([\w$]+)\s*(?:,|$)", 1), F.regexp_extract(clause, r"\*\s*as\s+([\w$]+)", 1)
    named = F.transform(_items(F.regexp_replace(F.regexp_extract(clause, r"\{([^}]*)\}", 1), r"//[^\n]*|/\*[\s\S]*?\*/", ""), r"^type\s+"), lambda x: _renamed(x, True))
    ecma_names = F.concat(F.when(default != "", F.array(_pair(default, F.lit("default")))).otherwise(none), F.when(star != "", F.array(_pair(star, F.lit("*")))).otherwise(none), named)
    kind = F.when(m.startswith("require"), "require").when(m.rlike(r"^import\s*\("), "dynamic").otherwise("esm")
    ecma = pieces(of("ecma"), key, F.regexp_replace("_c", COMMENT_LINES, ""), IMPORT_MARKS["ecma"]).select(key, "line", kind.alias("kind"), quoted.alias("specifier"), ecma_names.alias("names"))

    py = pieces(of("python"), key, F.col("_c"), IMPORT_MARKS["python"])
    origin = F.regexp_extract(m, r"^[ \t]*from[ \t]+([.\w]+)", 1)
    listed = F.translate(F.regexp_replace(F.regexp_replace(m, r"^[ \t]*from[ \t]+[.\w]+[ \t]+import[ \t]+", ""), r"#[^\n]*", ""), "()", "")
    from_ = py.where(origin != "").select(key, "line", F.lit("python").alias("kind"), origin.alias("specifier"), F.transform(_items(listed), lambda x: _renamed(x, False)).alias("names"))
    one = py.where(origin == "").select(key, "line", F.explode(_items(F.regexp_replace(m, r"^[ \t]*import[ \t]+", ""))).alias("x"))
    plain = one.select(key, "line", F.lit("python").alias("kind"), F.regexp_extract("x", r"^([\w.]+)", 1).alias("specifier"), F.array(_renamed(F.col("x"), False)).alias("names"))

    target = F.regexp_extract(m, r"([\w.]+(?:\.\*)?)[ \t]*;$", 1)
    last = F.substring_index(target, ".", -1)
    java = pieces(of("java"), key, F.col("_c"), IMPORT_MARKS["java"]).select(key, "line", F.lit("java").alias("kind"), target.alias("specifier"), F.when(target.endswith("*"), none).otherwise(F.array(_pair(last, last))).alias("names"))

    alias = F.regexp_extract(m, r'^[ \t]*(?:import[ \t]+)?([\w.]+)[ \t]+"', 1)
    local = F.when((alias != "") & (alias != "import"), alias).otherwise(go_package(quoted))
    go = pieces(of("go"), key, F.get(F.split("_c", GO_BODY, 2), F.lit(0)), IMPORT_MARKS["go"])
    go = go.select(key, "line", F.lit("go").alias("kind"), quoted.alias("specifier"), F.when(local.isin("_", "."), none).otherwise(F.array(_pair(local, F.lit("*")))).alias("names"))
    return ecma.unionByName(from_).unionByName(plain).unionByName(java).unionByName(go)


# -- calls

ESCAPES = r"\\[\s\S]"  # taken out first, so that a quote ends a string
LITERALS = {  # language family -> strings and comments, which hold no calls
    "ecma": r"""//[^\n]*|/\*[\s\S]*?\*/|"[^"\n]*"|'[^'\n]*'""",
    "python": r'''\"\"\"[\s\S]*?\"\"\"|\'\'\'[\s\S]*?\'\'\'|"[^"\n]*"|'[^'\n]*'|#[^\n]*''',
    "java": r"""//[^\n]*|/\*[\s\S]*?\*/|"[^"\n]*"|'[^'\n]*'""",
    "go": r"""//[^\n]*|/\*[\s\S]*?\*/|"[^"\n]*"|`[^`]*`|'[^'\n]*'""",
}
CALL = r"(?:\b(?:new|function|def|func|class|record)\s+)?[A-Za-z_$][\w$]*\s*\("
NO_CALL = "and assert await case catch class constructor def del do elif else except for func function if import in is lambda new not or return super switch synchronized this throw try typeof until void while with yield".split()  # fixed values: words before a bracket that call nothing


def called(files: DataFrame, key: str, language: str, content: str) -> DataFrame:
    """``key, callee, n``: how often each name is called in each file (``a.b()`` calls b). Declarations aren't calls,
    and ``new X()`` is one in Java only; what stands in strings and comments doesn't count."""
    rows = files.select(key, family(language).alias("family"), F.col(content).alias("_c")).where("family IS NOT NULL AND _c IS NOT NULL")
    bare, plain = F.col("_c"), F.regexp_replace("_c", ESCAPES, "")
    for name, pattern in LITERALS.items():
        bare = F.when(F.col("family") == name, F.regexp_replace(plain, pattern, '""')).otherwise(bare)
    found = rows.select(key, "family", F.explode(F.regexp_extract_all(bare, F.lit(f"({CALL})"), F.lit(1))).alias("x"))
    made = found.where(~F.col("x").rlike(r"^(?:function|def|func|class|record)\s") & (~F.col("x").rlike(r"^new\s") | (F.col("family") == "java")))
    return made.select(key, F.regexp_extract("x", r"([A-Za-z_$][\w$]*)\s*\($", 1).alias("callee")).where(~F.col("callee").isin(NO_CALL)).groupBy(key, "callee").agg(F.count("*").alias("n"))


# -- declarations with their enclosing classes

MEMBERS = {"ecma": [("method", r"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{;=]+)?\{\s*$")]}
NOT_MEMBERS = ["if", "for", "while", "switch", "catch", "function", "with", "return"]  # fixed values


def declared(files: DataFrame, key: str, language: str, content: str) -> DataFrame:
    """``key, line, kind, name, qualified_name, exported``: declarations by lines, in classes by indentation.

    A declaration belongs to the classes above it that are less indented than it and everything between;
    other functions around it add nothing to its name. A function in a class is a method. Exported are what
    Python names without a leading underscore, Go with a capital, Java declares public and an ECMAScript
    line exports."""
    patterns = {f: [*options, *MEMBERS.get(f, [])] for f, options in DECLARATIONS.items()}
    rows = matches(lines(files, key, language, content).withColumn("_t", F.col("text")), key, patterns, "name", keep=["family", "_t"])
    rows = rows.where(~F.col("name").isin(NOT_MEMBERS))
    t = F.col("_t")
    exported = F.when(F.col("family") == "python", ~F.col("name").startswith("_")).when(F.col("family") == "go", F.col("name").rlike("^[A-Z]")).when(F.col("family") == "java", t.rlike(r"\bpublic\b")).otherwise(t.rlike(r"^\s*export\b"))
    receiver = F.regexp_extract(t, r"^func\s+\(\s*(?:\w+\s+)?\*?([A-Za-z_]\w*)", 1)
    indent = F.length(F.regexp_extract(F.replace(t, F.lit("\t"), F.lit("    ")), r"^( *)", 1))
    rows = rows.select(key, F.struct("line", "kind", "name", indent.alias("indent"), exported.alias("exported"), F.when(F.col("family") == "go", receiver).otherwise("").alias("receiver")).alias("d"))
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list("d")).alias("ds"))  # a file's declarations
    # a fold over them in order of lines: the classes that are open, and each declaration with their names
    entry = "struct<d:struct<line:int,kind:string,name:string,indent:int,exported:boolean,receiver:string>,path:array<string>>"
    start = F.struct(F.array().cast("array<struct<name:string,indent:int>>").alias("open"), F.array().cast(f"array<{entry}>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        open_ = F.filter(acc["open"], lambda c: c["indent"] < d["indent"])
        mine = F.when(d["kind"] == "class", F.array(F.struct(d["name"].alias("name"), d["indent"].alias("indent")))).otherwise(F.array().cast("array<struct<name:string,indent:int>>"))
        return F.struct(F.concat(open_, mine).alias("open"), F.concat(acc["out"], F.array(F.struct(d.alias("d"), F.transform(open_, lambda c: c["name"]).alias("path")).cast(entry))).alias("out"))

    flat = listed.select(key, F.explode(F.aggregate("ds", start, step, lambda a: a["out"])).alias("x")).select(key, "x.d.*", "x.path")
    path = F.when(F.col("receiver") != "", F.array("receiver")).otherwise(F.col("path"))
    kind = F.when((F.col("kind") == "function") & (F.size("path") > 0), "method").otherwise(F.col("kind"))
    return flat.select(key, "line", kind.alias("kind"), "name", F.array_join(F.concat(path, F.array("name")), ".").alias("qualified_name"), "exported")


# -- names that a file uses of packages it sees as a whole


def used(files: DataFrame, key: str, language: str, content: str) -> DataFrame:
    """``key, specifier, implicit, uses``: the names that Java and Go files use of packages, sorted.

    Java: the capitalised names of a file (outside strings, comments, imports and annotations) that it neither
    declares as classes nor imports by name; for each of its wildcard imports and, implicit, for its own
    package (``*`` where it has none), if there are any. Go: for each import with a local name, what is
    selected through that name, possibly nothing; blank and dot imports have no row."""
    rows = files.select(key, family(language).alias("family"), F.regexp_replace(content, "\r", "").alias("_c")).where("family IN ('java', 'go') AND _c IS NOT NULL")
    bare = F.when(F.col("family") == "java", F.regexp_replace(F.regexp_replace("_c", ESCAPES, ""), LITERALS["java"], '""')).otherwise(F.regexp_replace(F.regexp_replace("_c", ESCAPES, ""), LITERALS["go"], '""'))
    rows = rows.withColumn("_c", bare)
    refs = imported(files, key, language, content)

    java = rows.where("family = 'java'")
    text = F.regexp_replace(F.regexp_replace("_c", r"(?m:^)[ \t]*(?:import|package)\b[^;\n]*", ""), r"@\w+", "")
    names = java.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]\w*)"), F.lit(1)))).alias("name"))
    classes = declared(files, key, language, content).where("kind = 'class'").select(key, "name")
    bound = refs.where("kind = 'java'").select(key, F.explode("names.local_name").alias("name"))
    foreign = names.join(classes.unionByName(bound).distinct(), [key, "name"], "left_anti").groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("uses"))
    package = F.regexp_extract("_c", r"(?m:^)[ \t]*package[ \t]+([\w.]+)", 1)
    own = java.select(key, F.when(package != "", F.concat(package, F.lit(".*"))).otherwise("*").alias("specifier"), F.lit(True).alias("implicit"))
    wild = refs.where("kind = 'java' AND specifier LIKE '%.*'").select(key, "specifier", F.lit(False).alias("implicit"))
    of_java = own.unionByName(wild).distinct().join(foreign, key).select(key, "specifier", "implicit", "uses")

    pairs = rows.where("family = 'go'").select(key, F.explode(F.array_distinct(F.regexp_extract_all("_c", F.lit(r"\b(\w+\.[A-Za-z_]\w*)"), F.lit(1)))).alias("x"))
    pairs = pairs.select(key, F.substring_index("x", ".", 1).alias("local"), F.substring_index("x", ".", -1).alias("name"))
    locals_ = refs.where("kind = 'go'").select(key, "specifier", F.explode("names.local_name").alias("local")).distinct()
    of_go = locals_.join(pairs, [key, "local"], "left").groupBy(key, "specifier").agg(F.array_sort(F.collect_set("name")).alias("uses"))
    return of_java.unionByName(of_go.select(key, "specifier", F.lit(False).alias("implicit"), "uses"))
