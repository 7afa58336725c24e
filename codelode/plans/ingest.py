"""Queries over repositories' addresses, files and their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import exprs as X
from codelode.operators import extract as P
from codelode.plans.catalogue import query
from codelode.sources import remote
from codelode.session import table


def _case(exprs: dict, name: str) -> str:
    """The patterns of ``extract`` as SQL."""
    out = "CASE"
    for fam, options in exprs.items():
        for i, (kind, pattern) in enumerate(options):
            p = pattern.replace("'", "''")
            out += f" WHEN family = '{fam}' AND regexp_extract(text, '{p}', 1) <> '' THEN {{'kind': '{kind}', 'v': regexp_extract(text, '{p}', 1)}}"
    return out + " END AS m"


# files with the language of their label, or of their extension where there is none
_SOURCES = """(SELECT *, coalesce(lower(language), CASE lower(regexp_extract(path, '[.]([^./]+)$', 1)) WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript'
 WHEN 'ts' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'cts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' END) AS lang FROM source_files)"""


def sources(spark, d):
    f = table(spark, d, "source_files").select("file_id", "path", "language", "content")
    return f.withColumn("language", F.coalesce(F.lower("language"), X.language_of("path")))


_SQL_LINES = f"""s AS (SELECT file_id, CASE WHEN lang IN ('javascript', 'typescript', 'tsx') THEN 'ecma' WHEN lang IN ('python', 'java', 'go') THEN lang END AS family, string_split(replace(content, chr(13), ''), chr(10)) AS ls FROM {_SOURCES} WHERE content IS NOT NULL),
l AS (SELECT file_id, family, unnest(ls) AS text, generate_subscripts(ls, 1)::INT AS line FROM s WHERE family IS NOT NULL)"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SQL_IMPORTS = rf"""src AS (SELECT file_id, CASE WHEN lang IN ('javascript', 'typescript', 'tsx') THEN 'ecma' WHEN lang IN ('python', 'java', 'go') THEN lang END AS fam, replace(content, chr(13), '') AS c FROM {_SOURCES} WHERE content IS NOT NULL),
tx AS (SELECT file_id, fam, CASE fam WHEN 'ecma' THEN regexp_replace(c, {_sql(P.COMMENT_LINES)}, '', 'g') WHEN 'go' THEN regexp_split_to_array(c, {_sql(P.GO_BODY)})[1] ELSE c END AS c FROM src WHERE fam IS NOT NULL),
mk AS (SELECT file_id, fam, string_split(CASE fam {" ".join(f"WHEN '{f}' THEN regexp_replace(c, {_sql('(' + m + ')')}, chr(1) || '" + chr(92) + "1', 'g')" for f, m in P.IMPORT_MARKS.items())} END, chr(1)) AS p FROM tx),
pc AS (SELECT file_id, fam, p, unnest(range(2, len(p) + 1)) AS i FROM mk),
mt AS (SELECT file_id, fam, 1 + length(array_to_string(p[1:i - 1], '')) - length(replace(array_to_string(p[1:i - 1], ''), chr(10), '')) AS line,
  CASE fam {" ".join(f"WHEN '{f}' THEN regexp_extract(p[i], {_sql('^(?:' + m + ')')})" for f, m in P.IMPORT_MARKS.items())} END AS m FROM pc),
qu AS (SELECT *, regexp_extract(m, '["'']([^"''\n]+)["'']', 1) AS q, regexp_extract(m, '^import\s+(?:type\s+)?([\s\S]*?)\s*\bfrom\s*["'']', 1) AS cl FROM mt),
ec AS (SELECT file_id, line, CASE WHEN starts_with(m, 'require') THEN 'require' WHEN regexp_matches(m, '^import\s*\(') THEN 'dynamic' ELSE 'esm' END AS kind, q AS specifier,
  list_concat(list_concat(CASE WHEN regexp_matches(cl, '^[\w$]+\s*(,|$)') THEN [regexp_extract(cl, '^([\w$]+)', 1) || '<default'] ELSE [] END, CASE WHEN regexp_matches(cl, '\*\s*as\s+[\w$]+') THEN [regexp_extract(cl, '\*\s*as\s+([\w$]+)', 1) || '<*'] ELSE [] END),
   list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_extract(cl, '\{{([^}}]*)\}}', 1), '//[^\n]*|/\*[\s\S]*?\*/', '', 'g'), ','), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', ''), '^type\s+', '')), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '^[\w$.]+\s+as\s+[\w$]+$') THEN regexp_extract(x, 'as\s+([\w$]+)$', 1) || '<' || regexp_extract(x, '^([\w$.]+)', 1) ELSE regexp_extract(x, '^([\w$.*]+)', 1) || '<' || regexp_extract(x, '^([\w$.*]+)', 1) END)) AS names FROM qu WHERE fam = 'ecma'),
pf AS (SELECT file_id, line, regexp_extract(m, '^[ \t]*from[ \t]+([.\w]+)', 1) AS o, m FROM mt WHERE fam = 'python'),
pi AS (SELECT file_id, line, o, unnest(CASE WHEN o <> '' THEN [regexp_replace(m, '^[ \t]*from[ \t]+[.\w]+[ \t]+import[ \t]+', '')] ELSE string_split(regexp_replace(m, '^[ \t]*import[ \t]+', ''), ',') END) AS x FROM pf),
py AS (SELECT file_id, line, 'python' AS kind, CASE WHEN o <> '' THEN o ELSE regexp_extract(trim(x), '^([\w.]+)', 1) END AS specifier,
  list_transform(list_filter(list_transform(string_split(replace(replace(regexp_replace(x, '#[^\n]*', '', 'g'), '(', ''), ')', ''), ','), lambda y: regexp_replace(regexp_replace(y, '^\s+', ''), '\s+$', '')), lambda y: y <> ''),
   lambda y: CASE WHEN regexp_matches(y, '^[\w$.]+\s+as\s+[\w$]+$') THEN regexp_extract(y, 'as\s+([\w$]+)$', 1) ELSE string_split(regexp_extract(y, '^([\w$.*]+)', 1), '.')[-1] END || '<' || regexp_extract(y, '^([\w$.*]+)', 1)) AS names FROM pi WHERE o <> '' OR regexp_matches(x, '\w')),
ja AS (SELECT file_id, line, 'java' AS kind, regexp_extract(m, '([\w.]+(?:\.\*)?)[ \t]*;$', 1) AS specifier, CASE WHEN regexp_matches(m, '\*[ \t]*;$') THEN [] ELSE [regexp_extract(m, '(\w+)[ \t]*;$', 1) || '<' || regexp_extract(m, '(\w+)[ \t]*;$', 1)] END AS names FROM mt WHERE fam = 'java'),
ga AS (SELECT file_id, line, q, regexp_extract(m, '^[ \t]*(?:import[ \t]+)?([\w.]+)[ \t]+"', 1) AS a, list_filter(string_split(q, '/'), lambda x: NOT regexp_full_match(x, 'v[0-9]+'))[-1] AS l FROM qu WHERE fam = 'go'),
go AS (SELECT file_id, line, 'go' AS kind, q AS specifier, CASE WHEN a IN ('_', '.') THEN [] WHEN a NOT IN ('', 'import') THEN [a || '<*'] ELSE [regexp_replace(regexp_replace(regexp_replace(l, '\.v[0-9]+$', ''), '^go-', ''), '[-.]', '_', 'g') || '<*'] END AS names FROM ga),
im AS (SELECT * FROM ec UNION ALL SELECT * FROM py UNION ALL SELECT * FROM ja UNION ALL SELECT * FROM go)"""


@query("WITH " + SQL_IMPORTS + " SELECT file_id, line, kind, specifier, array_to_string(names, ',') AS names FROM im")
def parse_imports(spark, d):
    """Imports from the texts, over several lines too, with the names they bind."""
    i = P.imported(sources(spark, d), "file_id", "language", "content")
    return i.select("file_id", "line", "kind", "specifier", F.array_join(F.transform("names", lambda x: F.concat(x["local_name"], F.lit("<"), x["imported_name"])), ",").alias("names"))


SQL_FAMILY = f"src AS (SELECT file_id, CASE WHEN lang IN ('javascript', 'typescript', 'tsx') THEN 'ecma' WHEN lang IN ('python', 'java', 'go') THEN lang END AS fam, content AS c FROM {_SOURCES} WHERE content IS NOT NULL)"
SQL_BARE = "b AS (SELECT file_id, fam, CASE fam " + " ".join(f"WHEN '{f}' THEN regexp_replace(regexp_replace(c, {_sql(P.ESCAPES)}, '', 'g'), {_sql(m)}, '\"\"', 'g')" for f, m in P.LITERALS.items()) + " END AS c FROM src WHERE fam IS NOT NULL)"


@query(f"WITH {SQL_FAMILY}, {SQL_BARE}, x AS (SELECT file_id, fam, unnest(regexp_extract_all(c, {_sql(P.CALL)})) AS x FROM b)," + r"""
y AS (SELECT file_id, regexp_extract(x, '([A-Za-z_$][\w$]*)\s*\($', 1) AS callee FROM x WHERE NOT regexp_matches(x, '^(function|def|func|class|record)\s') AND (fam = 'java' OR NOT regexp_matches(x, '^new\s')))
SELECT file_id, callee, count(*) AS n FROM y WHERE callee NOT IN (""" + ", ".join(f"'{w}'" for w in P.NO_CALL) + ") GROUP BY ALL")  # fmt: skip
def parse_calls(spark, d):
    """Names called in each file's text."""
    return P.called(sources(spark, d), "file_id", "language", "content")


SQL_SYMBOLS = "WITH " + _SQL_LINES + f", x0 AS (SELECT file_id, family, line, text, {_case({f: [*o, *P.MEMBERS.get(f, [])] for f, o in P.DECLARATIONS.items()}, 'name')} FROM l), x AS (SELECT file_id, family, line, text, m.kind AS kind, m.v AS name, length(regexp_extract(replace(text, chr(9), '    '), '^( *)', 1)) AS indent FROM x0 WHERE m IS NOT NULL AND m.v NOT IN (" + ", ".join(f"'{w}'" for w in P.NOT_MEMBERS) + r""")),
c AS (SELECT a.file_id, a.line, c.line AS cl, c.name FROM x a JOIN x c ON c.file_id = a.file_id AND c.kind = 'class' AND c.line < a.line AND c.indent < a.indent AND NOT EXISTS (FROM x e WHERE e.file_id = a.file_id AND e.line > c.line AND e.line < a.line AND e.indent <= c.indent)),
p AS (SELECT file_id, line, string_agg(name, '.' ORDER BY cl) AS path FROM c GROUP BY ALL),
r AS (SELECT x.*, CASE WHEN family = 'go' AND regexp_matches(text, '^func\s+\(') THEN regexp_extract(text, '^func\s+\(\s*(?:\w+\s+)?\*?([A-Za-z_]\w*)', 1) ELSE p.path END AS q, p.path FROM x LEFT JOIN p USING (file_id, line))
SELECT file_id, line, CASE WHEN kind = 'function' AND path IS NOT NULL THEN 'method' ELSE kind END AS kind, name, coalesce(q || '.', '') || name AS qualified_name,
 CASE family WHEN 'python' THEN NOT starts_with(name, '_') WHEN 'go' THEN regexp_matches(name, '^[A-Z]') WHEN 'java' THEN regexp_matches(text, '\bpublic\b') ELSE regexp_matches(text, '^\s*export\b') END AS exported FROM r"""


@query(SQL_SYMBOLS)
def parse_symbols(spark, d):
    """Declarations from the texts with the classes around them."""
    return P.declared(sources(spark, d), "file_id", "language", "content")


@query("WITH sy AS (" + SQL_SYMBOLS + "), " + SQL_IMPORTS + """, bare AS (SELECT file_id, CASE fam WHEN 'java' THEN """ + f"regexp_replace(regexp_replace(c, {_sql(P.ESCAPES)}, '', 'g'), {_sql(P.LITERALS['java'])}, '\"\"', 'g') ELSE regexp_replace(regexp_replace(c, {_sql(P.ESCAPES)}, '', 'g'), {_sql(P.LITERALS['go'])}, '\"\"', 'g') END AS c, fam" + r""" FROM src WHERE fam IN ('java', 'go')),
ty AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(c, '(?m:^)[ \t]*(?:import|package)\b[^;\n]*', '', 'g'), '@\w+', '', 'g'), '\b([A-Z]\w*)', 1)) AS name FROM bare WHERE fam = 'java'),
kn AS (SELECT file_id, name FROM sy WHERE kind = 'class' UNION SELECT file_id, string_split(unnest(names), '<')[1] FROM ja),
us AS (SELECT file_id, list_sort(list(name)) AS uses FROM ty ANTI JOIN kn USING (file_id, name) GROUP BY 1),
pk AS (SELECT file_id, regexp_extract(c, '(?m:^)[ \t]*package[ \t]+([\w.]+)', 1) AS p FROM bare WHERE fam = 'java'),
rf AS (SELECT file_id, CASE WHEN p <> '' THEN p || '.*' ELSE '*' END AS specifier, true AS implicit FROM pk UNION SELECT file_id, specifier, false FROM ja WHERE ends_with(specifier, '.*')),
lo AS (SELECT DISTINCT file_id, specifier, string_split(unnest(names), '<')[1] AS loc FROM go),
pr AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(c, '\b(\w+\.[A-Za-z_]\w*)', 1)) AS x FROM bare WHERE fam = 'go')
SELECT file_id, specifier, implicit, array_to_string(uses, ',') AS uses FROM rf JOIN us USING (file_id)
UNION ALL SELECT lo.file_id, lo.specifier, false, coalesce(string_agg(DISTINCT split_part(x, '.', 2), ',' ORDER BY split_part(x, '.', 2)), '') FROM lo LEFT JOIN pr ON pr.file_id = lo.file_id AND split_part(pr.x, '.', 1) = lo.loc GROUP BY lo.file_id, lo.specifier""")
def parse_uses(spark, d):
    """Names that Java and Go files use of packages, from the texts."""
    u = P.used(sources(spark, d), "file_id", "language", "content")
    return u.select("file_id", "specifier", "implicit", F.array_join("uses", ",").alias("uses"))


@query("WITH " + _SQL_LINES + f", x AS (SELECT file_id, line, {_case(P.DECLARATIONS, 'fn_name')} FROM l) SELECT file_id, line, m.kind AS kind, m.v AS fn_name FROM x WHERE m IS NOT NULL")
def parse_declarations(spark, d):
    return P.matches(P.lines(sources(spark, d), "file_id", "language", "content"), "file_id", P.DECLARATIONS, "fn_name")


@query("SELECT file_id, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) END AS loc FROM source_files WHERE content IS NOT NULL")
def loc_count(spark, d):
    return table(spark, d, "source_files").where("content IS NOT NULL").select("file_id", P.loc("content").alias("loc"))


@query("""SELECT file_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'mts' THEN 'typescript'
 WHEN 'cts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' END AS language FROM source_files""")
def ext_language_map(spark, d):
    return table(spark, d, "source_files").select("file_id", X.language_of("path").alias("language"))


@query("""SELECT repo_id, regexp_matches(source_url, '(?i)^(https?|git|ssh)://') OR regexp_matches(source_url, '^[\\w.\\-]+@[\\w.\\-]+:') AS is_url, regexp_replace(regexp_extract(regexp_replace(source_url, '/+$', ''), '([^/:]+)$', 1), '\\.git$', '') AS name,
 regexp_replace(regexp_replace(source_url, '^([A-Za-z][A-Za-z0-9+.\\-]*://)', '\\1' || owner || ':pw-' || repo_id || '@'), '^([A-Za-z][A-Za-z0-9+.\\-]*://)[^/@\\s]+@', '\\1<redacted>@') AS redacted FROM repos""")
def repo_addresses(spark, d):
    """Addresses told from paths, their last names, and a user and password hidden again."""
    r = table(spark, d, "repos")
    secret = F.concat(F.regexp_extract("source_url", r"^([A-Za-z][A-Za-z0-9+.\-]*://)", 1), F.col("owner"), F.lit(":pw-"), F.col("repo_id"), F.lit("@"), F.regexp_replace("source_url", r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""))
    return r.select("repo_id", X.is_repo_url("source_url").alias("is_url"), X.repo_name("source_url").alias("name"), X.redact_url(secret).alias("redacted"))


@query("""SELECT repo_id, array_to_string(list_filter(list_transform(string_split(replace(regexp_replace(regexp_replace(regexp_replace(source_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://', ''), '^[^/@]+@', ''), '\\.git/?$', ''), ':', '/'), '/'),
 lambda s: regexp_replace(s, '[^A-Za-z0-9._\\-]', '_', 'g')), lambda s: NOT regexp_full_match(s, '\\.*')), '/') AS folder FROM repos""")
def repo_cache_dir(spark, d):
    return table(spark, d, "repos").select("repo_id", X.cache_folder("source_url").alias("folder"))


@query("""SELECT doc_id, sha256(regexp_replace(text, '([A-Za-z][A-Za-z0-9+.\\-]*://)[^/@\\s]+@', '\\1<redacted>@', 'g')) AS hash FROM documents WHERE text IS NOT NULL""")
def redact_text(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(X.redact_urls("text"), 256).alias("hash"))


@query("SELECT file_id, length(content) - length(replace(content, s.path, '')) AS removed, sha256(replace(content, s.path, '<redacted>')) AS hash FROM source_files s WHERE content IS NOT NULL")
def redact_secret(spark, d):
    """A secret (here each file's own path) hidden wherever its text shows it."""
    s = table(spark, d, "source_files").where("content IS NOT NULL")
    return s.select("file_id", (F.length("content") - F.length(F.replace("content", F.col("path"), F.lit("")))).cast("long").alias("removed"), F.sha2(X.redact_secret("content", "path"), 256).alias("hash"))


@query("""SELECT repo_id, owner, repo_name, nullif(license, 'NOASSERTION') AS license, nullif(description, '') AS description, CASE WHEN archived THEN true END AS archived, stars,
 CASE WHEN stars >= 1000000 THEN regexp_replace(printf('%.1f', floor(stars / 1000000 * 10 + 0.5) / 10), '\\.0$', '') || 'M' WHEN stars >= 1000 THEN regexp_replace(printf('%.1f', floor(stars / 1000 * 10 + 0.5) / 10), '\\.0$', '') || 'K' ELSE stars::VARCHAR END AS stars_short FROM repos""")
def repo_info(spark, d):
    """The hosting service's fields with empty, unknown and false ones dropped."""
    r = table(spark, d, "repos")
    return r.select("repo_id", "owner", "repo_name", F.nullif("license", F.lit("NOASSERTION")).alias("license"), F.nullif("description", F.lit("")).alias("description"), F.when(F.col("archived"), True).alias("archived"), "stars", X.compact_count("stars").alias("stars_short"))


@query("SELECT doc_id, length(text) > 6000 AS truncated, sha256(text[1:6000]) AS hash FROM documents WHERE text IS NOT NULL")
def truncate_source(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (F.length(t) > 6000).alias("truncated"), F.sha2(F.substring(t, 1, 6000), 256).alias("hash"))


@query("""WITH s AS (SELECT DISTINCT trim(specifier) AS specifier FROM import_refs WHERE kind = 'go' AND trim(specifier) <> '.'), p AS (SELECT specifier, list_filter(string_split(specifier, '/'), lambda x: NOT regexp_full_match(x, 'v[0-9]+'))[-1] AS last FROM s)
SELECT specifier, regexp_replace(regexp_replace(regexp_replace(last, '\\.v[0-9]+$', ''), '^go-', ''), '[-.]', '_', 'g') AS local_name FROM p""")
def go_package_name(spark, d):
    """The name a Go package goes by, from its path."""
    s = table(spark, d, "import_refs").where("kind = 'go'").select(F.trim("specifier").alias("specifier")).where("specifier <> '.'").distinct()
    last = F.element_at(F.filter(F.split("specifier", "/"), lambda x: ~x.rlike(r"^v[0-9]+$")), -1)
    return s.select("specifier", F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.v[0-9]+$", ""), "^go-", ""), "[-.]", "_").alias("local_name"))


@query(r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, l, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: regexp_matches(x, '^(?i:fatal|error|remote|warning):')) AS good FROM t)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(CASE WHEN len(good) > 0 THEN good[1:3] ELSE l[1:3] END, ' ')[1:300], '([A-Za-z][A-Za-z0-9+.\-]*://)[^/@\s]+@', '\1<redacted>@', 'g'), '^\s+', ''), '\s+$', '') AS detail FROM u""")
def error_details(spark, d):
    """Of each text read as the output of a failed command: the first three lines that begin by saying what went
    wrong, else the first three, at most 300 characters without passwords."""
    l = F.split(X.trim_ws("text"), "\n", -1)  # noqa: E741
    good = F.filter(F.transform(l, lambda x: X.trim_ws(x)), lambda x: x.rlike(r"(?i)^(fatal|error|remote|warning):"))
    some = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", l.alias("l"), good.alias("good"))
    chosen = F.when(F.size("good") > 0, F.slice("good", 1, 3)).otherwise(F.slice("l", 1, 3))
    return some.withColumn("cut", F.substring(F.array_join(chosen, " "), 1, 300)).select("doc_id", X.trim_ws(X.redact_urls("cut")).alias("detail"))


@query(r"""WITH x AS (SELECT repo_id, source_url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/@\s]+@)?git\.example[:/]([^/\s]+)/([^/\s]+?)(?:\.git)?/?$' AS p FROM repos)
SELECT repo_id, CASE WHEN regexp_matches(source_url, p) THEN regexp_extract(source_url, p, 1) END AS owner, CASE WHEN regexp_matches(source_url, p) THEN regexp_extract(source_url, p, 2) END AS name FROM x""")
def parse_remote(spark, d):
    x = table(spark, d, "repos").select("repo_id", remote.owner_and_name("source_url", "git.example").alias("r"))
    return x.select("repo_id", "r.owner", "r.name")
