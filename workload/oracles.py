"""The registered queries as plain SQL, written from the definitions.

Each text is a chain of named sub-queries; :func:`_sql` picks those a query needs.
"""

from __future__ import annotations

import re

from doclumen import fixed_values as fv
from workload import inputs


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _any_fragment(fragments: list[str]) -> str:
    return "(" + " OR ".join(f"contains(path, {_lit(f)})" for f in fragments) + ")"


_SKIP = {
    "cli": _any_fragment(fv.CLI_SKIP_FRAGMENTS),
    "api": _any_fragment(fv.API_SKIP_FRAGMENTS),
    "config": _any_fragment(fv.CONFIG_SKIP_FRAGMENTS),
    "symbols": f"""(len(list_intersect(string_split(path, '/'), {_list(fv.SYMBOL_SKIP_PARTS)})) > 0
        OR regexp_matches(path, '(^|/)(test_|conftest)[^/]*$') OR path LIKE '%\\_test.py' ESCAPE '\\')""",
}


def _matches(
    kind: str, regex: str, guard: str, tail: int = 0, flags: str = "", source: str = "src",
    pattern: str | None = None, groups: int | None = None, extra: str = "",
) -> str:
    """Rows ``project, path, content, i, g1.., line, tail`` of a pattern's matches."""
    p = pattern or _lit(flags + regex)
    groups = re.compile(regex).groups if groups is None else groups
    taken = "".join(f", regexp_extract_all(content, {p}, {g}) AS a{g}" for g in range(1, groups + 1))
    shown = "".join(f", coalesce(a{g}[i], '') AS g{g}" for g in range(1, groups + 1))
    return f"""(
    SELECT project, path, content{extra}, i{shown},
        1 + len(before) - len(replace(before, chr(10), '')) AS line,
        substr(content, len(before) + len(whole[i]) + 1, {max(tail, 1)}) AS tail
    FROM (SELECT *, array_to_string(list_transform(range(1, i + 1),
              lambda k: gaps[k] || CASE WHEN k < i THEN whole[k] ELSE '' END), '') AS before
          FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i
                FROM (SELECT *, regexp_extract_all(content, {p}, 0) AS whole,
                          string_split_regex(content, {p}) AS gaps{taken}
                      FROM {source} WHERE NOT {_SKIP[kind]} AND ({guard})) m) n) o)"""


def _kebab(name: str) -> str:
    return f"replace({name}, '_', '-')"


def _tail_group(regex: str, column: str = "tail") -> str:
    return f"nullif(regexp_extract({column}, {_lit(regex)}, 1), '')"


_COMMAND_NAME = f"""coalesce({_tail_group(fv.CLICK_NAME_ARGUMENT)},
    {_kebab(_tail_group(fv.CLICK_FUNCTION))})"""
_CLI = [
    ("argparse", 0, f"""SELECT project, path, g1 AS name, line, i AS o1, 0 AS o2
        FROM {_matches('cli', fv.ARGPARSE_SUBCOMMAND, 'true')} x"""),
    ("argparse", 1, f"""SELECT project, path, g1 AS name, line, i AS o1, 0 AS o2
        FROM {_matches('cli', fv.ARGPARSE_PROG, 'true')} x"""),
    ("click", 2, f"""SELECT project, path, {_COMMAND_NAME} AS name, line, i AS o1, 0 AS o2
        FROM {_matches('cli', fv.CLICK_COMMAND, 'true', fv.CLICK_LOOKAHEAD)} x
        WHERE {_COMMAND_NAME} IS NOT NULL AND NOT contains({_COMMAND_NAME}, '=')
            AND NOT starts_with({_COMMAND_NAME}, '_')"""),
    ("click", 3, f"""SELECT project, path, coalesce({_tail_group(fv.FUNCTION_NAME)}, 'cli') AS name,
            line, i AS o1, 0 AS o2
        FROM {_matches('cli', fv.CLICK_GROUP, 'true', fv.CLICK_GROUP_LOOKAHEAD)} x"""),
    ("typer", 4, f"""SELECT project, path,
            coalesce(nullif(g1, ''), {_kebab(_tail_group(fv.FUNCTION_NAME))}, 'unknown') AS name,
            line, n AS o1, i AS o2
        FROM {_matches(
            'cli', '', "true", fv.TYPER_LOOKAHEAD, source='typer_apps', groups=1, extra=', n',
            pattern="'@' || app || " + _lit(fv.TYPER_COMMAND_AFTER_APP))} x"""),
    ("fire", 5, f"""SELECT project, path, {_kebab('name')} AS name, line, i AS o1, k AS o2 FROM (
        SELECT project, path, line, i, unnest(names) AS name, generate_subscripts(names, 1) AS k FROM (
            SELECT *, CASE WHEN regexp_matches(content, 'class\\s+' || g1 || '\\s*.*?:')
                THEN list_filter(regexp_extract_all(content, {_lit(fv.FIRE_METHOD)}, 1),
                    lambda m: NOT starts_with(m, '_'))
                ELSE [g1] END AS names
            FROM {_matches('cli', fv.FIRE_CALL, 'true')} x) y) z"""),
]
_VERB_ROWS = " UNION ALL ".join(
    f"""SELECT project, path, g1 AS endpoint_path, '{verb.upper()}' AS method,
        coalesce({_tail_group(fv.ASYNC_FUNCTION_NAME)}, '') AS name, line, {v} AS o1, i AS o2
    FROM {_matches(
        'api', fv.FASTAPI_ROUTE_BEFORE_VERB + verb + fv.FASTAPI_ROUTE_AFTER_VERB,
        "contains(lower(content), 'fastapi') OR contains(content, '@app.') OR contains(content, '@router.')",
        fv.ROUTE_LOOKAHEAD, flags='(?i)')} x"""
    for v, verb in enumerate(fv.HTTP_VERBS)
)
_API = [
    ("fastapi", 0, _VERB_ROWS),
    ("flask", 1, f"""SELECT project, path, g1 AS endpoint_path, upper(m) AS method, name, line, i AS o1, k AS o2
        FROM (SELECT *, unnest(methods) AS m, generate_subscripts(methods, 1) AS k FROM (
            SELECT *, coalesce({_tail_group(fv.FUNCTION_NAME)}, '') AS name,
                CASE WHEN len(regexp_extract_all(g2, {_lit(fv.QUOTED_WORD)}, 1)) > 0
                    THEN regexp_extract_all(g2, {_lit(fv.QUOTED_WORD)}, 1) ELSE ['GET'] END AS methods
            FROM {_matches(
                'api', fv.FLASK_ROUTE,
                "contains(lower(content), 'flask') OR contains(content, '@app.route')",
                fv.ROUTE_LOOKAHEAD)} x) y) z"""),
    ("django", 2, f"""SELECT project, path,
            CASE WHEN starts_with(g1, '/') THEN g1 ELSE '/' || g1 END AS endpoint_path, '*' AS method,
            regexp_extract(tail, {_lit(fv.DJANGO_VIEW)}, 1) AS name, line, i AS o1, 0 AS o2
        FROM {_matches('api', fv.DJANGO_PATH, "contains(content, 'urlpatterns')", fv.DJANGO_LOOKAHEAD)} x"""),
]
_GETENV_DEFAULT = "trim(trim(g2, ' ' || chr(9) || chr(10)), '''\"')"
_SETTINGS_GUARD = f"""(contains(content, 'BaseSettings') OR contains(content, 'pydantic_settings'))
    AND regexp_matches(content, {_lit(fv.SETTINGS_CLASS)})"""
_VALUE = "trim(g2, ' ' || chr(9))"
_CONFIG = [
    ("env_var", 0, f"""SELECT project, path, g1 AS name, {_GETENV_DEFAULT} AS "default",
            {_GETENV_DEFAULT} = '' AS required, line, i AS o1, 0 AS o2
        FROM {_matches('config', fv.GETENV, 'true')} x"""),
    ("env_var", 1, f"""SELECT project, path, g1 AS name, '' AS "default", true AS required, line, i AS o1, 0 AS o2
        FROM {_matches('config', fv.ENVIRON, 'true')} x"""),
    ("pydantic_setting", 2, f"""SELECT project, path, g2 AS name, '' AS "default", false AS required,
            line, i AS o1, 0 AS o2
        FROM {_matches('config', fv.SETTINGS_FIELD_ENV, _SETTINGS_GUARD)} x"""),
    ("pydantic_setting", 3, f"""SELECT project, path, g1 AS name, '' AS "default", false AS required,
            line, i AS o1, 0 AS o2
        FROM {_matches('config', fv.SETTINGS_BARE_FIELD, _SETTINGS_GUARD, flags='(?m)')} x"""),
    ("django_setting", 4, f"""SELECT project, path, g1 AS name,
            CASE WHEN len({_VALUE}) < 50 THEN {_VALUE} ELSE substr({_VALUE}, 1, 47) || '...' END AS "default",
            false AS required, line, i AS o1, 0 AS o2
        FROM {_matches(
            'config', fv.SETTINGS_ASSIGNMENT,
            "contains(path, 'settings.py') OR contains(content, 'DJANGO_SETTINGS')", flags='(?m)')} x
        WHERE g1 NOT IN ('TRUE', 'FALSE', 'NONE') AND NOT contains(g2, 'import')"""),
]
_POS = "cast(row_number() OVER (PARTITION BY project, path ORDER BY o1, o2) - 1 AS int) AS pos"


def _cli(ranks: list[int]) -> str:
    return " UNION ALL ".join(
        f"""SELECT project, name, '{framework}' AS framework, path, cast(line AS int) AS line,
            '' AS help_text, {rank} AS extractor_rank, {_POS} FROM ({rows}) f{rank}"""
        for framework, rank, rows in _CLI
        if rank in ranks
    )


def _api(ranks: list[int]) -> str:
    return " UNION ALL ".join(
        f"""SELECT project, endpoint_path, method, '{framework}' AS framework, path,
            cast(line AS int) AS line, name, {rank} AS extractor_rank, {_POS} FROM ({rows}) f{rank}"""
        for framework, rank, rows in _API
        if rank in ranks
    )


def _config(ranks: list[int]) -> str:
    return " UNION ALL ".join(
        f"""SELECT project, name, '{type_}' AS type, path, cast(line AS int) AS line, "default", required,
            {rank} AS extractor_rank, {_POS} FROM ({rows}) f{rank}"""
        for type_, rank, rows in _CONFIG
        if rank in ranks
    )


# -- named sub-queries, in order of dependence --

_FORMS = """[lower(term), replace(replace(lower(term), '-', ' '), '_', ' '),
    replace(lower(term), '-', '_'), replace(lower(term), '_', '-')]"""
_MOON = """CASE WHEN {0} >= 0.85 THEN '🌕' WHEN {0} >= 0.70 THEN '🌔' WHEN {0} >= 0.50 THEN '🌓'
    WHEN {0} >= 0.30 THEN '🌒' ELSE '🌑' END"""
_ORD = "CASE category " + " ".join(
    f"WHEN {_lit(c)} THEN {i}" for i, c in enumerate(fv.CATEGORIES, 1)
) + " END"


def _status(strict: bool) -> str:
    symbol = "category IN ('Classes', 'Public Functions')"
    mentioned = "len(list_filter(terms, lambda t: list_contains(h.found, t))) > 0"
    documented = (
        f"CASE WHEN {symbol} THEN docstring <> '' ELSE coalesce({mentioned}, false) END"
        if strict
        else f"docstring <> '' OR coalesce({mentioned}, false)"
    )
    return f"""SELECT f.*, {documented} AS documented FROM features f
        LEFT JOIN (SELECT project, list(term) AS found FROM hits GROUP BY project) h ON f.project = h.project"""


_CATEGORIES = f"""SELECT project, category, count(*) AS total,
    count(*) FILTER (WHERE documented) AS documented,
    count(*) FILTER (WHERE documented) / count(*) AS coverage,
    list(label ORDER BY path, extractor_rank, pos) FILTER (WHERE NOT documented) AS missing,
    {_ORD} AS ord
    FROM status GROUP BY project, category"""

_ADVICE = """SELECT project, 'Document ' || category || ': ' || array_to_string(
        missing[1:3] || CASE WHEN len(missing) > 3
            THEN ['...and ' || (len(missing) - 3) || ' more'] ELSE [] END, ', ') AS recommendation,
    cast(row_number() OVER (PARTITION BY project ORDER BY coverage, ord) - 1 AS int) AS position
    FROM categories WHERE coverage < 0.70 AND len(missing) > 0
    UNION ALL
    SELECT project, 'Add discoverable features to your project', 0 FROM projects
    WHERE project NOT IN (SELECT project FROM categories)"""

_TOTALS = """SELECT p.project, coalesce(sum(total), 0)::BIGINT AS total_features,
    coalesce(sum(documented), 0)::BIGINT AS documented_features,
    sum(documented) / sum(total) AS covered
    FROM projects p LEFT JOIN categories c ON p.project = c.project GROUP BY p.project"""

_ASSESSED = f"""SELECT project,
    CASE WHEN covered IS NULL THEN 0.0::DOUBLE ELSE least(0.95::DOUBLE, covered * 1.1::DOUBLE) END AS know,
    CASE WHEN covered IS NULL THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, 1.0::DOUBLE - covered) END AS uncertainty,
    coalesce(covered, 0.0::DOUBLE) AS overall_coverage, total_features, documented_features,
    CASE WHEN covered IS NULL THEN 'No features discovered'
        WHEN covered >= 0.80 THEN 'Documentation is comprehensive'
        WHEN covered >= 0.60 THEN 'Documentation has notable gaps'
        WHEN covered >= 0.40 THEN 'Significant features undocumented'
        WHEN covered >= 0.20 THEN 'Major documentation debt'
        ELSE 'Critical: Most features undocumented' END AS assessment,
    {_MOON.format('coalesce(covered, 0)')} AS moon FROM totals"""

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _fold() -> dict[str, str]:
    steps = {
        "kw0": f"""SELECT query_id, project, topic, question, query, list_distinct(list_filter(
            list_transform(string_split_regex(lower(query), '{_SPACE}+'), lambda w: trim(w, '?.,!')),
            lambda w: len(w) > 2 AND NOT list_contains({_list(fv.STOP_WORDS)}, w))) AS words
            FROM (SELECT *, coalesce(nullif(topic, ''), nullif(question, '')) AS query FROM queries) q""",
    }
    for step, (key, synonyms) in enumerate(fv.TOPIC_ALIASES.items(), 1):
        touched = f"""len(list_filter(words, lambda w: contains({_lit(key)}, w) OR contains(w, {_lit(key)})
            OR len(list_filter({_list(synonyms)}, lambda s: starts_with(s, w) OR starts_with(w, s))) > 0)) > 0"""
        steps[f"kw{step}"] = f"""SELECT query_id, project, topic, question, query, CASE WHEN {touched}
            THEN list_distinct(list_concat(words, {_list(synonyms)})) ELSE words END AS words FROM kw{step - 1}"""
    steps["asked"] = f"""SELECT query_id, project, topic, question, query,
        CASE WHEN len(words) > 0 THEN list_sort(words) ELSE [lower(query)] END AS keywords
        FROM kw{len(fv.TOPIC_ALIASES)}"""
    return steps


_TENTHS = """least((len({0}) - len(replace({0}, {1}, ''))) // len({1}), 10)
    + CASE WHEN contains({0}, '# ' || {1}) THEN 5 ELSE 0 END"""

_NAMED = {
    "files": inputs.duck_files(inputs.FILES),
    "code": inputs.duck_files(inputs.CODE_FILES),
    "src": "SELECT * FROM code WHERE path LIKE '%.py'",
    "projects": "SELECT DISTINCT project FROM files",
    "queries": inputs.duck_sql(inputs.QUERIES),
    "typer_apps": f"""SELECT project, path, content, unnest(apps) AS app, generate_subscripts(apps, 1) AS n
        FROM (SELECT *, regexp_extract_all(content, {_lit(fv.TYPER_APP)}, 1) AS apps
              FROM src WHERE contains(lower(content), 'typer')) a""",
    "inits": "SELECT project, path, string_split(path, '/') AS parts FROM code WHERE path LIKE '%/\\_\\_init\\_\\_.py' ESCAPE '\\'",
    "packages": f"""SELECT project, package_dir, preference FROM (
        SELECT *, row_number() OVER (PARTITION BY project ORDER BY preference, package_dir) AS r FROM (
            SELECT project, 'src/' || parts[2] AS package_dir, 1 AS preference FROM inits
            WHERE len(parts) = 3 AND parts[1] = 'src'
            UNION ALL SELECT i.project, parts[1], 2 FROM inits i JOIN code c ON i.project = c.project
            WHERE len(parts) = 2 AND c.path = 'pyproject.toml'
                AND parts[1] = replace(regexp_extract(c.content, {_lit(fv.PROJECT_NAME)}, 1), '-', '_')
            UNION ALL SELECT project, parts[1], 3 FROM inits
            WHERE len(parts) = 2 AND parts[1] NOT IN ('tests', 'test', 'docs', 'examples')) c) d WHERE r = 1""",
    # The generated code is regular: one definition per line, docstrings on the next.
    "symbol_lines": f"""SELECT *, lines[line] AS l, CASE WHEN line < len(lines) THEN lines[line + 1] ELSE '' END AS below
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS line FROM (
            SELECT s.project, path, string_split(content, chr(10)) AS lines,
                regexp_extract_all(regexp_extract(content, {_lit(fv.EXPORT_LIST)}, 1), {_lit(fv.QUOTED_WORD)}, 1) AS exports
            FROM src s JOIN packages p ON s.project = p.project AND starts_with(path, package_dir || '/')
            WHERE NOT {_SKIP['symbols']} AND NOT contains(content, 'def broken(((')) f) g""",
    "symbols": r"""SELECT project, name, type, path, cast(line AS int) AS line,
            regexp_extract(below, '^\s+"{3}(.*)"{3}$', 1) AS docstring,
            len(exports) = 0 OR list_contains(exports, name) AS is_public, depth
        FROM (SELECT *, 'class' AS type, regexp_extract(l, '^\s*class ([A-Za-z]\w*)', 1) AS name,
                  len(regexp_extract(l, '^\s*', 0)) AS depth FROM symbol_lines
              UNION ALL SELECT *, 'function', regexp_extract(l, '^def ([A-Za-z]\w*)\(', 1), 0 FROM symbol_lines) s
        WHERE name <> ''""",
    "cli": _cli([0, 1, 2, 3, 4, 5]),
    "api": _api([0, 1, 2]),
    "config_all": _config([0, 1, 2, 3, 4]),
    "config": """SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (
        PARTITION BY project, name ORDER BY path, extractor_rank, pos) AS r FROM config_all) c WHERE r = 1""",
    "features": """SELECT project, 'CLI Commands' AS category, name AS label, [name] AS terms, '' AS docstring,
            path, line, extractor_rank, pos FROM cli
        UNION ALL SELECT project, CASE type WHEN 'class' THEN 'Classes' ELSE 'Public Functions' END, name, [name],
            docstring, path, line, 0, depth * 1000000 + line FROM symbols WHERE is_public
        UNION ALL SELECT project, 'API Endpoints', method || ' ' || endpoint_path,
            CASE WHEN name <> '' THEN [endpoint_path, name] ELSE [endpoint_path] END, '',
            path, line, extractor_rank, pos FROM api
        UNION ALL SELECT project, 'Configuration', name, [name], '', path, line, extractor_rank, pos FROM config""",
    "coverage_docs": """SELECT project, path, lower(content) AS text FROM files
        WHERE path IN ('README.md', 'README.rst', 'README.txt', 'readme.md')
            OR regexp_matches(path, '^docs/.*[^/]\\.(md|rst|txt)$')
            OR ((path = '__init__.py' OR ends_with(path, '/__init__.py'))
                AND NOT contains(path, '.venv') AND NOT contains(lower(path), 'test'))""",
    "explain_docs": """SELECT project, path, content FROM files
        WHERE path = 'README.md' OR (regexp_matches(path, '^(docs|doc|documentation)/') AND ends_with(path, '.md')
            AND NOT contains(path, '_archive') AND NOT contains(path, 'node_modules'))""",
    "forms": f"""SELECT DISTINCT project, term, unnest({_FORMS}) AS form
        FROM (SELECT DISTINCT project, unnest(terms) AS term FROM features) t""",
    "hits": """SELECT DISTINCT t.project, term FROM forms t
        JOIN coverage_docs d ON d.project = t.project AND contains(d.text, t.form)""",
    "status": _status(strict=False),
    "strict_status": _status(strict=True),
    "categories": _CATEGORIES,
    "strict_categories": _CATEGORIES.replace("FROM status", "FROM strict_status"),
    "totals": _TOTALS,
    "assessed": _ASSESSED,
    "advice": _ADVICE,
    **_fold(),
    "kw": "SELECT DISTINCT project, keywords, unnest(keywords) AS kw FROM asked WHERE query IS NOT NULL",
    "low_docs": "SELECT project, path, lower(content) AS text FROM explain_docs",
    "ranked": f"""SELECT * FROM (SELECT *, cast(row_number() OVER (
            PARTITION BY project, keywords ORDER BY tenths DESC, path DESC) AS int) AS doc_rank
        FROM (SELECT d.project, keywords, path, cast(sum({_TENTHS.format('text', 'kw')}) AS int) AS tenths
              FROM kw JOIN low_docs d ON d.project = kw.project GROUP BY ALL) s
        WHERE tenths >= 2) r WHERE doc_rank <= 5""",
    "doc_lines": """SELECT project, path, line, lines[line] AS l,
            sum(CASE WHEN starts_with(lines[line], '#') THEN 1 ELSE 0 END)
                OVER (PARTITION BY project, path ORDER BY line) AS section
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS line FROM (
            SELECT project, path, string_split(content, chr(10)) AS lines FROM explain_docs
            WHERE (project, path) IN (SELECT project, path FROM ranked)) f) g""",
    "sections": """SELECT project, path, section,
            first(l ORDER BY line) AS header, string_agg(l, chr(10) ORDER BY line)
                FILTER (WHERE NOT starts_with(l, '#')) AS body
        FROM doc_lines WHERE section > 0 GROUP BY project, path, section HAVING body IS NOT NULL""",
    "ranked_sections": f"""SELECT * FROM (SELECT *, cast(row_number() OVER (
            PARTITION BY project, keywords, path ORDER BY tenths DESC, header DESC, body DESC) AS int) AS section_rank
        FROM (SELECT r.project, r.keywords, r.path, doc_rank, header, substr(body, 1, 500) AS body,
                  cast(list_sum(list_transform(r.keywords, lambda k:
                      {_TENTHS.format("lower(header || chr(10) || s.body)", 'k')})) AS int) AS tenths
              FROM ranked r JOIN sections s ON r.project = s.project AND r.path = s.path) t
        WHERE tenths >= 1) u WHERE section_rank <= 3""",
    "doc_lists": """SELECT project, keywords, list(path ORDER BY doc_rank) AS paths, sum(tenths)::INT AS tenths
        FROM ranked GROUP BY project, keywords""",
    "bodies": f"""SELECT project, keywords, list('**' || path || '** ' || header || chr(10)
            || regexp_replace(body, '^{_SPACE}+|{_SPACE}+$', '', 'g') ORDER BY doc_rank, section_rank) AS texts
        FROM ranked_sections GROUP BY project, keywords""",
}


def _sql(final: str) -> str:
    """``final`` with the named sub-queries it depends on in front."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)) & set(_NAMED):
            if word not in needed:
                needed.add(word)
                visit(_NAMED[word])

    visit(final)
    chain = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in _NAMED.items() if n in needed)
    return f"WITH {chain}\n{final}"


def _coverage(table: str) -> str:
    return f"""SELECT project, category, total, documented, coverage, {_MOON.format('coverage')} AS moon,
        coalesce(array_to_string(missing[1:20], '|'), '') AS undocumented FROM {table}"""


_FINDING = """'Documentation assessment: ' || round_even(overall_coverage * 100, 1)
    || '% coverage, know=' || round(know, 2) || ', uncertainty=' || round_even(uncertainty, 2)"""

ORACLES = {
    "coverage_docs": _sql(
        "SELECT project, path, cast(len(text) AS int) AS chars, md5(text) AS digest FROM coverage_docs"
    ),
    "explain_docs": _sql(
        "SELECT project, path, cast(len(content) AS int) AS chars, md5(content) AS digest FROM explain_docs"
    ),
    "package_dirs": _sql("SELECT project, package_dir, preference FROM packages"),
    "skip_filters": _sql(
        f"""SELECT project, path, {_SKIP['cli']} AS skip_cli, {_SKIP['api']} AS skip_api,
            {_SKIP['config']} AS skip_config, {_SKIP['symbols']} AS skip_symbols FROM code"""
    ),
    "argparse_commands": _sql(_cli([0, 1])),
    "click_commands": _sql(_cli([2, 3])),
    "typer_commands": _sql(_cli([4])),
    "fire_commands": _sql(_cli([5])),
    "fastapi_endpoints": _sql(_api([0])),
    "flask_endpoints": _sql(_api([1])),
    "django_routes": _sql(_api([2])),
    "env_vars": _sql(_config([0, 1])),
    "pydantic_settings": _sql(_config([2, 3])),
    "django_settings": _sql(_config([4])),
    "config_dedup": _sql("SELECT * FROM config"),
    "symbols": _sql("SELECT * EXCLUDE depth FROM symbols"),
    "public_symbols": _sql(
        """SELECT project, type, count(*) AS symbols, count(*) FILTER (WHERE docstring <> '') AS with_docstring
        FROM symbols WHERE is_public GROUP BY project, type"""
    ),
    "key_classes": _sql(
        """SELECT * FROM (SELECT project, cast(row_number() OVER (PARTITION BY project ORDER BY
            docstring <> '' DESC, len(name) DESC, path, depth, line) AS int) AS rank, name, path, line, docstring
        FROM symbols WHERE is_public AND type = 'class') c WHERE rank <= 20"""
    ),
    "features": _sql(
        "SELECT project, category, label, path, line, array_to_string(terms, '|') AS terms FROM features"
    ),
    "mention_hits": _sql("SELECT project, term FROM hits"),
    "clean_files": f"""SELECT project, path, len(content) AS chars, md5(content) AS digest
        FROM ({inputs.duck_sql(inputs.CLEAN_FILES)}) f""",
    "word_pair_mentions": f"""WITH terms AS ({inputs.duck_sql(inputs.WORD_PAIRS)}),
        texts AS (SELECT project, string_agg(lower(text), chr(10)) AS text FROM ({inputs.duck_sql(inputs.PLAIN_TEXTS)}) t GROUP BY project)
        SELECT project, count(*) AS terms, count(*) FILTER (WHERE len(list_filter({_FORMS}, lambda f: contains(text, f))) > 0) AS mentioned
        FROM terms LEFT JOIN texts USING (project) GROUP BY project""",
    "category_coverage": _sql(_coverage("categories")),
    "category_coverage_strict": _sql(_coverage("strict_categories")),
    "core_modules": _sql(
        " UNION ALL ".join(
            f"""SELECT project, 'Core Modules' AS category, '{mode}' AS mode, count(*) AS total,
                count(*) FILTER (WHERE documented) AS documented FROM {table}
            WHERE category IN ('Classes', 'Public Functions') GROUP BY project"""
            for mode, table in (("strict", "strict_status"), ("permissive", "status"))
        )
    ),
    "undocumented_preview": _sql(
        """SELECT *, rank <= 20 AS depth_1, rank <= 50 AS depth_2 FROM (
            SELECT project, category, cast(row_number() OVER (PARTITION BY project, category
                ORDER BY path, extractor_rank, pos) AS int) AS rank, label, path, line
            FROM status WHERE NOT documented) p WHERE rank <= 100"""
    ),
    "project_assessment": _sql("SELECT * FROM assessed"),
    "incremental_assessment": _sql("SELECT * FROM assessed"),
    "recommendations": _sql("SELECT project, position, recommendation FROM advice"),
    "discovery_counts": _sql(
        "SELECT p.project, "
        + ", ".join(
            f"coalesce(sum(total) FILTER (WHERE category = {_lit(c)}), 0)::BIGINT AS {n}"
            for c, n in zip(fv.CATEGORIES, fv.DISCOVERY_COUNTS)
        )
        + " FROM projects p LEFT JOIN categories c ON p.project = c.project GROUP BY p.project"
    ),
    "findings": _sql(
        f"""SELECT DATE '2026-01-01' AS run_date, project,
            CASE WHEN round_even(overall_coverage * 100, 1) >= 70 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS impact,
            {_FINDING} AS finding FROM assessed"""
    ),
    "unknowns": _sql(
        """SELECT DATE '2026-01-01' AS run_date, project, recommendation AS "unknown"
        FROM advice WHERE position < 3"""
    ),
    "assess_report_json": _sql(
        f"""SELECT project, to_json(struct_pack(project := project, epistemic := struct_pack(
                know := round(know, 2), uncertainty := round_even(uncertainty, 2),
                overall_coverage := round_even(overall_coverage * 100, 1), total_features := total_features,
                documented_features := documented_features, assessment := assessment,
                recommendations := recommendations, moon := moon),
            categories := coalesce(entries, []), strict := false, discovery := discovery))::VARCHAR AS json
        FROM (SELECT a.*, r.recommendations, c.entries, struct_pack({", ".join(
            f"{n} := coalesce(c.counts[{_lit(c)}], 0)" for n, c in zip(fv.DISCOVERY_COUNTS, fv.CATEGORIES))}) AS discovery
            FROM assessed a
            LEFT JOIN (SELECT p.project, coalesce(list(recommendation ORDER BY position)
                    FILTER (WHERE recommendation IS NOT NULL), []) AS recommendations
                FROM projects p LEFT JOIN advice d ON p.project = d.project GROUP BY p.project) r
                ON a.project = r.project
            LEFT JOIN (SELECT project, map(list(category), list(total)) AS counts,
                    list(struct_pack(name := category, total := total, documented := documented,
                        coverage := round_even(coverage * 100, 1), moon := {_MOON.format('coverage')},
                        undocumented := coalesce(missing[1:20], [])) ORDER BY ord) AS entries
                FROM categories GROUP BY project) c ON a.project = c.project) x"""
    ),
    "topic_keywords": _sql(
        "SELECT query_id, query, array_to_string(keywords, '|') AS keywords FROM asked"
    ),
    "doc_ranking": _sql(
        """SELECT query_id, a.project, doc_rank, path, tenths FROM asked a
        JOIN ranked r ON a.project = r.project AND a.keywords = r.keywords"""
    ),
    "section_ranking": _sql(
        """SELECT query_id, a.project, path, section_rank, header, body, tenths FROM asked a
        JOIN ranked_sections r ON a.project = r.project AND a.keywords = r.keywords"""
    ),
    "explanations": _sql(
        f"""SELECT query_id, project, has_docs AND query IS NOT NULL AS ok,
            CASE WHEN has_docs THEN query END AS query,
            CASE WHEN found THEN CASE WHEN question <> '' THEN '**Answering:** ' || question
                ELSE '**Topic:** ' || topic END || chr(10) || chr(10)
                || array_to_string(coalesce(texts, [])[1:5], chr(10) || chr(10) || '---' || chr(10) || chr(10))
                WHEN missed THEN 'No documentation found for ''' || query || '''' END AS explanation,
            CASE WHEN found THEN array_to_string(paths, '|') WHEN missed THEN '' END AS source_paths,
            CASE WHEN found THEN tenths WHEN missed THEN 0 END AS relevance_tenths,
            CASE WHEN found THEN array_to_string(list_filter({_list(list(fv.TOPIC_ALIASES))},
                lambda k: NOT contains(lower(query), k))[1:5], '|') END AS related_topics,
            CASE WHEN missed THEN '{'|'.join(fv.TOPIC_ALIASES)}' END AS suggestions,
            CASE WHEN query IS NULL THEN 'Please provide a topic or a question'
                WHEN NOT has_docs THEN 'No documentation found in project' END AS error,
            CASE WHEN NOT has_docs AND query IS NOT NULL
                THEN 'Ensure project has docs/, README.md, or similar' END AS hint
        FROM (SELECT a.*, has_docs, d.paths, d.tenths, b.texts,
                  has_docs AND query IS NOT NULL AND d.paths IS NOT NULL AS found,
                  has_docs AND query IS NOT NULL AND d.paths IS NULL AS missed
              FROM (SELECT *, project IN (SELECT project FROM explain_docs) AS has_docs FROM asked) a
              LEFT JOIN doc_lists d ON a.project = d.project AND a.keywords = d.keywords
              LEFT JOIN bodies b ON a.project = b.project AND a.keywords = b.keywords) x"""
    ),
}
