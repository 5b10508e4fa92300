"""Commands, endpoints and configuration options found in source files.

Every extractor is a column expression: a guard on path and text, then the
matches as an array of rows.  :func:`raw_features` concatenates the arrays of the
extractors it is asked for and explodes them, so that one scan of the files feeds
all of them and no file content is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclumen import fixed_values as fv
from doclumen.functions.matching import (
    extract_all,
    first_group,
    has_match,
    match_rows,
    with_spaces,
    strip_whitespace,
)
from doclumen.functions.terms import kebab
from doclumen.operators import skips

Extractor = Callable[[Column, Column], tuple[Column, Column]]

_FIELDS = "framework:string,name:string,method:string,line:int,default:string,required:boolean"
_UNRANKED = f"array<struct<{_FIELDS}>>"
_RANKED = f"array<struct<extractor_rank:int,pos:int,kind:string,{_FIELDS}>>"


def _matches(content: Column, regex: str, tail: int = 0, flags: str = "") -> Column:
    groups = re.compile(regex).groups
    return match_rows(content, regex, groups, tail, flags)


def _row(
    line: Column,
    name: Column,
    framework: str,
    method: Column | None = None,
    default: Column | None = None,
    required: Column | None = None,
) -> Column:
    return F.struct(
        F.lit(framework).alias("framework"),
        name.alias("name"),
        (F.lit("") if method is None else method).alias("method"),
        line.alias("line"),
        (F.lit("") if default is None else default).alias("default"),
        (F.lit(False) if required is None else required).alias("required"),
    )


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def argparse_subcommands(path: Column, content: Column) -> tuple[Column, Column]:
    rows = F.transform(
        _matches(content, fv.ARGPARSE_SUBCOMMAND),
        lambda m: _row(m["0"], m["1"], "argparse"),
    )
    return F.contains(content, F.lit("add_parser")), rows


def argparse_progs(path: Column, content: Column) -> tuple[Column, Column]:
    rows = F.transform(
        _matches(content, fv.ARGPARSE_PROG), lambda m: _row(m["0"], m["1"], "argparse")
    )
    return F.contains(content, F.lit("ArgumentParser")), rows


def click_commands(path: Column, content: Column) -> tuple[Column, Column]:
    def command(m: Column) -> Column:
        rest = m["2"]
        name = F.coalesce(
            first_group(rest, fv.CLICK_NAME_ARGUMENT),
            kebab(first_group(rest, fv.CLICK_FUNCTION)),
        )
        return _row(m["0"], name, "click")

    rows = F.filter(
        F.transform(_matches(content, fv.CLICK_COMMAND, fv.CLICK_LOOKAHEAD), command),
        lambda r: r["name"].isNotNull()
        & ~F.contains(r["name"], F.lit("="))
        & ~F.startswith(r["name"], F.lit("_")),
    )
    return F.contains(content, F.lit(".command")), rows


def click_groups(path: Column, content: Column) -> tuple[Column, Column]:
    rows = F.transform(
        _matches(content, fv.CLICK_GROUP, fv.CLICK_GROUP_LOOKAHEAD),
        lambda m: _row(
            m["0"],
            F.coalesce(first_group(m["1"], fv.FUNCTION_NAME), F.lit(fv.DEFAULT_CLICK_GROUP)),
            "click",
        ),
    )
    return F.contains(content, F.lit("@click.group")), rows


def typer_commands(path: Column, content: Column) -> tuple[Column, Column]:
    """Commands of every Typer object; the pattern depends on the object's name."""

    def command(m: Column) -> Column:
        name = F.coalesce(
            F.nullif(m["1"], F.lit("")),
            kebab(first_group(m["2"], fv.FUNCTION_NAME)),
            F.lit(fv.UNKNOWN_TYPER_COMMAND),
        )
        return _row(m["0"], name, "typer")

    def commands_of(app: Column) -> Column:
        regex = F.concat(F.lit("@"), app, F.lit(with_spaces(fv.TYPER_COMMAND_AFTER_APP)))
        return F.transform(match_rows(content, regex, 1, fv.TYPER_LOOKAHEAD), command)

    apps = extract_all(content, fv.TYPER_APP)
    return F.contains(content, F.lit("typer.Typer")), F.flatten(F.transform(apps, commands_of))


def fire_commands(path: Column, content: Column) -> tuple[Column, Column]:
    """A Fire target that is a class offers every public method of the file."""

    def commands_of(m: Column) -> Column:
        target = m["1"]
        is_class = has_match(
            content,
            F.concat(
                F.lit(with_spaces(fv.FIRE_CLASS_BEFORE_TARGET)),
                target,
                F.lit(with_spaces(fv.FIRE_CLASS_AFTER_TARGET)),
            ),
        )
        methods = F.filter(
            extract_all(content, fv.FIRE_METHOD),
            lambda method: ~F.startswith(method, F.lit("_")),
        )
        names = F.when(is_class, methods).otherwise(F.array(target))
        return F.transform(names, lambda name: _row(m["0"], kebab(name), "fire"))

    rows = F.flatten(F.transform(_matches(content, fv.FIRE_CALL), commands_of))
    return F.contains(content, F.lit("fire.Fire")), rows


def fastapi_endpoints(path: Column, content: Column) -> tuple[Column, Column]:
    """Endpoints verb by verb: the verb comes before the position in their order."""

    def endpoints_of(verb: str) -> Column:
        regex = fv.FASTAPI_ROUTE_BEFORE_VERB + verb + fv.FASTAPI_ROUTE_AFTER_VERB
        rows = F.transform(
            _matches(content, regex, fv.ROUTE_LOOKAHEAD, flags="i"),
            lambda m: _row(
                m["0"],
                _text(first_group(m["2"], fv.ASYNC_FUNCTION_NAME)),
                "fastapi",
                method=F.lit(verb.upper()),
                default=m["1"],
            ),
        )
        # Most files use one or two verbs; the others need no regex pass.
        return F.when(F.contains(F.upper(content), F.lit(f".{verb.upper()}")), rows).otherwise(
            F.array().cast(_UNRANKED)
        )

    guard = F.contains(content, F.lit("@")) & (
        F.contains(content, F.lit("@app."))
        | F.contains(content, F.lit("@router."))
        | F.contains(F.lower(content), F.lit("fastapi"))
    )
    return guard, F.concat(*[endpoints_of(verb) for verb in fv.HTTP_VERBS])


def flask_endpoints(path: Column, content: Column) -> tuple[Column, Column]:
    """One row per listed method; GET where none is quoted."""

    def endpoints_of(m: Column) -> Column:
        listed = extract_all(m["2"], fv.QUOTED_WORD)
        methods = F.when(F.size(listed) > 0, listed).otherwise(
            F.array(F.lit(fv.DEFAULT_FLASK_METHOD))
        )
        name = _text(first_group(m["3"], fv.FUNCTION_NAME))
        return F.transform(
            methods,
            lambda method: _row(
                m["0"], name, "flask", method=F.upper(method), default=m["1"]
            ),
        )

    guard = F.contains(content, F.lit(".route")) & (
        F.contains(content, F.lit("@app.route"))
        | F.contains(F.lower(content), F.lit("flask"))
    )
    rows = F.transform(_matches(content, fv.FLASK_ROUTE, fv.ROUTE_LOOKAHEAD), endpoints_of)
    return guard, F.flatten(rows)


def django_routes(path: Column, content: Column) -> tuple[Column, Column]:
    def endpoint(m: Column) -> Column:
        route = F.when(F.startswith(m["1"], F.lit("/")), m["1"]).otherwise(
            F.concat(F.lit("/"), m["1"])
        )
        return _row(
            m["0"],
            _text(first_group(m["2"], fv.DJANGO_VIEW)),
            "django",
            method=F.lit(fv.ANY_METHOD),
            default=route,
        )

    rows = F.transform(_matches(content, fv.DJANGO_PATH, fv.DJANGO_LOOKAHEAD), endpoint)
    return F.contains(content, F.lit("urlpatterns")), rows


def getenv_options(path: Column, content: Column) -> tuple[Column, Column]:
    def option(m: Column) -> Column:
        default = F.btrim(strip_whitespace(m["2"]), F.lit("'\""))
        return _row(m["0"], m["1"], "env_var", default=default, required=default == "")

    rows = F.transform(_matches(content, fv.GETENV), option)
    return F.contains(content, F.lit("os.getenv")), rows


def environ_options(path: Column, content: Column) -> tuple[Column, Column]:
    rows = F.transform(
        _matches(content, fv.ENVIRON),
        lambda m: _row(m["0"], m["1"], "env_var", required=F.lit(True)),
    )
    return F.contains(content, F.lit("os.environ")), rows


def _has_settings_class(content: Column) -> Column:
    # The class pattern itself contains the word BaseSettings, so this literal
    # test decides before the regex runs.
    return F.contains(content, F.lit("BaseSettings")) & has_match(content, fv.SETTINGS_CLASS)


def settings_field_options(path: Column, content: Column) -> tuple[Column, Column]:
    rows = F.transform(
        _matches(content, fv.SETTINGS_FIELD_ENV),
        lambda m: _row(m["0"], m["2"], "pydantic_setting"),
    )
    return _has_settings_class(content), rows


def settings_bare_options(path: Column, content: Column) -> tuple[Column, Column]:
    rows = F.transform(
        _matches(content, fv.SETTINGS_BARE_FIELD, flags="m"),
        lambda m: _row(m["0"], m["1"], "pydantic_setting"),
    )
    return _has_settings_class(content), rows


def django_settings(path: Column, content: Column) -> tuple[Column, Column]:
    def option(m: Column) -> Column:
        value = strip_whitespace(m["2"])
        shown = F.when(F.length(value) < fv.SETTING_VALUE_LIMIT, value).otherwise(
            F.concat(
                F.substring(value, 1, fv.SETTING_VALUE_KEPT),
                F.lit(fv.SETTING_VALUE_ELLIPSIS),
            )
        )
        # A setting that does not count is given no name and filtered out below.
        counts = ~m["1"].isin(fv.NOT_SETTINGS) & ~F.contains(value, F.lit("import"))
        return _row(m["0"], F.when(counts, m["1"]), "django_setting", default=shown)

    rows = F.filter(
        F.transform(_matches(content, fv.SETTINGS_ASSIGNMENT, flags="m"), option),
        lambda r: r["name"].isNotNull(),
    )
    guard = F.contains(path, F.lit("settings.py")) | F.contains(
        content, F.lit("DJANGO_SETTINGS")
    )
    return guard, rows


#: Extractors of each kind in discovery order, which is also their rank.
EXTRACTORS: dict[str, list[Extractor]] = {
    "cli": [
        argparse_subcommands,
        argparse_progs,
        click_commands,
        click_groups,
        typer_commands,
        fire_commands,
    ],
    "api": [fastapi_endpoints, flask_endpoints, django_routes],
    "config": [
        getenv_options,
        environ_options,
        settings_field_options,
        settings_bare_options,
        django_settings,
    ],
}
_SKIPS = {
    "cli": skips.skips_cli,
    "api": skips.skips_api,
    "config": skips.skips_config,
}


def _extracted(kind: str, rank: int, extractor: Extractor, skip: Column) -> Column:
    guard, rows = extractor(F.col("path"), F.col("content"))
    ranked = F.transform(
        rows,
        lambda r, i: F.struct(
            F.lit(rank).alias("extractor_rank"),
            i.alias("pos"),
            F.lit(kind).alias("kind"),
            r["framework"].alias("framework"),
            r["name"].alias("name"),
            r["method"].alias("method"),
            r["line"].alias("line"),
            r["default"].alias("default"),
            r["required"].alias("required"),
        ),
    )
    return F.when(~skip & guard, ranked).otherwise(F.array().cast(_RANKED))


@cache
def _extraction(
    context: SparkContext,
    kinds: tuple[str, ...],
    only: tuple[Extractor, ...] | None,
    root_prefix: str,
) -> Column:
    """All rows of a file.  Putting the expression together takes a few seconds of
    driver time, so each is built once per Spark context."""
    arrays = []
    for kind in kinds:
        skip = _SKIPS[kind](F.col("path"), root_prefix)
        for rank, extractor in enumerate(EXTRACTORS[kind]):
            if only is None or extractor in only:
                arrays.append(_extracted(kind, rank, extractor, skip))
    # The outer form, as for the plain one the optimizer infers a filter on the
    # array's size, which would run every extractor a second time.
    return F.inline_outer(F.concat(*arrays))


def raw_features(
    files: DataFrame,
    kinds: tuple[str, ...] = ("cli", "api", "config"),
    only: tuple[Extractor, ...] | None = None,
    root_prefix: str = "",
) -> DataFrame:
    """Every match of the chosen extractors, before the options are deduplicated.

    ``name`` is the command, the option or the view; ``default`` holds the
    endpoint's path for endpoints.  Discovery order within a project is
    ``(path, extractor_rank, pos)``.
    """
    rows = _extraction(files.sparkSession.sparkContext, kinds, only, root_prefix)
    return (
        files.where(skips.is_python(F.col("path")))
        .select("project", "path", rows)
        .where(F.col("extractor_rank").isNotNull())
    )


def cli_commands(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("kind") == "cli").select(
        "project",
        "name",
        "framework",
        "path",
        "line",
        F.lit("").alias("help_text"),
        "extractor_rank",
        "pos",
    )


def api_endpoints(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("kind") == "api").select(
        "project",
        F.col("default").alias("endpoint_path"),
        "method",
        "framework",
        "path",
        "line",
        "name",
        "extractor_rank",
        "pos",
    )


def config_matches(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("kind") == "config").select(
        "project",
        "name",
        F.col("framework").alias("type"),
        "path",
        "line",
        "default",
        "required",
        "extractor_rank",
        "pos",
    )


def dedup_raw(raw: DataFrame) -> DataFrame:
    """Keep the first occurrence of every option name; other kinds stay whole.

    One aggregate with map-side combine: options group by name, the rest by their
    own position, so nothing else collapses and no group is collected.
    """
    payload = [c for c in raw.columns if c not in ("project", "kind", "path", "extractor_rank", "pos")]
    is_option = F.col("kind") == "config"
    occurrence = F.struct("path", "extractor_rank", "pos", *payload)
    return (
        raw.groupBy(
            "project",
            "kind",
            F.when(is_option, F.col("name")).alias("_option"),
            F.when(~is_option, F.struct("path", "extractor_rank", "pos")).alias("_place"),
        )
        .agg(F.min(occurrence).alias("first"))
        .select("project", "kind", "first.*")
    )
