"""Each extractor on small texts: positives, quirks and decoys."""

import pytest

from doclumen.operators import extract as x


@pytest.fixture
def found(make_files):
    def run(kind, extractor, content, path="pkg/m.py"):
        raw = x.raw_features(make_files({path: content}), (kind,), (extractor,))
        view = {"cli": x.cli_commands, "api": x.api_endpoints, "config": x.config_matches}[kind]
        return [r.asDict() for r in view(raw).orderBy("extractor_rank", "pos").collect()]

    return run


def names(rows):
    return [r["name"] for r in rows]


def test_argparse_subcommand_line_is_where_the_call_starts(found):
    rows = found("cli", x.argparse_subcommands, "x\nsub.add_parser(\n  'run'\n)\nadd_parser(name)\nadd_parser(\"go\")")
    assert [(r["name"], r["line"], r["framework"]) for r in rows] == [
        ("run", 2, "argparse"),
        ("go", 6, "argparse"),
    ]
    assert rows[0]["help_text"] == ""


def test_argparse_prog_stops_at_a_closing_bracket(found):
    text = 'ArgumentParser(description="d",\n prog="tool")\nArgumentParser(usage=f(), prog="lost")'
    assert names(found("cli", x.argparse_progs, text)) == ["tool"]


def test_click_name_argument_wins_over_the_function(found):
    text = (
        "@cli.command('ignored')\nasync def from_def(x):\n    pass\n"
        "@cli.command(name='named')\ndef other():\n    pass\n"
        "@cli.command(name='a=b')\ndef bad():\n    pass\n"
        "@cli.command()\ndef _private():\n    pass\n"
    )
    # The look-ahead of 200 characters lets the first command see the second's name,
    # and a leading underscore has become a dash by the time it is looked for.
    assert names(found("cli", x.click_commands, text)) == ["named", "named", "-private"]
    hidden = "@cli.command(name='_hidden')\ndef shown(): pass\n"
    assert found("cli", x.click_commands, hidden) == []


def test_click_function_far_away_is_dropped(found):
    near = "@c.command()\ndef do_it():\n    pass\n" + "#" * 250 + "\n"
    far = "@c.command()\n" + "#" * 200 + "\ndef never():\n    pass\n"
    assert names(found("cli", x.click_commands, near + far)) == ["do-it"]


def test_click_group_keeps_underscores_and_defaults(found):
    text = "@click.group()\ndef my_group():\n    pass\n@click.group(help='" + "h" * 120 + "')\ndef unseen(): pass"
    assert names(found("cli", x.click_groups, text)) == ["my_group", "cli"]


def test_typer_needs_the_app_variable(found):
    text = (
        "import typer\na = typer.Typer()\nb = typer.Typer(help='h')\n"
        "@b.command()\ndef two_words():\n    pass\n"
        "@a.command('named')\ndef f():\n    pass\n"
        "@a.command(help='h')\ndef g():\n    pass\n"
        "@other.command()\ndef h():\n    pass\n"
    )
    rows = found("cli", x.typer_commands, text)
    assert [(r["name"], r["line"]) for r in rows] == [("named", 7), ("two-words", 4)]


def test_typer_duplicate_app_reports_twice_and_unknown(found):
    text = "a = typer.Typer()\na = typer.Typer()\n@a.command()\nlambda: 0"
    assert names(found("cli", x.typer_commands, text)) == ["unknown", "unknown"]


def test_typer_command_is_a_click_command_too(make_files):
    files = make_files({"m.py": "app = typer.Typer()\n@app.command()\ndef run():\n    pass\n"})
    rows = x.cli_commands(x.raw_features(files, ("cli",))).collect()
    assert sorted(r["framework"] for r in rows) == ["click", "typer"]


def test_fire_class_reports_methods_of_the_whole_file(found):
    text = (
        "class Tool2:\n    def go_now(self): pass\n    def _no(self): pass\n"
        "class Other:\n    def else_where(self, x): pass\n"
        "fire.Fire(Tool)\nfire.Fire(some_fn)\nfire.Fire(a, b)\n"
    )
    rows = found("cli", x.fire_commands, text)
    assert [(r["name"], r["line"]) for r in rows] == [
        ("go-now", 6),
        ("else-where", 6),
        ("some-fn", 7),
    ]


def test_fastapi_is_verb_major_and_ignores_case(found):
    text = (
        "from fastapi import X\n@r.POST('/b')\nasync def b_fn(): pass\n"
        "@app.get(\"/a/{id}\")\ndef a_fn(): pass\n@app.get('')\n@app.head('/h')\n" + "#" * 220
    )
    rows = found("api", x.fastapi_endpoints, text)
    assert [(r["method"], r["endpoint_path"], r["name"], r["line"]) for r in rows] == [
        ("GET", "/a/{id}", "a_fn", 4),
        ("POST", "/b", "b_fn", 2),
        ("HEAD", "/h", "", 7),
    ]


def test_fastapi_guard(found):
    assert found("api", x.fastapi_endpoints, "@x.get('/a')\ndef f(): pass") == []
    assert len(found("api", x.fastapi_endpoints, "# FASTAPI\n@x.get('/a')")) == 1


def test_flask_fans_out_methods(found):
    text = (
        "from flask import Flask\n@bp.route('/a', methods=['GET', \"post\"])\ndef a(): pass\n"
        "@bp.route('/b')\ndef b(): pass\n@bp.route('/c', methods=[M])\ndef c(): pass\n"
    )
    rows = found("api", x.flask_endpoints, text)
    assert [(r["method"], r["endpoint_path"], r["name"]) for r in rows] == [
        ("GET", "/a", "a"),
        ("POST", "/a", "a"),
        ("GET", "/b", "b"),
        ("GET", "/c", "c"),
    ]


def test_django_routes(found):
    text = (
        "urlpatterns = [\n path('u/', views.users),\n re_path(\"/v\", v),\n"
        " path('', home), re_path(r'^x$', x), path('z')]\n"
    )
    rows = found("api", x.django_routes, text)
    assert [(r["endpoint_path"], r["name"], r["method"], r["line"]) for r in rows] == [
        ("/u/", "views.users", "*", 2),
        ("/v", "v", "*", 3),
        ("/z", "", "*", 4),
    ]


def test_getenv_defaults(found):
    text = "os.getenv('A', \"d\")\nos.getenv('B', '')\nos.getenv('C')\nos.getenv('D' , f(1))\nos.getenv('low')"
    rows = found("config", x.getenv_options, text)
    assert [(r["name"], r["default"], r["required"]) for r in rows] == [
        ("A", "d", False),
        ("B", "", True),
        ("C", "", True),
        ("D", "f(1", False),
    ]


def test_environ_needs_brackets(found):
    text = "os.environ['A']\nos.environ.get('B')\nos.environ [ \"C\" ]"
    rows = found("config", x.environ_options, text)
    assert [(r["name"], r["required"], r["line"]) for r in rows] == [("A", True, 1), ("C", True, 3)]


def test_settings_fields(found):
    text = (
        "class S(BaseSettings):\n    x: str = Field('d', env='X_ENV')\n"
        "    y: Optional[str] = Field(None, env='MISSED')\n    NAME: str\n"
        "class Other:\n    LATER: int = 1\n        DEEP: int\n"
    )
    assert names(found("config", x.settings_field_options, text)) == ["X_ENV"]
    rows = found("config", x.settings_bare_options, text)
    assert [(r["name"], r["line"]) for r in rows] == [("NAME", 4), ("LATER", 6)]
    assert found("config", x.settings_bare_options, "class S:\n    NAME: str\n") == []


def test_settings_bare_field_after_blank_lines_starts_on_the_first(found):
    text = "class S(BaseSettings):\n    pass\n\n\n\n\nNAME: str\n"
    rows = found("config", x.settings_bare_options, text)
    assert [(r["name"], r["line"]) for r in rows] == [("NAME", 3)]


def test_django_settings_values(found):
    text = (
        "DEBUG = True  \nA49 = " + "a" * 49 + "\nA50 = " + "b" * 50 + "\n"
        "LOADED = import_string('x')\nTRUE = 1\n    INDENTED = 2\nlower = 3\nNEXT =\n  4\n"
    )
    rows = found("config", x.django_settings, text, "app/settings.py")
    assert [(r["name"], r["default"]) for r in rows] == [
        ("DEBUG", "True"),
        ("A49", "a" * 49),
        ("A50", "b" * 47 + "..."),
        ("NEXT", "4"),
    ]
    assert found("config", x.django_settings, text, "app/other.py") == []
    assert len(found("config", x.django_settings, "DJANGO_SETTINGS = 1", "app/other.py")) == 1


def test_option_dedup_keeps_the_first_in_scan_order(make_files):
    files = make_files(
        {
            "b.py": "os.getenv('A', 'late')",
            "a.py": "os.environ['A']\nos.getenv('B', '1')\nos.getenv('B', '2')",
        }
    )
    options = x.config_matches(x.dedup_raw(x.raw_features(files))).orderBy("name").collect()
    assert [(r["name"], r["path"], r["default"], r["required"]) for r in options] == [
        ("A", "a.py", "", True),
        ("B", "a.py", "1", False),
    ]


def test_dedup_leaves_commands_and_endpoints_alone(make_files):
    files = make_files({"a.py": "add_parser('x')\nadd_parser('x')\nurlpatterns=[path('p'), path('p')]"})
    raw = x.raw_features(files)
    assert x.dedup_raw(raw).count() == raw.count() == 4


def test_unicode_names_and_marker_characters_in_the_text(found):
    text = "# \ufdd0 é\nadd_parser('größe')\n# \u2028 still one line\nadd_parser('b')\n"
    rows = found("cli", x.argparse_subcommands, text)
    assert [(r["name"], r["line"]) for r in rows] == [("größe", 2), ("b", 4)]


def test_paths_that_are_left_out(make_files):
    text = "add_parser('x')\nurlpatterns=[path('p')]\nos.getenv('A')"
    paths = [
        "ok.py", "distance.py", "a/tests/m.py", "m_test.py", "migrations/m.py",
        ".venv/m.py", "conftest.py", "builder/m.py", "notes.txt",
    ]
    rows = x.raw_features(make_files({p: text for p in paths})).select("kind", "path").collect()
    kept = {kind: {r["path"] for r in rows if r["kind"] == kind} for kind in ("cli", "api", "config")}
    assert kept["cli"] == {"ok.py", "migrations/m.py"}
    assert kept["api"] == {"ok.py", "distance.py", "conftest.py", "builder/m.py"}
    assert kept["config"] == {"ok.py", "distance.py", "m_test.py", "conftest.py", "builder/m.py"}


def test_root_prefix_is_tested_like_part_of_the_path(make_files):
    files = make_files({"ok.py": "add_parser('x')"})
    assert x.raw_features(files, ("cli",), root_prefix="/home/build/").count() == 0


def test_names_keep_marks_and_pythons_white_space_parts(make_files):
    """Noncharacters in names come back as they were; U+001C to U+001F are white space."""
    marks = "".join(map(chr, range(0xFDD0, 0xFDD3)))
    names = [f"a{marks}b", f"a{marks}\ufdd3b", f"\ufdd1x\ufdd6{marks}"]
    source = "".join(f'add_parser("{name}")\n' for name in names) + 'add_parser\x1f(\x1c"z")\n'
    source += "t\x1d=\x1etyper.Typer()\n@t.command\x1f('tt')\ndef f():\n    pass\n"
    files = make_files({"m.py": "# é\n" + source, "n.py": 'add_parser\x1d("z")\n'})
    found = x.cli_commands(x.raw_features(files)).where("framework <> 'click'").orderBy("path", "line").collect()
    assert [(r.path, r.line, r.name) for r in found] == [
        *(("m.py", i, name) for i, name in enumerate([*names, "z"], 2)), ("m.py", 7, "tt"), ("n.py", 1, "z"),
    ]
