import fnmatch
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from bindery.functions import fixed, paths
from bindery.operators import scan

V = F.col("v")

NAMES = [
    ".env", ".env.json", "a.tar.GZ", "foo.", "..py", ".a.py", "__init__.py", "build", "x.y/z",
    "src/main.py", "a/b.c/d", "Makefile", "a/.hidden", "a/.b.TXT", "ümlaut.Py", "a b.md",
]


def test_suffix_name_and_parent_follow_path_rules(evaluate):
    pure = [PurePosixPath(n) for n in NAMES]
    assert evaluate(NAMES, paths.suffix(V)) == [p.suffix.lower() for p in pure]
    assert evaluate(NAMES, paths.file_name(V)) == [p.name for p in pure]
    parents = ["" if str(p.parent) == "." else str(p.parent) for p in pure]
    assert evaluate(NAMES, paths.parent(V)) == parents
    assert evaluate(NAMES, paths.top_part(V)) == [p.parts[0] for p in pure]


@pytest.mark.parametrize(
    "max_depth, want",
    [(1, [".", ".", "."]), (2, [".", "a", "a"]), (3, [".", "a", "a/b"]), (15, [".", "a", "a/b"])],
)
def test_folder(evaluate, max_depth, want):
    assert evaluate(["x", "a/x", "a/b/x"], paths.folder(V, max_depth)) == want


def test_category_of_every_suffix_and_name(evaluate):
    by_suffix = fixed.spread(fixed.CATEGORY_SUFFIXES)
    assert evaluate([f"a/f{s.upper()}" for s in by_suffix], paths.category(V)) == list(
        by_suffix.values()
    )
    by_name = fixed.spread(fixed.SPECIAL_NAMES)
    assert len(by_name) == 33
    assert evaluate([f"d/{n}" for n in by_name], paths.category(V)) == list(by_name.values())


@pytest.mark.parametrize(
    "name, want",
    [
        (".eslintrc.js", "config_docs"),
        ("build.gradle.kts", "java_kotlin"),
        (".swiftlint.yml", "ios_apple"),
        ("dockerfile", None),
        (".env", None),
        ("a.pem", None),
        ("noext", None),
        ("PKG.JSON", "config_docs"),
    ],
)
def test_category_cases(evaluate, name, want):
    assert evaluate([name], paths.category(V)) == [want]


def test_icons(evaluate):
    names = [".py", "main.py", "Dockerfile", "x/tsconfig.json", "a.unknown", "Pipfile", "b.SH"]
    got = evaluate(names, paths.icon(V, F.when(V == "Pipfile", "config_docs")))
    assert got == ["🐍", "🐍", "🐳", "📘", "📄", "📋", "🖥️"]
    icons = list(fixed.ICON_NAMES) + ["❓"]
    assert evaluate(icons, paths.icon_name(V)) == list(fixed.ICON_NAMES.values()) + ["Other"]
    assert len(fixed.SUFFIX_ICONS) + len(fixed.NAME_ICONS) == 57


def test_globs_match_like_fnmatch(evaluate):
    globs = [
        "*.lock", "*~", ".env.*", "thumbs.db", "a?c", "[ab]x*", "[!ab]x", "src/*.py", "*/x", "[",
        "a[]]b", "x[^y]z", "**", "a.b+c", "(x)", "[a-c]*[0-9]", "{x}", "a\\b", "$x^", "*.p*y",
    ]
    subjects = [
        "yarn.lock", "a/b.lock", "lock", "x~", ".env.d/x", "d/.env.local", ".envx", "thumbs.db",
        "d/thumbs.db", "Thumbs.db", "abc", "a/c", "d/abc", "ax", "bxy", "cx", "d/cx", "src/a.py",
        "src/b/a.py", "q/x", "[", "a]b", "x^z", "xaz", "xyz", "a.b+c", "aXb+c", "(x)", "b/c7", "{x}",
        "a\\b", "$x^", "m.pxy", "m.py/x", "a\nb", "line\n.lock",
    ]
    for glob in globs:
        want = [
            fnmatch.fnmatchcase(s, glob) or fnmatch.fnmatchcase(PurePosixPath(s).name, glob)
            for s in subjects
        ]
        assert evaluate(subjects, paths.matches_any_glob(V, [glob])) == want, glob


def reason(evaluate, path, **kw):
    return evaluate([path], scan.path_reason(V, **kw))[0]


@pytest.mark.parametrize(
    "path, want",
    [
        ("src/main.py", None),
        (".git/objects", "default_excluded_dir"),
        ("node_modules/p/index.js", "default_excluded_dir"),
        (".github/workflows/ci.yml", "default_excluded_dir"),
        ("a/build", "default_excluded_dir"),
        ("target", "default_excluded_dir"),
        ("builds/x.py", None),
        ("exported_sources_x/bundle.txt", "default_excluded_prefix"),
        ("exported_sources.py", "default_excluded_prefix"),
        ("some/exported_sources_x/bundle.txt", None),
        ("package-lock.json", "extra_excluded_pattern"),
        ("a/b.swp", "extra_excluded_pattern"),
        ("a/x~", "extra_excluded_pattern"),
        ("a/.env", "secret_like_file"),
        (".env.local", "secret_like_file"),
        ("k/id_rsa", "secret_like_file"),
        ("google-services.json", "secret_like_file"),
        ("dist/.env", "default_excluded_dir"),
    ],
)
def test_first_reason_wins(evaluate, path, want):
    assert reason(evaluate, path) == want


def test_allowed_secrets_still_need_a_type(evaluate):
    assert reason(evaluate, "a/.env", skip_secrets=False) is None
    assert evaluate(["a/.env", "a/.env.json"], paths.category(V)) == [None, "config_docs"]
