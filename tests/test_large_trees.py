"""Chunks of files against whole files, rounds of a listing, reads that break off, dedup of odd rows."""

import os
import random

import pytest

from loomline.functions import chunkscan
from loomline.functions.classify import kinds
from loomline.functions.languages import LanguageRegistry
from loomline.palettes import PALETTES
from loomline.plans import hugefiles
from loomline.plans.engine import analyze, analyze_content, analyze_files
from loomline.plans.options import Options
from loomline.sources import listing, stores

LANGUAGES = LanguageRegistry.default().languages
MARKERS = ["/*", "*/", "//", "#", '"', "'", "`", '"""', "'''", "${", "}", "\\", "\n", "\n", "\n", " ", "x", "r#\"", '"#', 'R"a(', ')a"', "<!--", "-->", "--", "{-", "-}", "def f():\n", "    ", "(*", "*)", "=begin\n", "=end\n", "\r\n", "é", "return /", "#!"]


def composed(content, language, size):
    """The kinds of lines, a chunk at a time, each in the state that the one before ends in."""
    state, out = chunkscan.START, ""
    for k in range(-(-len(content) // size)):
        start = k * size
        begin = max(start - 1, 0)
        part = chunkscan.cut_lines(iter([content[i : i + 5] for i in range(begin, len(content), 5)]), begin, start, start + size)
        out += "".join(r[0] for r in chunkscan.lines_of_chunk(part, language, state))
        state = chunkscan.count_chunk(part, language, state)[3]
    return out


@pytest.mark.parametrize("name", ["Go", "C", "C++", "Rust", "JavaScript", "TypeScript", "Python", "Starlark", "Haskell", "HTML", "Ruby", "SQL", "Pony", "Svelte", "ANTLR", "Just", "Kotlin", "Perl", "Lua", "F#", "Plain Text", "Fortran Modern" if "Fortran Modern" in LANGUAGES else "Go"])
def test_chunks_compose_to_the_whole_file(name):
    rng = random.Random(name)
    for _ in range(120):
        content = "".join(rng.choice(MARKERS) for _ in range(rng.randrange(60))).encode()
        for size in (1, 3, 7, 20):
            assert composed(content, LANGUAGES[name], size) == kinds(content, LANGUAGES[name]), (content, size)


def test_cut_lines_takes_each_line_once():
    rng = random.Random(1)
    for _ in range(500):
        content = "".join(rng.choice("ab\n") for _ in range(rng.randrange(40))).encode()
        size, piece = rng.randrange(1, 9), rng.randrange(1, 6)
        out = []
        for start in range(0, len(content), size):
            begin = max(start - 1, 0)
            out.append(chunkscan.cut_lines(iter([content[i : i + piece] for i in range(begin, len(content), piece)]), begin, start, start + size))
        assert b"".join(out) == content and all(x == b"" or x.endswith(b"\n") for x in out[:-1] if x and not content.endswith(x))


@pytest.fixture()
def big_tree(tmp_path):
    rng = random.Random(7)
    for ext in ("go", "py", "js", "rs", "hs", "txt", "cpp"):
        palette = next((p for p in PALETTES.values() if p[0] == ext), None)
        for k in range(2):
            body = "".join(rng.choice(palette[2])[0] if palette else rng.choice(["word\n", "\n"]) for _ in range(200))
            (tmp_path / f"{ext}{k}.{ext}").write_text(body + "/* {- \"\"\"\n" + body if k else body)
        (tmp_path / f"copy.{ext}").write_bytes((tmp_path / f"{ext}1.{ext}").read_bytes())
    (tmp_path / "nested.rs").write_text("/*\n" * 40 + "*/\n" * 40 + "x\n")
    (tmp_path / "small.go").write_text("x\n")
    return str(tmp_path)


@pytest.mark.parametrize("chunk", [500, 3000])
def test_huge_files_count_like_small_ones(spark, big_tree, chunk):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = analyze(spark, [big_tree])
    parts = analyze(spark, [big_tree], huge=60, chunk=chunk)
    assert rows(parts.files) == rows(whole.files) and rows(parts.total) == rows(whole.total)
    assert parts.chunks.count() > 3
    once = analyze(spark, [big_tree], Options(dedup=True), huge=60, chunk=chunk)
    assert rows(once.files) == rows(analyze(spark, [big_tree], Options(dedup=True)).files)
    columns = ("path", "line_no", "kind", "in_comment", "text", "raw")
    assert rows(parts.lines.select(*columns)) == rows(whole.lines.select(*columns))


def test_a_file_whose_states_never_agree_is_followed_from_its_beginning(spark, big_tree):
    files = spark.createDataFrame([(1, f"{big_tree}/nested.rs", os.path.getsize(f"{big_tree}/nested.rs"), "Rust")], "seq long, path string, size long, language string")
    counts, places = hugefiles.count_huge(files, LANGUAGES, 20, spread=1)
    got = counts.first()
    assert (got.code, got.comment, got.blank) == (1, 80, 0)
    assert [r.before for r in places.orderBy("chunk").collect()][:3] == [0, 7, 14]


def deep_tree(top):
    for k in range(30):
        os.makedirs(f"{top}/many/{k:02}/{k % 3}")
        for j in range(3):
            open(f"{top}/many/{k:02}/{k % 3}/{j}.go", "w").close()
    path = f"{top}/deep"
    for k in range(40):
        path += f"/{k}"
        os.makedirs(path)
        open(f"{path}/x.py", "w").close()


@pytest.mark.parametrize("head", ["", "file://"])
def test_rounds_of_a_listing(spark, tmp_path, head):
    deep_tree(str(tmp_path))
    want = [tuple(r) for r in listing.sized_trees(spark, [f"{head}{tmp_path}"]).orderBy("seq").collect()]
    assert len(want) == 130
    for most, files, step in ((0, None, 3), (2, None, 500), (None, 20, 7)):
        got = listing.sized_trees(spark, [f"{head}{tmp_path}"], most=most, most_files=files, task_folders=step)
        assert [tuple(r) for r in got.orderBy("seq").collect()] == want
    some = listing.sized_trees(spark, [f"{head}{tmp_path}"], most=0, task_folders=2, left_out=lambda p: p.rlike("deep"))
    assert some.count() == 90


def test_a_tree_is_listed_once(spark, tmp_path, monkeypatch):
    deep_tree(str(tmp_path))
    monkeypatch.setattr(listing, "DRIVER_FOLDERS", 1)
    result = analyze(spark, [str(tmp_path)])
    numbers = {r.path: r.seq for r in result.scanned.collect()}
    open(f"{tmp_path}/aaa.go", "w").close()
    assert {r.file: r.seq for r in result.language_files.collect()} == numbers


class Breaking(stores.LocalStore):
    """Fails after some bytes of files named so."""

    def chunks(self, path, start=0):
        for piece in super().chunks(path, start):
            if path.endswith("broken.go"):
                yield piece[:12]
                raise OSError(5, "broke off")
            yield piece


def test_what_was_read_before_a_failure(spark, tmp_path, monkeypatch):
    from loomline.plans import engine

    (tmp_path / "broken.go").write_text("x\n// y\nz\n\nw\n")
    (tmp_path / "good.go").write_text("x\n")
    held = [r for r in read_with(Breaking(), [str(tmp_path / "broken.go"), str(tmp_path / "good.go"), str(tmp_path / "none.go")])]
    assert [(p.rsplit("/", 1)[1], c, w is not None) for p, c, w in held] == [("broken.go", b"x\n// y\nz\n\nw\n"[:12], True), ("good.go", b"x\n", False), ("none.go", None, True)]
    monkeypatch.setattr(engine, "read_contents", lambda rows, workers: spark.createDataFrame([(k, p, c, w) for k, (p, c, w) in enumerate(held)], "seq long, path string, content binary, warning string"))
    partial = analyze_files(spark, ["unused"], "Go")
    assert {r.name.rsplit("/", 1)[1]: (r.code, r.comment, r.blank) for r in partial.files.collect()} == {"broken.go": (3, 1, 1), "good.go": (1, 0, 0), "none.go": (0, 0, 0)}
    assert partial.diagnostics.count() == 2
    whole = analyze(spark, [str(tmp_path)])
    assert [r.name.rsplit("/", 1)[1] for r in whole.files.collect()] == ["good.go"] and whole.diagnostics.count() == 2


def read_with(store, paths):
    for path in paths:
        yield path, *listing.read_whole(store, path)


def test_dedup_keeps_every_content_once(spark):
    rows = [(None, "a.go", "x"), (None, "b.go", "y"), (1, "c.go", "x"), (2, "d.go", "z"), (2, "d.go", "z"), (2, "e.go", "z"), (None, None, "x.y")]
    df = spark.createDataFrame(rows, "seq long, path string, content string").repartition(3)
    r = analyze_content(df.where("path is not null"), Options(dedup=True))
    assert sorted((x.seq, x.path) for x in r.scanned.collect() if x.seq) == [(1, "c.go"), (2, "d.go")]
    assert {x.path for x in r.scanned.collect()} == {"b.go", "c.go", "d.go"}
    assert sorted(x.path for x in r.dropped.collect()) == ["a.go", "d.go", "e.go"]
    assert r.files.count() == 3 and r.diagnostics.count() == 3


def test_a_callers_columns_are_no_warnings(spark):
    df = spark.createDataFrame([(0, "a.go", "x\n", "w", "v")], "seq long, path string, content string, __read_warning string, warning string")
    r = analyze_content(df)
    assert r.files.count() == 1 and r.diagnostics.count() == 0
