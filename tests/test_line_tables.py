"""Files whose lines stand again are told by look-ups, and by the scanners' results."""

import hashlib
import random

import pytest

from loomline.functions.classify import kinds
from loomline.functions.languages import Language, builtin
from loomline.palettes import PALETTES
from loomline.queries import _SOME, FAMILIES

L = builtin()


@pytest.fixture
def tables(monkeypatch):
    from loomline.functions import linetable

    linetable._table.cache_clear()
    monkeypatch.setattr(linetable.LineTable, "kept", 0)
    yield linetable
    linetable._table.cache_clear()


def shape(language, k):
    _, first, pieces = PALETTES[language]
    return (first + "".join(pieces[int(d, 16)][0] for d in hashlib.md5(str(k).encode()).hexdigest())).encode()


def told(content, language):
    k = kinds(content, language)
    return k.count("C"), k.count("M"), k.count("B")


def scanned_again(tables, monkeypatch, contents, language):
    """Files that still go to the scanners after half of them were counted; all counts are those of the lines."""
    half, seen = len(contents) // 2, []
    assert tables.counts_of_many(contents[:half], language) == [told(c, language) for c in contents[:half]]
    monkeypatch.setattr(tables, "counts_of", lambda rest, language: seen.extend(rest) or [told(c, language) for c in rest])
    monkeypatch.setattr(tables, "count_chunk", lambda content, *_: pytest.fail(f"scanned again: {content}"))
    assert tables.counts_of_many(contents[half:], language) == [told(c, language) for c in contents[half:]]
    return len(seen)


@pytest.mark.parametrize("name", _SOME)
def test_files_of_families_are_looked_up(tables, monkeypatch, name):
    language, _, parts = FAMILIES[name][:3]
    contents = ["".join(x[0] * (k % 50) if isinstance(x, tuple) else x for x in parts).encode() for k in range(200)]
    assert scanned_again(tables, monkeypatch, contents, L[language]) == 0


def test_tables_equal_lines(tables, monkeypatch):
    """Random files of every language, with room for few lines and for many."""
    rng = random.Random(5)
    generic = [b"x\n", b"\n", b"\n", b" ", b"x", b"\r\n", b"\r", b"\\\n", b"'", b'"', b"\xc2\xa0\n", b"#!", b"\xef\xbb\xbf", b"\x0b", b"(", b")\n", b":\n", b"    ", b"1'0", b"/", b"${", b"}"]
    for room in (30, 5_000):
        monkeypatch.setattr(tables, "KNOWN", room)
        monkeypatch.setattr(tables, "ALL", 10**9)
        tables._table.cache_clear()
        for language in L.values():
            r = language.scanner_rules()
            markers = [x.encode() for pair in language.blocks for x in pair] + [x.encode() for x in language.lines]
            if r is not None:
                markers = [x for p in (*r.blocks, *r.quotes, *r.docs) for x in (p.open, p.close)] + list(r.lines)
            parts = generic + markers + [m + b"\n" for m in markers]
            texts = [b"".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(40)]
            assert tables.counts_of_many(texts, language) == [told(t, language) for t in texts], language.name


def test_what_is_kept_is_bounded(tables, monkeypatch):
    monkeypatch.setattr(tables, "KNOWN", 100)
    monkeypatch.setattr(tables, "ALL", 150)
    for name in ("Go", "HTML"):
        texts = [b"".join(b"x%d // %d\n" % (k, j) for j in range(20)) + b"<!--\n/*\n" for k in range(50)] + [b"y" * 1_000 + b"\n", b"/*\n" * 3]
        assert tables.counts_of_many(texts, L[name]) == [told(t, L[name]) for t in texts]
        assert sum(len(x) - 1 for x in tables.line_table(L[name]).states.values()) <= 100
    assert tables.LineTable.kept == 150


def test_deep_states_are_not_kept(tables):
    deep = b"/*\n" * 500 + b"*/\n" * 500 + b"x\n"
    assert tables.counts_of_many([deep, deep], L["Rust"]) == [told(deep, L["Rust"])] * 2
    assert max(map(len, tables.line_table(L["Rust"]).states)) < 2 * tables.LINE


def test_languages_that_differ_in_rules_only(tables):
    sql, own = L["SQL"], Language("SQL", L["SQL"].lines, L["SQL"].blocks, L["SQL"].patterns)
    text = b"select '/*'\nfrom a\n/* b */ c\n"
    assert sql == own and told(text, sql) != told(text, own)
    assert [tables.counts_of_many([text], x) for x in (sql, own, sql)] == [[told(text, x)] for x in (sql, own, sql)]


def test_html_files_are_looked_up(tables, monkeypatch):
    assert scanned_again(tables, monkeypatch, [shape("HTML", k) for k in range(400)], L["HTML"]) == 0


def test_cpp_files_are_looked_up(tables, monkeypatch):
    assert scanned_again(tables, monkeypatch, [shape("C++", k) for k in range(400)], L["C++"]) == 0


def test_javascript_files_are_looked_up(tables, monkeypatch):
    assert scanned_again(tables, monkeypatch, [shape("JavaScript", k) for k in range(400)], L["JavaScript"]) == 0


def test_parts_are_counted_once_for_all_languages(spark, monkeypatch):
    from loomline import queries

    dealt, rows = [], queries.part_rows
    monkeypatch.setattr(queries, "part_rows", lambda *args: (dealt.append(args), rows(*args))[1])
    result = queries.many_languages(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert {r["name"]: r["files"] for r in result.languages.collect()} == {FAMILIES[x][0]: n for x in _SOME}
    assert len(dealt) == 1
    result.unpersist()


def test_reports_deal_parts_once(spark, monkeypatch):
    from loomline import queries

    dealt, rows = [], queries.part_rows
    monkeypatch.setattr(queries, "part_rows", lambda *args: (dealt.append(args), rows(*args))[1])
    lines = [r["line"] for r in queries.QUERIES["q46_xml"](spark, "/root/testdata/sf0.001").orderBy("line_no").collect()]
    assert len(dealt) == 1 and len(lines) == 6 + len(_SOME) and lines[-1] == "</results>"
    spark.catalog.clearCache()


def test_lines_are_looked_up_as_they_are_split(tables):
    """No line is put together again with its line feed, those with a carriage return (C++ has many) neither."""
    text = b"int a;\r\nint a;\n\r\n\n// c\\\r\n\rd\n/* x\n"
    for content in (text, text[:-1], text + b"\r", text + b"int a;", b"int a;", b"\n", b"\r", b""):
        assert tables.counts_of_many([content] * 2, L["C++"]) == [told(content, L["C++"])] * 2
    kept = {x for state in tables.line_table(L["C++"]).states.values() for x in state if x is not None}
    assert {b"int a;\r", b"int a;", b"\nint a;", b"\n\r", b""} <= kept and not any(x.endswith(b"\n") for x in kept)
