"""Kinds of physical lines: C code, M comment or documentation, B blank."""

import random

import pytest

from loomline.functions.classify import counts, counts_of, kinds, line_records, physical_lines
from loomline.functions.languages import Language, builtin, check_rules

L = builtin()

CASES = [
    ("Go", "package a\n\n// note\nx := `raw // no\n/* no */` // tail\n/* one\n\ntwo */ y()\n", "CBMCCMBC"),
    ("Go", "a := '\"' /* c */\n// d", "CM"),
    ("C", "// spliced \\\nstill a comment\nint x; /* c */\n/* a\n*/\n", "MMCMM"),
    ("C", 'char *s = "/* \\" no";\n// yes\n', "CM"),
    ("C", '"open\n// recovered\n', "CM"),
    ("C++", 'auto s = R"x(\n// raw\n)" )x";\n// c\n', "CCCM"),
    ("C++", "int n = 1'000'000; // sep\n/* x */\n", "CM"),
    ("C++", "﻿int a;\r\n\r\n// b\r\n", "CBM"),
    ("Java", 'String s = """\n// text\n\n""";\n// c\n', "CCBCM"),
    ("Rust", "/* a /* b */\nstill */\nfn f<'a>() {} // x\nlet s = r#\"\n// raw \" no\n\"#;\n", "MMCCCC"),
    ("Rust", "let c = '\"'; // ok\n// d\n", "CM"),
    ("JavaScript", "const r = /[/*]/; // x\nlet t = `a ${ /* in */ f({a: `n`}) } // b\n`;\n// c\n", "CCCM"),
    ("JavaScript", "let a = b / c; // d\n/* e */\nreturn /\\/*x/\n// f\n", "CMCM"),
    ("Python", '"""Doc\n\nmore"""\nx = """not\ndoc"""\ndef f():\n    "doc"\n    \'\'\'more\'\'\'\n    return 1  # c\n# d\n', "MBMCCCMCCM"),
    ("Python", 'class A(\n    B):\n    r"""doc"""\n    b"""no"""\n', "CCMC"),
    ("Python", "def f(): return 1\n'x'\n", "CC"),
    ("Python", 's = "a \\\n# still"\n# c\n', "CCM"),
    ("Starlark", '"""module"""\nx = 1\n"""loose"""\n', "MCC"),
    ("C#", 'var p = @"a\n""// in""";\n// c\n', "CCM"),
    ("F#", "(* a (* b *)\nc *)\nlet x = 1 // d\n", "MMC"),
    ("SQL", "select 'it''s -- no' -- yes\n-- c\n/* d */\n", "CMM"),
    ("Lua", "--[[ long\nblock ]]\n-- line\nprint('--')\n", "MMMC"),
    ("CoffeeScript", "###\nblock\n###\n# line\nx = 1\n", "MMMMC"),
    ("Nim", "#[ a #[ b ]# ]#\necho 1\n", "MC"),
    ("Kotlin", "/* a /* b */ c */ val x = 1\n/* d */\n", "CM"),
    ("BASH", "#!/bin/bash\n# c\necho \"a\n# in\n\"\n", "CMCCC"),
    ("FORTRAN Legacy", "c comment\nC too\n      call f ! tail\n* star\n! bang\n      x = c\n", "MMCMMC"),
    ("Batch", "@echo off\nrem c\nREM d\n:: e\nremark\n", "CMMMC"),
    ("Visual Basic", "Dim s = \"a 'b\"\n' c\n", "CM"),
    ("Ruby", "=begin\ntext\n=end\nx = 1\n  =begin\n# c\n", "MMMCCM"),
    ("Perl", "=pod\ndoc\n=cut\nprint 1;\n", "MMMC"),
    ("Pony", '"""\ndoc\n"""\nlet s = """\nno\n"""\n', "MMMCCC"),
    ("XML", "<a>\n<!-- c\n-->\n<b t=\"<!--\"/>\n", "CMMC"),
    ("M4", "dnl c\nundnl x\n# d\n", "MCM"),
    ("PowerShell", "<# a\n#>\n# b\n@'\n# in\n'@\n", "MMMCCC"),
    ("Haskell", "{- a {- b -}\n-}\n-- c\nx = 1\n", "MMMC"),
    ("JSON", "{}\n\n[]\n", "CBC"),
    ("Clojure", "; c\n(def s \"; no\")\n", "MC"),
    ("HTML", "<p>\n<!-- a\nb -->\n<!-- c -->x\n// d\n", "CMMMM"),
    ("HTML", "<!-- c --> xy\n", "C"),
    ("Svelte", "a /* b\n*/\n<!-- c -->\nx\n", "CMMC"),
    ("ANTLR", "x /* a /* b */\ny\n*/\nz\n", "CMMC"),
    ("ANTLR", "a /* b */ c\n/* b */ c\n/*c*/x\n/**/\ny\n", "CCMMM"),
    ("ANTLR", 's = "/*"\ny\n', "CM"),
    ("Just", "#!/bin/sh\n#!x\n# c\nx:\n", "CCMC"),
    ("Plain Text", "a\n  \n\u0085\nb", "CBBC"),
    ("VimL", "\" c\nlet x = 1\n", "MC"),
]


@pytest.mark.parametrize(("language", "source", "expected"), CASES)
def test_kinds(language, source, expected):
    assert kinds(source.encode(), L[language]) == expected


def test_edges():
    for language in L.values():
        assert counts(b"", language) == (0, 0, 0)
        assert kinds(b" \n\t\n\xe2\x80\x83\n", language) == "BBB"
    assert physical_lines(b"a\nb") == [b"a\n", b"b"]
    assert kinds(b"\xff\xfe\n/*\xff*/x\n", L["C"]) == "CC"
    assert kinds(b"\n#!/x\n", L["Python"]) == "BM"
    assert kinds(b"a\n/* x\n#!y\n*/\n", L["ANTLR"]) == "CMCM"
    assert kinds(b"x" * (128 << 10) + b" // c\n// d\n", L["Java"]) == "CM"


def test_conservation_and_isolation():
    """Each physical line has one kind, and a scanner keeps nothing between files."""
    rng = random.Random(7)
    parts = [b'"', b"'", b"`", b"/*", b"*/", b"//", b"#", b"--", b"{-", b"-}", b"\\", b"\n", b"\n", b" ", b"x", b"r#", b"R\"(", b"${", b"}", b"'''", b'"""', b"=begin", b"def f():", b"\xc3\xa9", b"\xff", b"rem", b"<!--", b"-->"]
    for language in L.values():
        for _ in range(12):
            source = b"".join(rng.choice(parts) for _ in range(rng.randrange(60)))
            once = kinds(source, language)
            assert len(once) == len(physical_lines(source))
            assert once == kinds(source, language)
            for (kind, _, text, _), k in zip(line_records(source, language), once, strict=True):
                assert (kind == "B") == (not text) or text.startswith(b"\xef\xbb\xbf")
                assert kind == k


def test_table():
    assert len(L) == 188
    known = {"Vimscript"}
    for language in L.values():
        if language.rules is not None and language.name not in known:
            assert check_rules(language.rules) == [], language.name


def test_callers_languages():
    own = Language("Mine", ("%",), (("<<", ">>"),))
    assert kinds(b"% a\n<< b\n>>\n<<c>> d\nx\n", own) == "MMMCC"
    assert kinds(b"a // b\n/* c\n*/\n", Language("Go", ("//",), (("/*", "*/"),))) == "CMM"
    assert kinds(b's = "/*"\ny\n', Language("Go", ("//",), (("/*", "*/"),))) == "CC"
    assert kinds(b"#a\n#!b\n", Language("J", ("#",)).with_patterns(["^#[^!].*"])) == "MC"


def test_whole_files_equal_lines():
    """Counts of a whole file at once against the line scanners, on random files of every language."""
    rng = random.Random(21)
    generic = [b"x", b" ", b"\n", b"\n", b"\n", b"\t", b"\xe3\x80\x80", b"\xc2\xa0", b"\xc3\xa9", b"#!", b"\xef\xbb\xbf", b"\r\n", b"\x80", b"\\", b"'", b'"', b"1", b"'0", b"\\\n", b"\x0b"]
    generic += [b"\\\r\n", b"\\\\\n", b'R"(', b')"', b'R"a(', b')a"', b'r#"', b'"#', b"'a'", b"'\\n'", b"'\\u{1}'", b".", b"0x1'f", b"1'0'0", b"L'a'", b"'a "]
    for language in L.values():
        r = language.scanner_rules()
        markers = [x.encode() for pair in language.blocks for x in pair] + [x.encode() for x in language.lines]
        if r is not None:
            markers = [x for p in (*r.blocks, *r.quotes, *r.docs) for x in (p.open, p.close)] + list(r.lines)
        for k in range(120):
            parts = generic + markers * rng.choice([1, 3])
            if k % 3 == 0:
                parts = [x for x in parts if b"\\" not in x]
            text = b"".join(rng.choice(parts) for _ in range(rng.randrange(40)))
            found = kinds(text, language)
            assert counts(text, language) == tuple(found.count(c) for c in "CMB"), (language.name, text)


def test_many_files_equal_lines():
    """Files that are counted together keep nothing of each other; tokens of JavaScript and Python."""
    rng = random.Random(9)
    parts = [b"x", b" ", b"\n", b"\n", b"\n", b"\t", b"\xc2\xa0", b"\r\n", b"\\", b"'", b'"', b"1", b"\\\n", b"#", b"//", b"/*", b"*/", b"/", b"`", b"${", b"}", b"{", b"(", b")", b"[", b"]", b"return ", b"=", b",", b"a/b", b'"""', b"\'\'\'", b"def f():", b"class A:", b"\n    ", b":", b"r'", b'b"""', b"#!", b"\xef\xbb\xbf", b"\r"]
    for language in map(L.get, ("Python", "Starlark", "JavaScript", "TypeScript", "Go")):
        for _ in range(150):
            texts = []
            for _ in range(rng.randrange(20)):
                some = [*rng.sample(parts, rng.randrange(3, len(parts))), b"\n"]
                texts.append(b"".join(rng.choice(some) for _ in range(rng.randrange(25))))
            assert counts_of(texts, language) == [tuple(kinds(t, language).count(c) for c in "CMB") for t in texts]


def test_most_languages_are_counted_at_once():
    from loomline.functions.wholefile import whole_file

    assert sum(whole_file(x.scanner_rules()) is not None for x in L.values() if x.scanner_rules()) > 120
    go = whole_file(L["Go"].scanner_rules())
    assert go.counts(b'a // "x\n"// b" /* c\n\n*/\nd\n') == (3, 1, 1)


def table_rows():
    from loomline.functions.languages import table_path

    with open(table_path(), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ("Go\tgo", "Go\tgo\tx"), ("\trules\t", "\tsomehow\t"), ("Ada\tada", "ActionScript\tada"), ("fast splice", "fast slice"), ("'…'…\\\t\tfast splice", "'…'…q\t\tfast splice"),
        ("\trules\t//\t/*…*/\t\"…\"…\\ '…'…\\\t\tfast splice", "\trules\t// #\t/*…*/\t\"…\"…\\ '…'…\\\t\tfast splice"), ("\tlegacy\t", "\tlegacy\t#"), ("\n", "\t\n"),
    ],
)
def test_rule_tables_that_are_refused(old, new):
    from loomline.functions.languages import RuleTableError, languages_of, read_rows

    text = "".join(x for x in table_rows().splitlines(True) if not x.startswith("#"))
    assert len(languages_of(read_rows(text))[0]) == 188 and old in text
    with pytest.raises(RuleTableError):
        languages_of(read_rows(text.replace(old, new, 1)))


def test_rule_coverage():
    from loomline.functions.languages import can_skip, rule_coverage

    rows = rule_coverage()
    assert len(rows) == 188 and sum(x[1] == "rules" for x in rows) == 138
    assert can_skip(L["Go"].rules) and not can_skip(L["Python"].rules)
    assert L["C"].rules.features >= {"fast"}
