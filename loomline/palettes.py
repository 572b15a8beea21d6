"""Pieces of source text with the lines of code, comment and blank that each must give.

A query makes files of 32 pieces, picked by the hexadecimal digits of a key's MD5, so that files of very
many shapes go through the scanners; what they must give is the sum over their digits.  Pieces end where
the scanner is back in plain code, so that sums hold.
"""

from __future__ import annotations

#: language -> extension, first line (code) and sixteen pieces
PALETTES: dict[str, tuple[str, str, tuple[tuple[str, int, int, int], ...]]] = {
    "Go": ("go", "package p\n", (
        ("x := 1\n", 1, 0, 0), ("// note\n", 0, 1, 0), ("\n", 0, 0, 1), ("/* a\n\nb */\n", 0, 2, 1), ('s := "// no /* no" // c\n', 1, 0, 0), ("t := `raw\n// raw\n\n/* raw`\n", 3, 0, 1),
        ("\t/* c */ y()\n", 1, 0, 0), ("y() /* d\n e */\n", 1, 1, 0), (" \t \n", 0, 0, 1), ("r := '\"' // q\n", 1, 0, 0), ("/* é\u3000 */\n", 0, 1, 0), ("\u3000\u00a0\n", 0, 0, 1), ("a := b / c\n", 1, 0, 0),
        ("/**/\n", 0, 1, 0), ('// "open\n', 0, 1, 0), ("}\r\n", 1, 0, 0),
    )),
    "Python": ("py", "import a\n", (
        ("x = 1\n", 1, 0, 0), ("# c\n", 0, 1, 0), ("\n", 0, 0, 1), ('s = """a\n# in\n\n"""\n', 3, 0, 1), ('def f():\n    """doc\n    more"""\n    return 1\n', 2, 2, 0), ('class A:\n    "d"\n\n    x = 2\n', 2, 1, 1),
        ("y = (1,\n# in\n  2)\n", 2, 1, 0), ("z = 'a # b'  # c\n", 1, 0, 0), ("'loose'\n", 1, 0, 0), ('w = """one"""\n', 1, 0, 0), ("async def g(a,\n            b):\n    '''d'''\n    pass\n", 3, 1, 0),
        ("v = 1 + \\\n    2\n", 2, 0, 0), ("   \t\n", 0, 0, 1), ("b'''x\n'''\n", 2, 0, 0), ("    # further in\n", 0, 1, 0), ("u = [\n\n]\n", 2, 0, 1),
    )),
    "JavaScript": ("js", "'use strict';\n", (
        ("let a = 1;\n", 1, 0, 0), ("// c\n", 0, 1, 0), ("\n", 0, 0, 1), ("/* a\nb */\n", 0, 2, 0), ("const r = /[/*]/; // x\n", 1, 0, 0), ("t = `a\n// in\n${ b /* c */ }\n`;\n", 4, 0, 0), ("x = a / b / c; // d\n", 1, 0, 0),
        ("s = '// no';\n", 1, 0, 0), ("if (/\\/\\*/.test(y)) { z(); }\n", 1, 0, 0), ("f(`${ g(`n`) }`); // e\n", 1, 0, 0), ("/** doc\n *\n\n */\n", 0, 3, 1), ('return /"/.exec(q); // r\n', 1, 0, 0), (" \n", 0, 0, 1),
        ("x = y; // z\n", 1, 0, 0), ("/* a */ b();\n", 1, 0, 0), ("// `open\n", 0, 1, 0),
    )),
    "Rust": ("rs", "use a;\n", (
        ("let a = 1;\n", 1, 0, 0), ("// c\n", 0, 1, 0), ("\n", 0, 0, 1), ("/* a /* b */\nc */\n", 0, 2, 0), ('let s = "// no";\n', 1, 0, 0), ('let r = r#"\n// raw " no\n"#;\n', 3, 0, 0), ("fn f<'a>(x: &'a str) {} // t\n", 1, 0, 0),
        ("let c = '\"'; // q\n", 1, 0, 0), ("/// doc\n", 0, 1, 0), ("let q = '\\''; /* e */\n", 1, 0, 0), ("/* é */ }\n", 1, 0, 0), (" \t\n", 0, 0, 1), ('let t = "a\n\n/* in */";\n', 2, 0, 1), ("let d = b'x';\n", 1, 0, 0),
        ("//! m\n", 0, 1, 0), ('let u = br"//";\n', 1, 0, 0),
    )),
    "C++": ("cpp", "int z;\n", (
        ("int a;\n", 1, 0, 0), ("// c\n", 0, 1, 0), ("\n", 0, 0, 1), ("/* a\n * b\n */\n", 0, 3, 0), ('auto s = R"x(\n// raw )"\n)x"; // c\n', 3, 0, 0), ("int n = 1'000'000; // d\n", 1, 0, 0), ("// joined \\\nstill\n", 0, 2, 0),
        ("#define A \\\n  1\n", 2, 0, 0), ("char c = '\"'; // e\n", 1, 0, 0), ('s = "a \\" // b";\n', 1, 0, 0), ("/* x */ f();\n", 1, 0, 0), (" \r\n", 0, 0, 1), ('x = u8R"(/*)";\n', 1, 0, 0), ("c = L'a' /* y */;\n", 1, 0, 0),
        ("a / b;\n", 1, 0, 0), ("//\n", 0, 1, 0),
    )),
    "SQL": ("sql", "select 1\n", (
        ("select a\n", 1, 0, 0), ("-- c\n", 0, 1, 0), ("\n", 0, 0, 1), ("/* a\nb\n*/\n", 0, 3, 0), ("select 'it''s -- no' -- yes\n", 1, 0, 0), ("from t -- d\n", 1, 0, 0), ("/* x */ where b\n", 1, 0, 0), ("where c /* y\n*/\n", 1, 1, 0),
        ("\t\n", 0, 0, 1), ("--\n", 0, 1, 0), ("a - b\n", 1, 0, 0), ("'/* no */'\n", 1, 0, 0), ("/* é */\n", 0, 1, 0), ("-- 'open\n", 0, 1, 0), (")\r\n", 1, 0, 0), ("a / b\n", 1, 0, 0),
    )),
    "HTML": ("html", "<html>\n", (
        ("<p>\n", 1, 0, 0), ("<!-- c -->\n", 0, 1, 0), ("\n", 0, 0, 1), ("<!-- a\n\nb -->\n", 0, 2, 1), ("<!-- c -->x\n", 0, 1, 0), ("<!-- c --> xy\n", 1, 0, 0), ("a<!-- c -->\n", 1, 0, 0), ("<!-- c --> <!-- d -->\n", 0, 1, 0),
        ("<!-- c -->x\u3000<!-- d -->\n", 1, 0, 0), ("<!-- é\u3000 -->\n", 0, 1, 0), ("// d\n", 0, 1, 0), ("\u3000\n", 0, 0, 1), ("é\n", 1, 0, 0), ("text <b>\n", 1, 0, 0), ("\t<i>\r\n", 1, 0, 0), ("-->\n", 1, 0, 0),
    )),
    "Ruby": ("rb", "x = 0\n", (
        ("x = 1\n", 1, 0, 0), ("# c\n", 0, 1, 0), ("\n", 0, 0, 1), ("=begin\na\n\nb\n=end\n", 0, 4, 1), (" =begin\n", 1, 0, 0), ('s = "# no" # c\n', 1, 0, 0), ("y = 'a # b'\n", 1, 0, 0), ("  # in\n", 0, 1, 0), (" \n", 0, 0, 1), ("z += 1\n", 1, 0, 0),
        ("=begin\n=end\n", 0, 2, 0), ("end\r\n", 1, 0, 0), ("p 1 # =begin\n", 1, 0, 0), ("#\n", 0, 1, 0), ("é = 1\n", 1, 0, 0), ("=begin\n  =end\n=end\n", 0, 3, 0),
    )),
}
