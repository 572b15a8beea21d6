"""Formats, sorts and the command line."""

import io

import pytest

from loomline.api import LanguageRegistry, Report, json_files, json_languages, pipe_columns, render
from loomline import __version__
from loomline.cli import main
from loomline.operators.output import compact_json, module_of

ROWS = [{"name": "Go", "files": 2, "code": 10, "comment": 3, "blank": 1}]
FILES = [{"name": "./cmd/a&b.go", "language": "Go", "code": 10, "comment": 3, "blank": 1}]
TOTAL = {"files": 2, "code": 10, "comment": 3, "blank": 1}


def lines(kind, by_file=False):
    return "".join(render(Report(by_file, FILES if by_file else ROWS, TOTAL, 12), kind)).splitlines()


def test_text_table():
    out = lines("default")
    assert out[0] == "-" * 79 and len(out) == 7
    assert out[3] == "Go" + " " * 25 + " " + "     2" + " " * 14 + "1" + " " * 14 + "3" + " " * 13 + "10"
    assert lines("default", True)[0] == "-" * 64


def test_markdown_widths():
    out = lines("markdown")
    assert len({len(x) for x in out}) == 1 and out[1].startswith("|:") and out[1].count(":") == 5
    assert pipe_columns("a    b  c") == "a | b|c |"


def test_json():
    assert json_languages([], {**TOTAL, "files": 0}) == '{"languages":null,"total":{"files":0,"code":10,"comment":3,"blank":1}}'
    assert json_files(FILES, TOTAL).startswith('{"files":[{"code":10,"comment":3,"blank":1,"name":"./cmd/a\\u0026b.go","language":"Go"}]')
    assert compact_json("< >é") == '"\\u003c\\u2028\\u003eé"'


def test_xml_and_sloc():
    assert lines("cloc-xml", True)[3] == '    <file code="10" comment="3" blank="1" name="./cmd/a&amp;b.go" language="Go"></file>'
    assert lines("cloc-xml")[4] == '    <total sum_files="2" code="10" comment="3" blank="1"></total>'
    assert lines("sloccount", True) == ["10\tGo\tcmd\t./cmd/a&b.go"]
    assert [module_of(p) for p in ("/a/b", "a/b/c", "./x", "/a")] == ["a", "", "", ""]
    assert len(lines("sloccount")) == 1
    with pytest.raises(ValueError):
        lines("nothing")


def test_write_errors():
    from loomline.operators import output

    class Broken(io.StringIO):
        def write(self, s):
            raise OSError("full")

    with pytest.raises(OSError, match="full"):
        for part in output.render(Report(False, ROWS, TOTAL), "json"):
            Broken().write(part)


def test_listing():
    listing = LanguageRegistry.default().listing()
    assert len(listing) == 188 and dict(listing)["Motoko"] == ["mo"] and dict(listing)["C++"] == ["c++", "cc", "cpp", "cxx", "pcc"]
    assert "Go                             (go, go2)\n" in LanguageRegistry.default().formatted()


def run(*argv, spark=None):
    out, err = io.StringIO(), io.StringIO()
    return main(list(argv), out, err, spark), out.getvalue(), err.getvalue()


@pytest.mark.parametrize("argv", [["-w", "0", "-V"], ["-w", "65", "x"], ["-w", "0x1", "x"], ["-s", "size", "-L"], ["-f", "-s", "files", "x"], ["--dedup", "--skip-duplicated", "x"], ["--match", "(", "x"], ["-o", "csv", "x"], ["--nope"], ["--dedup=maybe", "x"]])
def test_bad_arguments(argv):
    code, out, err = run(*argv)
    assert code == 1 and out == "" and err.count("\n") == 1


def test_information():
    assert run("-V")[0] == 0 and run("-V")[1].startswith(__version__)
    assert "Zig" in run("-L")[1] and "PATH" in run()[1]


def test_analysis(spark, tmp_path):
    (tmp_path / "a.go").write_text("x\n// y\n")
    (tmp_path / "b.go").write_text("x\n// y\n")
    code, out, err = run(str(tmp_path), "-o", "json", "--skip-duplicated=false", "--debug", spark=spark)
    assert code == 0 and '"total":{"files":1,"code":1,"comment":1,"blank":0}' in out
    assert err.count("[SKIP]") == 1 and err.count("[CODE]") == 1 and err.count("[COMM]") == 1
    assert err.count("[FILE]") == 2 and "[LANG]" not in err and err.index("[FILE]") < err.index("[CODE]")
    assert '"files":2' in run("-o", "json", "--", str(tmp_path), spark=spark)[1]
    (tmp_path / "c.ts").write_text("")
    err = run(str(tmp_path), "--debug", spark=spark)[2]
    assert err.count("[LANG]") == 1 and "language='TypeScript'" in err and err.index("[LANG]") < err.rindex("[FILE]")
