"""Queries over the test tables for every operator, each with the SQL that gives the same rows.

Carriers of source text: the documents (T), the pages' markup (H), files generated from ``part`` (G),
whose counts are closed forms of ``p_size``, files of many shapes (``palettes``), and a small tree in
the shared folder.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cli import main, options_of, parser
from .functions.languages import Language, LanguageRegistry, RuleTableError, languages_of, read_rows, rule_coverage, table_path
from .functions.sql import register
from .operators.output import collect_report, json_languages, read_report_parts, render, write_report_parts
from .operators.sorting import sort_files_with_position, sort_keys, with_position
from .palettes import PALETTES
from .plans.engine import Processor, Result, analyze, analyze_content, analyze_files, by_language
from .plans.options import OptionError, Options
from .sources.folders import plain_path, work_dir
from .sources.stores import LocalStore, store_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- carrier T -----------------------------------------------------------------------------------

T_PATH = "source || '/doc' || doc_id || '.txt'"
LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x, i: i < len(string_split(coalesce(text, ''), chr(10))) OR x <> '')"
T_SQL = f"""
SELECT doc_id, lang, source, text, {T_PATH} AS path, len({LINES}) AS n,
  len(list_filter({LINES}, lambda x: regexp_matches(x, '^[\\s\\x{{85}}\\p{{Z}}]*$'))) AS blank FROM documents"""
T_COUNTS = "CAST(count(*) AS BIGINT) AS files, CAST(coalesce(sum(n - blank), 0) AS BIGINT) AS code, CAST(0 AS BIGINT) AS comment, CAST(coalesce(sum(blank), 0) AS BIGINT) AS blank"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), "lang")


def plain(spark: SparkSession, sf_dir: str, **options) -> Result:
    return analyze_content(texts(spark, sf_dir), Options(**options), language="Plain Text")


@query("q01_text_by_lang", f"SELECT lang AS name, {T_COUNTS} FROM ({T_SQL}) GROUP BY lang")
def q01(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = plain(spark, sf_dir).scanned.join(langs, F.col("seq") == F.col("doc_id")).drop("language").withColumnRenamed("lang", "language")
    return by_language(rows)


@query("q02_text_total", f"SELECT {T_COUNTS} FROM ({T_SQL})")
def q02(spark, sf_dir):
    return plain(spark, sf_dir).total


@query("q03_text_rollup", f"SELECT regexp_extract(path, '^[^/]*') AS folder, {T_COUNTS} FROM ({T_SQL}) GROUP BY 1 UNION ALL SELECT 'TOTAL', {T_COUNTS} FROM ({T_SQL})")
def q03(spark, sf_dir):
    rows = plain(spark, sf_dir).scanned.withColumn("folder", F.substring_index("path", "/", 1))
    out = rows.rollup("folder").agg(F.grouping("folder").alias("all"), F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("code", "comment", "blank")])
    return out.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("folder")).alias("folder"), "files", "code", "comment", "blank")


FIRST_SQL = f"SELECT path, n, blank, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM ({T_SQL})"


@query("q04_text_dedup_first", f"SELECT path AS name, 'Plain Text' AS language, CAST(n - blank AS BIGINT) AS code, CAST(0 AS BIGINT) AS comment, CAST(blank AS BIGINT) AS blank FROM ({FIRST_SQL}) WHERE r = 1")
def q04(spark, sf_dir):
    return plain(spark, sf_dir, dedup=True).files


@query("q05_text_dedup_dropped", f"SELECT path, 'duplicate content' AS message FROM ({FIRST_SQL}) WHERE r > 1")
def q05(spark, sf_dir):
    return plain(spark, sf_dir, dedup=True).diagnostics.select("path", "message")


@query("q06_max_path", f"SELECT CAST(coalesce(max(strlen(path)), 0) AS BIGINT) AS max_path_length FROM ({T_SQL})")
def q06(spark, sf_dir):
    return plain(spark, sf_dir).max_path_length


# --- carrier H and conversations --------------------------------------------------------------------

H_SQL = "SELECT page_id, url, unnest(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))) AS line FROM pages"
H_COUNTS = "CAST(count(DISTINCT page_id) AS BIGINT) AS files, CAST(sum(CASE WHEN regexp_matches(line, '^<!--.*-->$') THEN 0 ELSE 1 END) AS BIGINT) AS code, CAST(sum(CASE WHEN regexp_matches(line, '^<!--.*-->$') THEN 1 ELSE 0 END) AS BIGINT) AS comment, CAST(0 AS BIGINT) AS blank"


def markup(spark: SparkSession, sf_dir: str) -> Result:
    p = table(spark, sf_dir, "pages")
    return analyze_content(p.select(F.col("page_id").alias("seq"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.replace("html", F.lit("><"), F.lit(">\n<")).alias("content")))


@query("q07_html_counts", f"SELECT 'HTML' AS name, {H_COUNTS} FROM ({H_SQL})")
def q07(spark, sf_dir):
    return markup(spark, sf_dir).languages


@query("q08_html_by_host", f"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS name, {H_COUNTS} FROM ({H_SQL}) GROUP BY 1")
def q08(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return by_language(markup(spark, sf_dir).scanned.drop("language").join(hosts, F.col("seq") == F.col("page_id")).withColumnRenamed("host", "language"))


C_LINES = LINES
C_BLANK = f"len(list_filter({LINES}, lambda x: regexp_matches(x, '^[\\s\\x{{85}}\\p{{Z}}]*$')))"


@query(
    "q09_conversation_lines",
    f"SELECT role AS name, CAST(count(*) AS BIGINT) AS files, CAST(sum(len({C_LINES}) - {C_BLANK}) AS BIGINT) AS code, CAST(0 AS BIGINT) AS comment, CAST(sum({C_BLANK}) AS BIGINT) AS blank FROM conversations GROUP BY role",
)
def q09(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.xxhash64("conv_id", "turn").alias("seq"), F.concat("role", F.lit("/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    scanned = analyze_content(rows, language="Plain Text").scanned
    return by_language(scanned.withColumn("language", F.substring_index("path", "/", 1)))


# --- path and language filters ------------------------------------------------------------------------


def _filtered(name: str, where: str, **options) -> None:
    @query(name, f"SELECT path AS name, CAST(n - blank AS BIGINT) AS code FROM ({T_SQL}) WHERE {where}")
    def run(spark, sf_dir):
        return plain(spark, sf_dir, **options).files.select("name", "code")


BASE = "regexp_extract(path, '[^/]*$')"
DIR = "regexp_replace(path, '/[^/]*$', '')"
_filtered("q10_path_match", f"regexp_matches({BASE}, '^doc[0-9]*7\\.')", match=r"^doc[0-9]*7\.")
_filtered("q11_path_notmatch", f"NOT regexp_matches({BASE}, '[13579]\\.txt$')", not_match=r"[13579]\.txt$")
_filtered("q12_dir_match", f"regexp_matches({DIR}, 'src1[0-5]$')", match_dir=r"src1[0-5]$")
_filtered("q13_dir_notmatch", f"NOT regexp_matches({DIR}, 'src[0-4]')", not_match_dir="src[0-4]")
_filtered("q14_fullpath", "regexp_matches(path, '^src7/') AND NOT regexp_matches(path, '0\\.txt$')", match="^src7/", not_match=r"0\.txt$", fullpath=True)

EXTENSIONS = ("txt", "md", "json", "rst", "zzz", "Rmd", "text", "tex.bak")
M_LANGUAGE = "CASE doc_id % 8 WHEN 0 THEN 'Plain Text' WHEN 1 THEN 'Markdown' WHEN 2 THEN 'JSON' WHEN 3 THEN 'ReStructuredText' WHEN 5 THEN 'RMarkdown' WHEN 6 THEN 'Plain Text' END"
M_SQL = f"SELECT *, {M_LANGUAGE} AS language FROM ({T_SQL}) WHERE {M_LANGUAGE} IS NOT NULL"
M_COUNTS = f"SELECT language AS name, {T_COUNTS} FROM ({M_SQL})"


def mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return d.select(F.col("doc_id").alias("seq"), path.alias("path"), F.col("text").alias("content"))


def mixed(spark: SparkSession, sf_dir: str, **options) -> Result:
    return analyze_content(mixed_rows(spark, sf_dir), Options(**options))


def _mixed(name: str, where: str, **options) -> None:
    @query(name, f"{M_COUNTS} WHERE {where} GROUP BY language")
    def run(spark, sf_dir):
        return mixed(spark, sf_dir, **options).languages


_mixed("q15_include_lang", "language IN ('Plain Text', 'JSON')", include_langs=("Plain Text", "JSON"))
_mixed("q16_exclude_ext", "language NOT IN ('Plain Text', 'Markdown')", exclude_exts=("text", "Markdown", "ts"))
_mixed("q17_exclude_beats_include", "language = 'JSON'", include_langs=("JSON", "Markdown"), exclude_exts=("md",))
_mixed("q18_unknown_include", "true", include_langs=("No Such Language",))
_mixed("q19_ext_detect", "true")

NAMES = ("meson.build", "CMakeLists.txt", "Makefile.am", "pom.xml", "build.xml", "JUSTFILE", "makefile", "Dockerfile", "rebar", "noext", "dune", "configure.ac")
NAMED_AS = {0: "Meson", 1: "CMake", 2: "Makefile", 3: "Maven", 4: "Ant", 5: "Just", 6: "Makefile", 7: "Dockerfile", 10: "Dune", 11: "M4"}


@query("q20_name_detect", "SELECT CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMED_AS.items()) + " END AS name, CAST(count(*) AS BIGINT) AS files FROM documents WHERE doc_id % 12 NOT IN (8, 9) GROUP BY 1")
def q20(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    base = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 12 + 1).cast("int"))
    return analyze_content(d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), base).alias("path"), F.col("text").alias("content"))).languages.select("name", "files")


SHEBANGS = ("#!/usr/bin/env python3", "#!/bin/sh -e", "#!/usr/bin/perl", "#!/usr/bin/env node", "#! /usr/bin/env ruby", "#!/usr/bin/make -f", "#!/usr/bin/env -S python", "no shebang", " #!/usr/local/bin/escript")
BANGED_AS = {0: "Python", 1: "Bourne Shell", 2: "Perl", 4: "Ruby", 7: "JavaScript", 8: "Erlang"}


@query("q21_shebang_detect", "SELECT CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in BANGED_AS.items()) + " END AS name, CAST(count(*) AS BIGINT) AS files FROM documents WHERE doc_id % 9 IN (0, 1, 2, 4, 7, 8) GROUP BY 1")
def q21(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    line = F.element_at(F.array(*map(F.lit, SHEBANGS)), (F.col("doc_id") % 9 + 1).cast("int"))
    return analyze_content(d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.concat(line, F.lit("\n"), "text").alias("content"))).languages.select("name", "files")


# --- carrier G: one family of sources for each lexical feature ------------------------------------------

# name -> (language, file name, parts of the text, code, comment, blank); a tuple part repeats p_size times
FAMILIES: dict[str, tuple] = {
    "q22_go_counts": ("Go", "go", ["package p\n", ("var x = 1\n",), "y := `raw // no\n/* no */`\n/* c\n\n*/\n// t\n"], "p_size + 3", "3", "1"),
    "q23_c_counts": ("C", "c", ["// spliced \\\n", ("goes on \\\n",), "ends\nint x; /* c */\n\n/* d\n*/\n"], "1", "p_size + 4", "1"),
    "q24_cpp_counts": ("C++", "cpp", ['auto s = R"x(\n', ("// raw )\"\n",), ")x\"; // c\nint n = 1'000; // d\n/* e */\n"], "p_size + 3", "1", "0"),
    "q25_java_counts": ("Java", "java", ['String s = """\n', ("// text\n",), '\n""";\n/* c */\n'], "p_size + 2", "1", "1"),
    "q26_rust_counts": ("Rust", "rs", ["/* a /* b */\n", ("still\n",), "*/\nfn f<'a>() {}\nlet s = r#\"// no \" no\n\"#;\n"], "3", "p_size + 2", "0"),
    "q27_javascript_counts": ("JavaScript", "js", ["const r = /[/*]/; // c\nlet t = `a ${ f({}) }\n", ("// in text\n",), "`;\n// d\n"], "p_size + 3", "1", "0"),
    "q28_python_counts": ("Python", "py", ['"""doc\n', ("doc\n",), '"""\nx = """no\n"""\ndef f():\n    "d"\n    return 1\n# c\n'], "4", "p_size + 4", "0"),
    "q29_sql_counts": ("SQL", "sql", [("select 'it''s -- no'\n",), "-- c\n/* d\n*/\n"], "p_size", "3", "0"),
    "q30_lua_counts": ("Lua", "lua", ["--[[ a\n", ("b\n",), "]]\n-- c\nprint('--')\n"], "1", "p_size + 3", "0"),
    "q31_bash_counts": ("BASH", "bash", ["#!/bin/bash\n", 'echo "\n', ("# in\n",), '"\n# c\n'], "p_size + 3", "1", "0"),
    "q32_ruby_counts": ("Ruby", "rb", ["=begin\n", ("text\n",), "=end\n =begin\n# c\n"], "1", "p_size + 3", "0"),
    "q33_batch_counts": ("Batch", "bat", [("rem a\n",), "REM b\n:: c\nremark\n\n"], "1", "p_size + 2", "1"),
    "q34_svelte_counts": ("Svelte", "svelte", [("a /* b */ <p>\n",), "/* c\n*/\n<!-- d -->\n"], "p_size", "3", "0"),
    "q35_antlr_counts": ("ANTLR", "g4", ["x /* a /* b */\n", ("y\n",), "*/\nz\n"], "2", "p_size + 1", "0"),
    "q36_just_counts": ("Just", "just", ["x:\n#!/bin/sh\n", ("# c\n",), "#!x\nbuild:\n"], "4", "p_size", "0"),
    "q54_csharp_counts": ("C#", "cs", ['var p = @"a\n', ('""// in""\n',), '";\n// c\n'], "p_size + 2", "1", "0"),
    "q55_fsharp_counts": ("F#", "F#", ["(* a (* b *)\n", ("c\n",), "*)\nlet x = 1\n"], "1", "p_size + 2", "0"),
    "q56_kotlin_counts": ("Kotlin", "kt", ["/* a /* b */\n", ("c\n",), "*/ val x = 1\n"], "1", "p_size + 1", "0"),
    "q57_fortran_counts": ("FORTRAN Legacy", "f", [("c note\n",), "C note\n      call f ! tail\n* star\n      x = c\n"], "2", "p_size + 2", "0"),
    "q58_perl_counts": ("Perl", "pl", ["=pod\n", ("doc\n",), "=cut\nprint 1;\n"], "1", "p_size + 2", "0"),
    "q59_pony_counts": ("Pony", "pony", ['"""\n', ("doc\n",), '"""\nlet s = """\nno\n"""\n'], "3", "p_size + 2", "0"),
    "q60_starlark_counts": ("Starlark", "star", ['"""doc\n', ("doc\n",), '"""\nx = 1\n"""loose"""\n'], "2", "p_size + 2", "0"),
    "q61_xml_counts": ("XML", "xml", ["<a>\n<!--\n", ("c\n",), '-->\n<b t="<!--"/>\n'], "2", "p_size + 2", "0"),
    "q62_visual_basic_counts": ("Visual Basic", "vb", [("s = \"a 'b\"\n",), "' c\n"], "p_size", "1", "0"),
    "q63_powershell_counts": ("PowerShell", "ps1", ["<# a\n#>\n@'\n", ("# in\n",), "'@\n"], "p_size + 2", "2", "0"),
    "q64_haskell_counts": ("Haskell", "hs", ["{- a {- b -}\n", ("c\n",), "-}\n-- d\nx = 1\n"], "1", "p_size + 3", "0"),
    "q65_typescript_counts": ("TypeScript", "tsx", ["let a = b / c; // d\n", ("let t = `${`x`}`;\n",), "/* e\n*/\n"], "p_size + 1", "2", "0"),
    "q66_r_counts": ("R", "R", [("# c\n",), "x <- 1 # d\n"], "1", "p_size", "0"),
    "q67_clojure_counts": ("Clojure", "clj", [("; c\n",), '(def s "; no")\n'], "1", "p_size", "0"),
    "q68_coffeescript_counts": ("CoffeeScript", "coffee", ["###\n", ("b\n",), "###\n# c\nx = 1\n"], "1", "p_size + 3", "0"),
    "q52_bom_crlf_blank": ("Java", "java", ["﻿int a;\r\n", ("   \r\n",), "// b\r\n   　\r\n"], "1", "1", "p_size + 1"),
    "q53_empty_and_unterminated": ("Go", "go", [("a()\n",), "// no end"], "p_size", "1", "0"),
}


#: rows of ``part`` of which a task makes and counts files: few while that gives few tasks, more of large tables
PARTS, TASKS, MOST_PARTS = 5_000, 64, 50_000


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``part`` that files are made of, dealt anew: a row is some bytes and becomes a file, so
    splits by bytes are far too few tasks.  A task of few rows costs more than they do where its counts are
    shuffled, for it writes a file for each partition."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return p.repartition(tasks_of(p.count()), "p_partkey")


def tasks_of(n: int) -> int:
    return max(min(-(-n // PARTS), TASKS), -(-n // MOST_PARTS), 1)


def generated(spark: SparkSession, sf_dir: str, ext: str, parts: list) -> DataFrame:
    return made_of(part_rows(spark, sf_dir), ext, parts)


def made_of(p: DataFrame, ext: str, parts: list) -> DataFrame:
    pieces = [F.expr("repeat(:t, p_size)".replace(":t", _literal(x[0]))) if isinstance(x, tuple) else F.lit(x) for x in parts]
    path = F.concat("p_brand", F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(f".{ext}"))
    return p.select(F.col("p_partkey").alias("seq"), path.alias("path"), F.concat(*pieces).alias("content"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def _family(name: str, language: str, ext: str, parts: list, code: str, comment: str, blank: str) -> None:
    counts = f"CAST({code} AS BIGINT) AS code, CAST({comment} AS BIGINT) AS comment, CAST({blank} AS BIGINT) AS blank"

    @query(name, f"SELECT p_brand || '/f' || p_partkey || '.{ext}' AS name, '{language}' AS language, {counts} FROM part")
    def run(spark, sf_dir):
        return analyze_content(generated(spark, sf_dir, ext, parts), persist=False).files  # read once


for _name, _spec in FAMILIES.items():
    _family(_name, *_spec)

_SOME = ("q22_go_counts", "q26_rust_counts", "q28_python_counts", "q29_sql_counts", "q32_ruby_counts", "q64_haskell_counts")
MIX_SQL = " UNION ALL ".join(f"SELECT '{FAMILIES[n][0]}' AS name, CAST(count(*) AS BIGINT) AS files, CAST(sum({FAMILIES[n][3]}) AS BIGINT) AS code, CAST(sum({FAMILIES[n][4]}) AS BIGINT) AS comment, CAST(sum({FAMILIES[n][5]}) AS BIGINT) AS blank FROM part" for n in _SOME)


def many_languages(spark: SparkSession, sf_dir: str) -> Result:
    rows, p = None, part_rows(spark, sf_dir)
    for n in _SOME:
        more = made_of(p, FAMILIES[n][1], FAMILIES[n][2])
        rows = more if rows is None else rows.unionByName(more)
    return analyze_content(rows, persist=False)


@query("q37_mixed_languages", MIX_SQL)
def q37(spark, sf_dir):
    return many_languages(spark, sf_dir).languages


def _sorted(name: str, tag: str) -> None:
    order = {"name": "name", "code": "code DESC, name"}.get(tag, f"{tag} DESC, code DESC, name")

    @query(name, f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position FROM ({MIX_SQL})")
    def run(spark, sf_dir):
        place = Window.orderBy(*sort_keys(tag, False))  # one row for each language
        return many_languages(spark, sf_dir).languages.withColumn("position", F.row_number().over(place).cast("long"))


for _k, _tag in enumerate(("name", "files", "comment", "blank", "code")):
    _sorted(f"q{38 + _k}_sort_languages_{_tag}", _tag)

KINDS = "'C' || repeat('C', p_size) || 'CCMBMM'"


@query(
    "q43_line_records",
    f"""WITH k AS (SELECT p_brand || '/f' || p_partkey || '.go' AS path, {KINDS} AS kinds FROM part),
l AS (SELECT path, CAST(unnest(range(1, length(kinds) + 1)) AS INT) AS line_no, kinds FROM k),
m AS (SELECT path, line_no, kinds[line_no] AS kind, length(kinds) AS n FROM l)
SELECT path, line_no, kind, CAST(sum((kind = 'C')::INT) OVER w AS BIGINT) AS code, CAST(sum((kind = 'M')::INT) OVER w AS BIGINT) AS comment,
  CAST(sum((kind = 'B')::INT) OVER w AS BIGINT) AS blank, line_no IN (n - 3, n - 2) AS in_comment FROM m WINDOW w AS (PARTITION BY path ORDER BY line_no)""",
)
def q43(spark, sf_dir):
    spec = FAMILIES["q22_go_counts"]
    return analyze_content(generated(spark, sf_dir, spec[1], spec[2])).debug.select("path", "line_no", "kind", "code", "comment", "blank", "in_comment")


@query("q44_code_lines_only", "SELECT p_brand || '/f' || p_partkey || '.lua' AS path, 'print(''--'')' AS text FROM part")
def q44(spark, sf_dir):
    spec = FAMILIES["q30_lua_counts"]
    return analyze_content(generated(spark, sf_dir, spec[1], spec[2])).lines.where("kind = 'C'").select("path", F.col("text").cast("string").alias("text"))


def _report(spark: SparkSession, sf_dir: str, output_type: str) -> DataFrame:
    """A report's lines; at most one row for each language."""
    text = "".join(render(collect_report(many_languages(spark, sf_dir)), output_type))
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line_no long, line string")


TOTAL_SQL = f"SELECT sum(files) AS files, sum(code) AS code, sum(comment) AS comment, sum(blank) AS blank FROM ({MIX_SQL})"
RANKED = f"SELECT *, row_number() OVER (ORDER BY code DESC, name) AS r FROM ({MIX_SQL})"


@query(
    "q45_json_envelope",
    f"""SELECT CAST(1 AS BIGINT) AS line_no, '{{"languages":[' || (SELECT string_agg('{{"name":"' || name || '","files":' || files || ',"code":' || code || ',"comment":' || comment || ',"blank":' || blank || '}}', ',' ORDER BY r) FROM ({RANKED}))
|| '],"total":{{"files":' || files || ',"code":' || code || ',"comment":' || comment || ',"blank":' || blank || '}}}}' AS line FROM ({TOTAL_SQL})""",
)
def q45(spark, sf_dir):
    return _report(spark, sf_dir, "json")


@query(
    "q46_xml",
    f"""SELECT CAST(1 AS BIGINT) AS line_no, '<?xml version="1.0" encoding="UTF-8"?>' AS line UNION ALL SELECT 2, '<results>' UNION ALL SELECT 3, '  <languages>'
UNION ALL SELECT 3 + r, '    <language name="' || name || '" files_count="' || files || '" code="' || code || '" comment="' || comment || '" blank="' || blank || '"></language>' FROM ({RANKED})
UNION ALL SELECT {4 + len(_SOME)}, '    <total sum_files="' || files || '" code="' || code || '" comment="' || comment || '" blank="' || blank || '"></total>' FROM ({TOTAL_SQL})
UNION ALL SELECT {5 + len(_SOME)}, '  </languages>' UNION ALL SELECT {6 + len(_SOME)}, '</results>'""",
)
def q46(spark, sf_dir):
    return _report(spark, sf_dir, "cloc-xml")


@query(
    "q47_markdown",
    f"""SELECT CAST(1 AS BIGINT) AS line_no, '| Language             |             files    |    blank   |   comment    |    code |' AS line
UNION ALL SELECT 2, '|:' || repeat('-', 21) || '|' || repeat('-', 21) || ':|' || repeat('-', 11) || ':|' || repeat('-', 13) || ':|' || repeat('-', 8) || ':|'
UNION ALL SELECT CAST(2 + r AS BIGINT), format('| {{:<20}} |{{:>21}} |{{:>11}} |{{:>13}} |{{:>8}} |', name, files, blank, comment, code) FROM ({RANKED})
UNION ALL SELECT {3 + len(_SOME)}, '| ' || repeat(' ', 21) || '|' || repeat(' ', 22) || '|' || repeat(' ', 12) || '|' || repeat(' ', 14) || '|' || repeat(' ', 8) || ' |'
UNION ALL SELECT {4 + len(_SOME)}, format('| {{:>20}} |{{:>21}} |{{:>11}} |{{:>13}} |{{:>8}} |', 'TOTAL', CAST(files AS BIGINT), CAST(blank AS BIGINT), CAST(comment AS BIGINT), CAST(code AS BIGINT)) FROM ({TOTAL_SQL})""",
)
def q47(spark, sf_dir):
    return _report(spark, sf_dir, "markdown")


@query(
    "q48_default",
    f"""SELECT CAST(3 + r AS BIGINT) AS line_no, format('{{:<27}} {{:>6}} {{:>14}} {{:>14}} {{:>14}}', name, files, blank, comment, code) AS line FROM ({RANKED})
UNION ALL SELECT {5 + len(_SOME)}, format('{{:<27}} {{:>6}} {{:>14}} {{:>14}} {{:>14}}', 'TOTAL', CAST(files AS BIGINT), CAST(blank AS BIGINT), CAST(comment AS BIGINT), CAST(code AS BIGINT)) FROM ({TOTAL_SQL})
UNION ALL SELECT n, repeat('-', 79) FROM (VALUES (1), (3), ({4 + len(_SOME)}), ({6 + len(_SOME)})) v(n)
UNION ALL SELECT 2, 'Language                     files          blank        comment           code'""",
)
def q48(spark, sf_dir):
    return _report(spark, sf_dir, "default")


@query("q49_sloccount", f"SELECT (n - blank) || chr(9) || 'Plain Text' || chr(9) || CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END || chr(9) || CASE WHEN doc_id % 2 = 0 THEN './' ELSE '' END || path AS value FROM ({T_SQL})")
def q49(spark, sf_dir):
    rows = texts(spark, sf_dir).withColumn("path", F.concat(F.when(F.col("seq") % 2 == 0, "./").otherwise(""), "path"))
    result = analyze_content(rows, language="Plain Text")
    path = f"{work_dir(spark)}/report"
    write_report_parts(result, path, sort="name", output_type="sloccount")
    return read_report_parts(spark, path).select(F.col("line").alias("value"))


#: the rows of the rule table, read by the database itself
RULE_ROWS = f"""SELECT string_split(line, chr(9)) AS c, row_number() OVER () AS r
FROM (SELECT unnest(string_split(content, chr(10))) AS line FROM read_text('{table_path()}')) WHERE line <> '' AND line NOT LIKE '#%'"""


@query(
    "q50_language_listing",
    f"""WITH t AS ({RULE_ROWS}), k AS (SELECT c[1] AS name, unnest(string_split(c[2], ' ')) AS key, r FROM t), last AS (SELECT key, arg_max(name, r) AS name FROM k WHERE key <> '' GROUP BY key),
shown AS (SELECT DISTINCT name, CASE WHEN key IN ('Objective-C', 'MATLAB', 'Mercury') THEN 'm' WHEN key IN ('F#', 'GLSL') THEN 'fs' WHEN key = 'TypeScript' THEN 'ts' WHEN key = 'Motoko' THEN 'mo' ELSE key END AS key FROM last)
SELECT t.c[1] AS name, coalesce((SELECT string_agg(key, ', ' ORDER BY key) FROM shown WHERE shown.name = t.c[1]), '') AS extensions, coalesce(m.files, 0) AS files FROM t LEFT JOIN ({MIX_SQL}) m ON m.name = t.c[1]""",
)
def q50(spark, sf_dir):
    """The language listing beside the files that the tables hold of each language."""
    listing = spark.createDataFrame(LanguageRegistry.default().listing(), "name string, extensions array<string>")
    files = many_languages(spark, sf_dir).languages.select(F.col("name").alias("of"), "files")
    return listing.join(files, F.col("name") == F.col("of"), "left").select("name", F.concat_ws(", ", "extensions").alias("extensions"), F.coalesce("files", F.lit(0)).alias("files"))


@query(
    "q51_udtf_lines",
    f"""SELECT doc_id, CAST(i AS INT) AS line_no, CASE WHEN regexp_matches(line, '^[\\s\\x{{85}}\\p{{Z}}]*$') THEN 'B' ELSE 'C' END AS kind
FROM (SELECT doc_id, unnest({LINES}) AS line, unnest(range(1, len({LINES}) + 1)) AS i FROM documents)""",
)
def q51(spark, sf_dir):
    register(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("loomline_documents")
    return spark.sql("SELECT doc_id, line_no, kind FROM loomline_documents, LATERAL scan_lines(text, 'Plain Text')")


@query("q69_custom_language", "SELECT p_brand || '/f' || p_partkey || '.mine' AS name, 'Mine' AS language, CAST(p_size AS BIGINT) AS code, CAST(3 AS BIGINT) AS comment, CAST(0 AS BIGINT) AS blank FROM part")
def q69(spark, sf_dir):
    registry = LanguageRegistry.default().with_language(Language("Mine", ("%",), (("<<", ">>"),))).with_extension("mine", "Mine")
    return analyze_content(generated(spark, sf_dir, "mine", [("x <- 1 % no\n",), "% a\n<< b\n>>\n"]), registry=registry).files


@query("q70_language_files", f"SELECT language AS name, doc_id AS seq, source || '/f' || doc_id || '.' || CASE doc_id % 8 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'json' WHEN 3 THEN 'rst' WHEN 5 THEN 'Rmd' ELSE 'text' END AS file FROM (SELECT doc_id, source, language FROM ({M_SQL}))")
def q70(spark, sf_dir):
    return mixed(spark, sf_dir).language_files


AMBIGUOUS = (
    (".m", '#import "a.h"\n', "Objective-C"), (".m", "function y = f(x)\n", "MATLAB"), (".m", ":- module a.\n", "Mercury"), (".v", "module m (a);\n", "Verilog"), (".v", "Require Import Arith.\n", "Coq"),
    (".fs", "module A\nlet x = 1\n", "F#"), (".fs", "#version 330\nvec4 a;\n", "GLSL"), (".r", "f <- function(x) x\n", "R"), (".r", "REBOL []\n", "Rebol"), (".ts", "export const a = 1\n", "TypeScript"),
    (".ts", "<!DOCTYPE TS><TS></TS>\n", "XML"), (".mo", "actor {}\n", "Motoko"),
)


@query("q71_ambiguous_detect", f"SELECT ([{', '.join(repr(x[2]) for x in AMBIGUOUS)}])[p_partkey % {len(AMBIGUOUS)} + 1] AS name, CAST(count(*) AS BIGINT) AS files FROM part GROUP BY 1")
def q71(spark, sf_dir):
    p = part_rows(spark, sf_dir)
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in AMBIGUOUS]), (F.col("p_partkey") % len(AMBIGUOUS) + 1).cast("int"))
    rows = p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"), pick(0)).alias("path"), pick(1).alias("content"))
    return analyze_content(rows).languages.select("name", "files")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir, dedup=True).languages


@query("q72_mixed_dedup", f"SELECT language AS name, {T_COUNTS} FROM (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM ({M_SQL})) WHERE r = 1 GROUP BY language")
def q72(spark, sf_dir):
    return flagship(spark, sf_dir)



# --- files of many shapes ------------------------------------------------------------------------


def shaped(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """A file for each part: 32 pieces of the language's palette, as the digits of the key's MD5 say."""
    ext, first, pieces = PALETTES[language]
    units = F.create_map(*[F.lit(x) for k, p in enumerate(pieces) for x in (f"{k:x}", p[0])])
    picked = F.transform(F.split(F.md5(F.col("p_partkey").cast("string")), ""), lambda d: F.coalesce(F.try_element_at(units, d), F.lit("")))
    path = F.concat("p_brand", F.lit("/s"), F.col("p_partkey").cast("string"), F.lit(f".{ext}"))
    return part_rows(spark, sf_dir).select(F.col("p_partkey").alias("seq"), path.alias("path"), F.concat(F.lit(first), F.array_join(picked, "")).alias("content"))


def shape_sql(language: str, columns: str = "name, language, code, comment, blank") -> str:
    ext, _, pieces = PALETTES[language]
    digit = "(32 - length(replace(h, '{:x}', '')))"
    total = lambda k: " + ".join(f"{p[k]} * {digit.format(d)}" for d, p in enumerate(pieces) if p[k])
    return f"""SELECT {columns} FROM (SELECT p_partkey AS seq, p_brand || '/s' || p_partkey || '.{ext}' AS name, '{language}' AS language,
CAST(1 + {total(1)} AS BIGINT) AS code, CAST({total(2)} AS BIGINT) AS comment, CAST({total(3)} AS BIGINT) AS blank
FROM (SELECT *, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part))"""


def _shape(name: str, language: str) -> None:
    @query(name, shape_sql(language))
    def run(spark, sf_dir):
        return analyze_content(shaped(spark, sf_dir, language), persist=False).files  # read once


for _k, _language in enumerate(PALETTES):
    _shape(f"q{73 + _k}_{_language.lower().replace('+', 'p')}_shapes", _language)


def _file_sort(name: str, tag: str) -> None:
    order = {"name": "name", "code": "code DESC, name"}.get(tag, f"{tag} DESC, code DESC, name")

    @query(name, f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position FROM ({shape_sql('Go')})")
    def run(spark, sf_dir):
        return sort_files_with_position(analyze_content(shaped(spark, sf_dir, "Go")).files, tag)


for _k, _tag in enumerate(("name", "comment", "blank", "code")):
    _file_sort(f"q{81 + _k}_sort_files_{_tag}", _tag)


def _file_report(spark: SparkSession, sf_dir: str, output_type: str) -> DataFrame:
    """A report by file, written by tasks and read back; JSON has no lines and is split where objects end."""
    path = f"{work_dir(spark)}/report"
    write_report_parts(analyze_content(shaped(spark, sf_dir, "Go")), path, output_type=output_type)
    return read_report_parts(spark, path, "}" if output_type == "json" else "\n")


FILES = f"(SELECT *, row_number() OVER (ORDER BY code DESC, name) AS r FROM ({shape_sql('Go')}))"
FILE_SUMS = "(SELECT count(*) AS files, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank, CAST(max(length(name)) AS BIGINT) AS w FROM part_files)"
AS_FILES = f"WITH part_files AS {FILES}, t AS {FILE_SUMS}"


@query(
    "q85_default_by_file",
    f"""{AS_FILES} SELECT CAST(n AS BIGINT) AS line_no, repeat('-', 52 + w) AS line FROM t, (SELECT unnest([1, 3])) v(n)
UNION ALL SELECT 2, 'File' || repeat(' ', w - 2) || 'files          blank        comment           code' FROM t
UNION ALL SELECT 3 + r, rpad(name, CAST(w AS INT), ' ') || ' ' || lpad(part_files.blank::VARCHAR, 21, ' ') || ' ' || lpad(part_files.comment::VARCHAR, 14, ' ') || ' ' || lpad(part_files.code::VARCHAR, 14, ' ') FROM part_files, t
UNION ALL SELECT 4 + files, repeat('-', 52 + w) FROM t
UNION ALL SELECT 5 + files, rpad('TOTAL', CAST(w AS INT), ' ') || ' ' || lpad(files::VARCHAR, 6, ' ') || ' ' || lpad(blank::VARCHAR, 14, ' ') || ' ' || lpad(comment::VARCHAR, 14, ' ') || ' ' || lpad(code::VARCHAR, 14, ' ') FROM t
UNION ALL SELECT 6 + files, repeat('-', 52 + w) FROM t""",
)
def q85(spark, sf_dir):
    return _file_report(spark, sf_dir, "default")


@query(
    "q86_markdown_by_file",
    f"""{AS_FILES}, s AS (SELECT *, CAST((w + 1) // 2 - 1 AS BIGINT) AS side FROM t)
SELECT CAST(1 AS BIGINT) AS line_no, '| File' || repeat(' ', side) || '|' || repeat(' ', side) || 'files    |    blank   |   comment    |    code |' AS line FROM s
UNION ALL SELECT 2, '|:' || repeat('-', 3 + side) || CASE WHEN 5 + side > w + 1 THEN ':' ELSE '-' END || '|' || repeat('-', side + 8) || ':|-----------:|-------------:|--------:|' FROM s
UNION ALL SELECT 2 + r, '| ' || rpad(name, CAST(w AS INT), ' ') || ' |       1  |' || lpad(part_files.blank::VARCHAR, 11, ' ') || ' |' || lpad(part_files.comment::VARCHAR, 13, ' ') || ' |' || lpad(part_files.code::VARCHAR, 8, ' ') || ' |' FROM part_files, t
UNION ALL SELECT 3 + files, '| ' || repeat(' ', w) || ' |' || repeat(' ', 10) || '|' || repeat(' ', 12) || '|' || repeat(' ', 14) || '|' || repeat(' ', 8) || ' |' FROM t
UNION ALL SELECT 4 + files, '| ' || rpad('TOTAL', CAST(w AS INT), ' ') || ' |' || lpad(files::VARCHAR, 9, ' ') || ' |' || lpad(blank::VARCHAR, 11, ' ') || ' |' || lpad(comment::VARCHAR, 13, ' ') || ' |' || lpad(code::VARCHAR, 8, ' ') || ' |' FROM t""",
)
def q86(spark, sf_dir):
    return _file_report(spark, sf_dir, "markdown")


JSON_FILE = """'{"code":' || code || ',"comment":' || comment || ',"blank":' || blank || ',"name":"' || name || '","language":"' || language || '"'"""


@query(
    "q87_json_by_file",
    f"""{AS_FILES} SELECT CAST(1 AS BIGINT) AS line_no, '{{"files":[' AS line UNION ALL SELECT CAST(1 + r AS BIGINT), CASE WHEN r = 1 THEN '' ELSE ',' END || {JSON_FILE} FROM part_files
UNION ALL SELECT 2 + files, '],"total":{{"files":' || files || ',"code":' || code || ',"comment":' || comment || ',"blank":' || blank FROM t UNION ALL SELECT 3 + files, '' FROM t""",
)
def q87(spark, sf_dir):
    return _file_report(spark, sf_dir, "json")


@query(
    "q88_xml_by_file",
    f"""{AS_FILES} SELECT CAST(1 AS BIGINT) AS line_no, '<?xml version="1.0" encoding="UTF-8"?>' AS line UNION ALL SELECT 2, '<results>' UNION ALL SELECT 3, '  <files>'
UNION ALL SELECT 3 + r, '    <file code="' || code || '" comment="' || comment || '" blank="' || blank || '" name="' || name || '" language="' || language || '"></file>' FROM part_files
UNION ALL SELECT 4 + files, '    <total code="' || code || '" comment="' || comment || '" blank="' || blank || '"></total>' FROM t
UNION ALL SELECT 5 + files, '  </files>' FROM t UNION ALL SELECT 6 + files, '</results>' FROM t""",
)
def q88(spark, sf_dir):
    return _file_report(spark, sf_dir, "cloc-xml")


@query(
    "q89_sloccount_by_language",
    f"SELECT CAST(r AS BIGINT) AS line_no, format('{{:<27}} {{:>6}} {{:>14}} {{:>14}} {{:>14}}', name, files, blank, comment, code) AS line FROM ({RANKED})",
)
def q89(spark, sf_dir):
    return _report(spark, sf_dir, "sloccount")


# --- options and trees ---------------------------------------------------------------------------


@query("q90_patterns", f"SELECT path AS name FROM ({T_SQL}) WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '^[[:alpha:]]+[[:digit:]]*[02468]\\.(?P<ext>\\p{{L}}+)$') AND NOT regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)DOC1')")
def q90(spark, sf_dir):
    return plain(spark, sf_dir, match=r"^[[:alpha:]]+[[:digit:]]*[02468]\.(?P<ext>\p{L}+)$", not_match="(?i)DOC1").files.select("name")


@query("q91_legacy_defaults", f"SELECT language AS name, {T_COUNTS} FROM (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM ({M_SQL}) WHERE language IN ('JSON', 'Markdown')) WHERE r = 1 GROUP BY language")
def q91(spark, sf_dir):
    rows = mixed_rows(spark, sf_dir)
    return analyze_content(rows, Options.from_legacy(include_langs=("JSON", "Markdown", "none such"))).languages


@query("q92_lines_of_kept_files", f"SELECT language, CAST(count(*) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS r FROM ({M_SQL})) WHERE r = 1 AND n > 0 GROUP BY language")
def q92(spark, sf_dir):
    rows = mixed(spark, sf_dir, dedup=True).lines.groupBy("language", "path").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"))


def planted_tree(spark: SparkSession, sf_dir: str) -> str:
    """A tree below the folder that driver and tasks share, planted by tasks: a folder for each region, a
    file for each nation, and what a walk must tell apart.  Links that lead nowhere are planted where the
    store is a file system of this kind."""
    top = plain_path(f"{work_dir(spark)}/tree")

    def plant(batches):
        for batch in batches:
            for r in batch.to_pylist():
                folder, k = f"{top}/{r['r_name'].replace(' ', '_')}", r["n_nationkey"]
                store = store_of(folder)
                for path in (f"{folder}/{k}.go", f"{folder}/.git/{k}.go", f"{folder}/.{k}.py", f"{folder}/{k}.none"):
                    store.write(path, (f"// {r['n_name']}\n" * 2 + "x\n" * k + "\n").encode())
                if isinstance(store, LocalStore) and not os.path.lexists(f"{folder}/{k}-gone.go"):
                    os.symlink("/nonexistent", f"{folder}/{k}-gone.go")
            yield batch

    rows = nations(spark, sf_dir).select("n_nationkey", "n_name", "r_name")
    rows.mapInArrow(plant, rows.schema).write.format("noop").mode("overwrite").save()
    return top


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


TREE_FILES = "SELECT replace(r_name, ' ', '_') AS folder, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey"
TREE_ROWS = f"""SELECT folder || '/' || k || '.go' AS name, 'Go' AS language, CAST(k AS BIGINT) AS code, CAST(2 AS BIGINT) AS comment, CAST(1 AS BIGINT) AS blank FROM ({TREE_FILES})
UNION ALL SELECT folder || '/.' || k || '.py', 'Python', k + 2, 0, 1 FROM ({TREE_FILES})"""


def _below(top: str, path: str):
    return F.substring(path, len(top) + 2, 10_000)


@query("q93_tree", f"SELECT * FROM ({TREE_ROWS})")
def q93(spark, sf_dir):
    top = planted_tree(spark, sf_dir)
    return analyze(spark, [top]).files.withColumn("name", _below(top, "name"))


@query("q94_tree_order", f"SELECT name, row_number() OVER (ORDER BY replace(name, '/', chr(1))) AS position FROM ({TREE_ROWS})")
def q94(spark, sf_dir):
    top = planted_tree(spark, sf_dir)
    rows = analyze(spark, [top]).scanned
    return with_position(rows.select(_below(top, "path").alias("name"), "seq"), [F.col("seq")]).select("name", F.col("position").cast("int").alias("position"))


@query("q95_tree_warnings", f"SELECT 'warning' AS level, folder || '/' || k || '-gone.go' AS path FROM ({TREE_FILES}) UNION ALL SELECT 'warning', 'none'")
def q95(spark, sf_dir):
    top = planted_tree(spark, sf_dir)
    return analyze(spark, [top, f"{top}/none"]).diagnostics.select("level", _below(top, "path").alias("path"))


@query(
    "q96_roots",
    f"""SELECT name, CAST(count(*) AS BIGINT) AS files, CAST(sum(code) AS BIGINT) AS code FROM (SELECT 'Go' AS name, k AS code FROM ({TREE_FILES}) UNION ALL SELECT 'Python', k + 2 FROM ({TREE_FILES})
UNION ALL SELECT 'Go', k FROM ({TREE_FILES}) WHERE folder = 'ASIA' UNION ALL SELECT 'Python', k + 2 FROM ({TREE_FILES}) WHERE folder = 'ASIA' UNION ALL SELECT 'Go', k FROM ({TREE_FILES}) WHERE folder = 'EUROPE') GROUP BY name""",
)
def q96(spark, sf_dir):
    top = planted_tree(spark, sf_dir)
    return analyze(spark, [top, f"{top}/ASIA", f"{top}/EUROPE/.git"]).languages.select("name", "files", "code")


@query("q97_no_roots", "SELECT CAST(count(*) AS BIGINT) AS nations, CAST(0 AS BIGINT) AS files, CAST(0 AS BIGINT) AS code, CAST(0 AS BIGINT) AS comment, CAST(0 AS BIGINT) AS blank FROM nation")
def q97(spark, sf_dir):
    """The roots are those nations whose name is no name: there are none."""
    named = table(spark, sf_dir, "nation").select("n_name", F.length(F.trim("n_name")).alias("size"))
    roots = [r.n_name for r in named.where("size = 0").collect()]
    return analyze(spark, roots).total.withColumn("nations", F.lit(named.where("size > 0").count()))


@query("q98_pruned_folders", f"SELECT * FROM ({TREE_ROWS}) WHERE NOT regexp_matches(name, '^(ASIA|AFRICA)/')")
def q98(spark, sf_dir):
    top = planted_tree(spark, sf_dir)
    return analyze(spark, [top], Options(not_match_dir="/(ASIA|AFRICA)")).files.withColumn("name", _below(top, "name"))


@query("q99_single_files", "SELECT 'Go' AS language, CAST(n_nationkey AS BIGINT) AS code, CAST(2 AS BIGINT) AS comment, CAST(1 AS BIGINT) AS blank FROM nation")
def q99(spark, sf_dir):
    top = planted_tree(spark, sf_dir)
    path = F.concat(F.lit(f"{top}/"), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("/"), F.col("n_nationkey").cast("string"), F.lit(".go"))
    return analyze_files(spark, nations(spark, sf_dir).select(path.alias("path")), "Go").files.drop("name")


@query(
    "q100_rule_coverage",
    f"""WITH t AS ({RULE_ROWS})
SELECT c[1] AS language, c[6] AS scanner, {', '.join(f"CAST(len(list_filter(string_split(c[{i}], ' '), lambda x: x <> '')) AS BIGINT) AS {name}" for i, name in ((2, 'keys'), (7, 'line_markers'), (8, 'blocks'), (9, 'quotes'), (10, 'documentation')))}, coalesce(m.comment, 0) AS comment_lines FROM t LEFT JOIN ({MIX_SQL}) m ON m.name = t.c[1]""",
)
def q100(spark, sf_dir):
    """The coverage of the rules beside the comment lines that they find in the tables' files."""
    rules = spark.createDataFrame(rule_coverage(), "language string, scanner string, keys long, line_markers long, blocks long, quotes long, documentation long")
    found = many_languages(spark, sf_dir).languages.select("name", F.col("comment").alias("found"))
    return rules.join(found, F.col("language") == F.col("name"), "left").drop("name").withColumn("comment_lines", F.coalesce("found", F.lit(0))).drop("found")


# --- more of the dialect, blocks, trees and reports ----------------------------------------------


@query("q101_braces_in_patterns", f"SELECT source || '/doc{{' || doc_id || '}}.txt' AS name FROM ({T_SQL}) WHERE regexp_matches('doc{{' || doc_id || '}}.txt', '^doc\\{{[0-9]*[05]\\}}[.]txt$')")
def q101(spark, sf_dir):
    rows = texts(spark, sf_dir).withColumn("path", F.concat(F.split("path", "/")[0], F.lit("/doc{"), F.col("seq").cast("string"), F.lit("}.txt")))
    return analyze_content(rows, Options(match=r"(?U)^doc{\d*[05]}\.txt$"), language="Plain Text").files.select("name")


def _skipped_bytes(word):
    """Lines whose wide space loses its first byte to the sweep over a block, so that its rest is ink; and
    lines whose plain space is lost as a whole."""
    wide, plain = F.concat(F.lit("/*"), word, F.lit("*/\u3000/*"), word, F.lit("*/\n")), F.concat(F.lit("/*"), word, F.lit("*/ /*"), word, F.lit("*/\n"))
    return F.concat(wide, plain, F.lit("/*\n"), word, F.lit("\u00e9\n\u3000\n*/\u00e9x\n"))


@query("q102_bytes_after_blocks", f"SELECT {T_PATH} || '.g4' AS name, 'ANTLR' AS language, CAST(2 AS BIGINT) AS code, CAST(3 AS BIGINT) AS comment, CAST(1 AS BIGINT) AS blank FROM documents")
def q102(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt.g4"))
    return analyze_content(d.select(F.col("doc_id").alias("seq"), path.alias("path"), _skipped_bytes(F.col("source")).alias("content"))).files


@query("q103_processor", f"{TREE_ROWS} UNION ALL SELECT folder || '/' || k || '.none', 'Noted', k, 2, 1 FROM ({TREE_FILES})")
def q103(spark, sf_dir):
    top = planted_tree(spark, sf_dir)
    registry = LanguageRegistry.default().with_language(Language("Noted", ("//",))).with_extension("none", "Noted")
    return Processor(spark, registry).analyze([top]).files.withColumn("name", _below(top, "name"))


@query(
    "q104_command_line",
    f"""WITH t AS ({TREE_FILES}), s AS (SELECT 'Go' AS name, CAST(count(*) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS blank, CAST(2 * count(*) AS BIGINT) AS comment, CAST(sum(k) AS BIGINT) AS code FROM t WHERE k % 10 <> 1 AND folder <> 'ASIA')
SELECT CAST(1 AS BIGINT) AS line_no, format('{{:<27}} {{:>6}} {{:>14}} {{:>14}} {{:>14}}', name, files, blank, comment, code) AS line FROM s""",
)
def q104(spark, sf_dir):
    """The command line, whose report by language has a row for each language."""
    out, err = io.StringIO(), io.StringIO()
    argv = ["-w", "3", "-l", "Go,Python", "-e", "py,css", "--not-match", "1[.]go$", "--not-match-d=/ASIA", "-s", "name", "-o", "sloccount", "--dedup=false", planted_tree(spark, sf_dir)]
    if main(argv, out, err, spark):
        raise RuntimeError(err.getvalue())
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines(), 1)), "line_no long, line string")


@query(
    "q105_json_by_source",
    f"""WITH r AS (SELECT source, lang, count(*) AS files, sum(n - blank) AS code, sum(blank) AS blank FROM ({T_SQL}) GROUP BY source, lang)
SELECT source, '{{"languages":[' || string_agg('{{"name":"' || lang || '","files":' || files || ',"code":' || code || ',"comment":0,"blank":' || blank || '}}', ',' ORDER BY lang) || '],"total":{{"files":' || CAST(sum(files) AS BIGINT) || ',"code":' || CAST(sum(code) AS BIGINT) || ',"comment":0,"blank":' || CAST(sum(blank) AS BIGINT) || '}}}}' AS report FROM r GROUP BY source""",
)
def q105(spark, sf_dir):
    """The public JSON builder, a report for each source with a row for each language."""
    rows = texts(spark, sf_dir).withColumn("path", F.concat("path", F.lit(".txt")))
    counted = analyze_content(rows, language="Plain Text").scanned.join(rows.select(F.col("seq").alias("of"), "lang"), F.col("seq") == F.col("of"))
    by = counted.withColumn("source", F.split("path", "/")[0]).groupBy("source", F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("code", "comment", "blank")])

    def build(key, t):
        listed = sorted(t.to_pylist(), key=lambda x: x["name"])
        total = {c: sum(x[c] for x in listed) for c in ("files", "code", "comment", "blank")}
        return pa.table({"source": [key[0].as_py()], "report": [json_languages(listed, total)]})

    return by.groupBy("source").applyInArrow(build, "source string, report string")


HUGE_OF = "(SELECT seq, name, language, code, comment, blank, seq // 80 AS f FROM ({}))"


@query("q106_huge_files", " UNION ALL ".join(f"SELECT split_part(name, '/', 1) || '/' || f || '.{PALETTES[x][0]}' AS name, language, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank FROM {HUGE_OF.format(shape_sql(x, 'seq, name, language, code, comment, blank'))} GROUP BY 1, 2" for x in ("Go", "JavaScript")))
def q106(spark, sf_dir):
    """Files that are counted in chunks: those of 80 parts each, joined and planted by tasks."""
    top = plain_path(f"{work_dir(spark)}/huge")

    def plant(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store_of(top).write(f"{top}/{r['path']}", r["content"].encode())
            yield batch

    for language in ("Go", "JavaScript"):
        rows = shaped(spark, sf_dir, language)
        path = F.concat(F.split("path", "/")[0], F.lit("/"), F.floor(F.col("seq") / 80).cast("string"), F.lit(f".{PALETTES[language][0]}"))
        joined = rows.groupBy(path.alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda x: x["content"]), "").alias("content"))
        joined.mapInArrow(plant, joined.schema).write.format("noop").mode("overwrite").save()
    return analyze(spark, [top], huge=1024, chunk=1024).files.withColumn("name", _below(top, "name"))


@query(
    "q107_argument_errors",
    """SELECT n_nationkey, CASE WHEN 3 * n_nationkey NOT BETWEEN 1 AND 64 THEN 'workers' WHEN n_nationkey % 4 = 0 THEN 'sort' WHEN n_nationkey % 4 = 1 THEN 'output-type' WHEN n_nationkey % 4 = 2 THEN 'dedup' ELSE '' END AS field,
CASE WHEN 3 * n_nationkey BETWEEN 1 AND 64 AND n_nationkey % 4 = 3 THEN 'Go|' || n_name END AS languages FROM nation""",
)
def q107(spark, sf_dir):
    """Arguments made of each nation's row: the field that is refused, or the languages of the comma list."""

    def check(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                k, name = r["n_nationkey"], r["n_name"]
                argv = [["-s", name], ["-o", name], ["--dedup", "--skip-duplicated"], []][k % 4]
                try:
                    told = "", "|".join(options_of(parser().parse_args(["-w", str(3 * k), "-l", f"Go,,{name},", *argv])).include_langs)
                except OptionError as e:
                    told = e.field, None
                out.append({"n_nationkey": k, "field": told[0], "languages": told[1]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("n_nationkey", batch.schema.field("n_nationkey").type), ("field", pa.string()), ("languages", pa.string())]))

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return rows.mapInArrow(check, rows.select("n_nationkey").schema.add("field", "string").add("languages", "string"))


@query("q108_rule_tables", "SELECT n_nationkey, n_nationkey % 5 <> 4 AS refused FROM nation")
def q108(spark, sf_dir):
    """The rule table with one row changed for each nation: a column too much, a scanner that is none, a
    name that stands twice, an opener with two meanings; or nothing changed."""

    def check(batches):
        with open(table_path(), encoding="utf-8") as f:
            whole = [line.split("\t") for line in f.read().splitlines() if not line.startswith("#")]
        scanned = [k for k, row in enumerate(whole) if row[5] == "rules" and row[8]]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows, k = [list(row) for row in whole], r["n_nationkey"]
                row = rows[scanned[k % len(scanned)]]
                if k % 5 == 0:
                    row.append(r["n_name"])
                elif k % 5 == 1:
                    row[5] = r["n_name"]
                elif k % 5 == 2:
                    row[0] = rows[scanned[(k + 1) % len(scanned)]][0]
                elif k % 5 == 3:
                    row[6] = row[8].split("…")[0]
                try:
                    languages_of(read_rows("\n".join("\t".join(x) for x in rows)))
                    refused = False
                except RuleTableError:
                    refused = True
                out.append({"n_nationkey": k, "refused": refused})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("n_nationkey", batch.schema.field("n_nationkey").type), ("refused", pa.bool_())]))

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return rows.mapInArrow(check, rows.select("n_nationkey").schema.add("refused", "boolean"))


@query(
    "q109_dedup_without_places",
    f"SELECT path, CASE WHEN r = 1 THEN 'kept' ELSE 'duplicate content' END AS message FROM (SELECT path, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY CASE WHEN doc_id % 3 > 0 THEN doc_id // 10 END NULLS LAST, path) AS r FROM ({T_SQL}))",
)
def q109(spark, sf_dir):
    """Copies whose places are missing or shared: one of each content stays, all others are reported."""
    rows = texts(spark, sf_dir).withColumn("seq", F.when(F.col("seq") % 3 > 0, F.floor(F.col("seq") / 10)))
    result = analyze_content(rows, Options(dedup=True), language="Plain Text")
    return result.scanned.select("path", F.lit("kept").alias("message")).unionByName(result.diagnostics.select("path", "message"))
