"""Language detection as column expressions: names, shebang, ambiguous extensions, extension map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import JAVA_SPACES

# Base names and the keys they stand for
EXACT_NAMES = {"meson.build": "meson", "meson_options.txt": "meson", "CMakeLists.txt": "cmake", "configure.ac": "m4", "Makefile.am": "makefile", "build.xml": "Ant", "pom.xml": "maven"}
LOWER_NAMES = {"justfile": "just", "makefile": "makefile", "nukefile": "nu", "dune": "dune", "dockerfile": "Dockerfile", "rebar": ""}
# Interpreters whose key differs from their name
INTERPRETERS = {"gosh": "scm", "make": "make", "perl": "pl", "rc": "plan9sh", "python": "py", "ruby": "rb", "escript": "erl"}
# Extensions that several languages share
AMBIGUOUS = ("m", "v", "fs", "r", "ts", "mo")
# Fixed patterns of a first line that names an interpreter
SHEBANG_ENV = r"^#! *(\S+/env) ([a-zA-Z]+)"
SHEBANG_PATH = r"^#! *[.a-zA-Z/]+/([a-zA-Z]+)"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def directory(path: Column) -> Column:
    """The directory of a path: '.' without a slash, '/' for the root."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(~path.contains("/"), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def extension(base: Column) -> Column:
    return F.regexp_extract(base, r"\.([^.]*)$", 1)


def ambiguous(ext: Column, text: Column) -> Column:
    """The key for the extensions that several languages share, by tests on the content."""
    has = lambda p: text.rlike(p)
    none = F.lit("")
    objective = r"(?m)^\s*(@(interface|class|protocol|property|end|implementation|selector)\b|#import\b)"
    return (
        F.when(ext == "m", F.when(has(objective), "Objective-C").when(has(r":- module"), "Mercury").when(has(r"(?m)^\s*(%|function\b)"), "MATLAB").otherwise("Objective-C"))
        .when(ext == "v", F.when(has(r"((^|\s)(Proof|Qed)\.|Require\s+(Import|Export))"), "Coq").when(has(r"(?m)^\s*module\s+\S+\s*#?\(|always\s*@|^\s*`(define|include|timescale|ifdef)"), "Verilog").when(has(r"(?m)^\s*fn\s+\S+\("), none).otherwise("Verilog"))
        .when(ext == "fs", F.when(has(r"(?m)^(: |new-device)"), none).when(has(r"(?m)^\s*(#light|import|let|module|namespace|open|type)\b"), "F#").when(has(r"(?m)^\s*(#version|precision|uniform|varying|vec[234])"), "GLSL").otherwise("F#"))
        .when(ext == "r", F.when(has(r"(?i)\brebol\b"), "Rebol").otherwise("R"))
        .when(ext == "ts", F.when(has(r"<TS\b"), "XML").otherwise("TypeScript"))
        .when(ext == "mo", F.lit("Motoko"))
    )


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a small fixed table, null where there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def with_key(files: DataFrame) -> DataFrame:
    """Adds ``key``: the key of each file, '' for none, from its path and content.

    An interpreter decides even if its key is unknown.  Steps are columns of their own, so that no
    expression is written out twice.
    """
    text = F.col("content").cast("string")
    first_line = F.when(text.startswith("#!") | text.rlike(rf"\A{JAVA_SPACES}+#!"), F.when(text.contains("\n"), F.substring_index(text, "\n", 1)))
    df = files.withColumn("__base", base_name(F.col("path")))
    df = df.withColumns({"__ext": extension(F.col("__base")), "__line": F.regexp_replace(first_line, f"^{JAVA_SPACES}+", "")})
    line = F.col("__line")
    df = df.withColumn("__named", F.when(line.rlike(SHEBANG_ENV), F.regexp_extract(line, SHEBANG_ENV, 2)).when(line.rlike(SHEBANG_PATH), F.regexp_extract(line, SHEBANG_PATH, 1)))
    ext, interpreter = F.col("__ext"), F.coalesce(_lookup(INTERPRETERS, F.col("__named")), F.col("__named"))
    named = F.coalesce(_lookup(EXACT_NAMES, F.col("__base")), _lookup(LOWER_NAMES, F.lower("__base")), interpreter, ext)
    df = df.withColumn("key", F.when(ext.isin(*AMBIGUOUS), ambiguous(ext, text)).otherwise(named))
    return df.drop("__base", "__ext", "__line", "__named")


def with_language(files: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Inner join with the extension map, which has one row for each key of the registry.

    The key is never null: else the optimizer would have the join's sides checked for nulls as early as
    can be, and contents that are made by expressions be made for that alone, before they are dealt.
    """
    spark = files.sparkSession
    table = spark.createDataFrame(sorted(keys.items()), "key string, language string")
    keyed = with_key(files).withColumn("key", F.coalesce("key", F.lit("")))
    return keyed.join(F.broadcast(table), "key").drop("key")
