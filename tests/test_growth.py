"""Work that grows with the tables is dealt to tasks, and what a task holds does not grow."""

import tracemalloc

import pyarrow as pa

from loomline import queries
from loomline.functions.languages import LanguageRegistry
from loomline.functions.classify import kinds
from loomline.functions.plainscan import PlainScanner, plain_counts
from loomline.operators.output import collect_report
from loomline.plans.engine import analyze_content, pieces
from loomline.sources import listing

SMALL = "/root/testdata/sf0.001"


def test_files_of_parts_are_dealt_before_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(queries, "PARTS", 50, raising=False)
    n = spark.read.parquet(f"{SMALL}/part.parquet").count()
    family = queries.FAMILIES["q34_svelte_counts"]
    for rows in (queries.generated(spark, SMALL, family[1], family[2]), queries.shaped(spark, SMALL, "Python")):
        assert rows.rdd.getNumPartitions() == -(-n // 50) > 1
        plan = analyze_content(rows, persist=False).scanned._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("RepartitionByExpression") :].split("Relation [")[0]
        assert "concat" not in below and "isnotnull" not in below  # nothing is made, or checked, before rows are dealt


def test_lines_that_stand_again_are_scanned_once(monkeypatch):
    seen, scan = [], PlainScanner.is_code
    monkeypatch.setattr(PlainScanner, "is_code", lambda self, line: (seen.append(line), scan(self, line))[1])
    svelte = LanguageRegistry.default().languages["Svelte"]
    assert plain_counts(b"a /* b */ <p>\n" * 500 + b"/* c\n*/\n" * 2 + b"<!-- d -->\n" * 500, svelte) == (500, 504, 0)
    assert len(seen) == 6


def test_lines_that_open_a_file_count_as_before():
    svelte = LanguageRegistry.default().languages["Svelte"]
    for lines in (["#! /* a */", "x", "#! /* a */"], ["﻿/* a */", "﻿/* a */", "#!", "﻿/* a */"], ["/*", "/* a */", "*/", "/* a */", "*/ /* a */"], ["a /*", "a /*", "*/", "*/"]):
        content = "".join(f"{x}\n" for x in lines * 3).encode()
        k = kinds(content, svelte)
        assert plain_counts(content, svelte) == (k.count("C"), k.count("M"), k.count("B"))


def test_contents_are_turned_to_objects_a_piece_at_a_time():
    sizes = [400, 0, None, 700, 3000, 1, 1, 999]
    batch = pa.RecordBatch.from_pylist([{"seq": k, "content": None if n is None else b"x" * n} for k, n in enumerate(sizes)], schema=pa.schema([("seq", pa.int64()), ("content", pa.binary())]))
    got = list(pieces(batch, 1000))
    assert [x.column("seq").to_pylist() for x in got] == [[0, 1, 2], [3], [4], [5, 6], [7]]
    assert [x.num_rows for x in pieces(batch.slice(0, 0), 1000)] == [0]


def test_large_folders_are_held_as_columns(monkeypatch):
    class Many:
        def entries(self, path):
            return ((f"file{k}.go", "file", k) for k in range(100_000))

        def join(self, path, name):
            return f"{path}/{name}"

    monkeypatch.setattr(listing, "store_of", lambda path: Many())
    tracemalloc.start()
    parts, folders = listing.listed_parts(0, "top", True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x.num_rows for x in parts) == 100_000 and folders == [] and sum(x.nbytes for x in parts) + peak < 20_000_000
    assert [tuple(x.values())[:4] for x in parts[1].to_pylist()] == listing.list_folder(0, "top", True)[0][10_000:20_000]


def test_folders_that_break_off_are_warnings(monkeypatch):
    class Broken:
        def entries(self, path):
            yield from (("a.go", "file", 1), ("b", "folder", 0))
            raise OSError("gone")

        def join(self, path, name):
            return f"{path}/{name}"

    monkeypatch.setattr(listing, "store_of", lambda path: Broken())
    parts, folders = listing.listed_parts(3, "top", True, 1)
    assert [x.to_pylist() for x in parts] == [[{"root_idx": 3, "path": "top", "warning": "gone", "size": 0, "skip_vcs": None}]] and folders == []


def test_large_tables_are_dealt_to_larger_tasks():
    assert [queries.tasks_of(n) for n in (0, 1, 5_000, 5_001, 20_000, 320_000)] == [1, 1, 1, 2, 4, 64]
    assert [queries.tasks_of(n) for n in (1_200_000, 3_200_000, 3_200_001, 7_200_000, 72_000_000)] == [64, 64, 65, 144, 1_440]


def test_counts_that_are_read_once_are_not_kept(spark):
    for name in ("q79_html_shapes", "q34_svelte_counts"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "InMemoryTableScan" not in plan


def test_reports_by_language_count_files_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("id AS seq", "'f' || id || if(id % 2 = 0, '.go', '.sql') AS path", "'x\n\n' AS content")
    result = analyze_content(rows.mapInArrow(seen, rows.schema), persist=False)
    report = collect_report(result)
    assert read.value == 50
    assert [(x["name"], x["files"], x["code"], x["blank"]) for x in report.rows] == [("Go", 25, 25, 25), ("SQL", 25, 25, 25)]
    assert report.total == result.total.first().asDict()
    assert collect_report(analyze_content(rows.limit(0), persist=False)).total == {"files": 0, "code": 0, "comment": 0, "blank": 0}
