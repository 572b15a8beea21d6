"""What the token files hold beside the tokens: stripes, row indexes, Bloom filters, and what they spare."""

import glob

import pytest
from py4j.java_gateway import get_field

from loomline.llm import token_files
from loomline.llm.shared import shared_dir

from .test_operators import PATH


FAR = 10**10  # the gateway hands on numbers of this size as long ones


@pytest.fixture(scope="module")
def written(spark):
    path = f"{shared_dir(spark)}/tokens"
    rows = [(FAR + 3 * k, f"word{k} " * (k % 7)) for k in range(60_000)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, PATH)
    return path


def reader(spark, file):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc.OrcFile
    return jvm, orc.createReader(jvm.org.apache.hadoop.fs.Path(file), orc.readerOptions(conf))


def rows_read(spark, file, doc_id):
    """Rows that ORC hands on for an id: those of the groups that its indexes could not leave out."""
    jvm, r = reader(spark, file)
    sarg = jvm.org.apache.hadoop.hive.ql.io.sarg.SearchArgumentFactory.newBuilder()
    kind = getattr(jvm.org.apache.hadoop.hive.ql.io.sarg, "PredicateLeaf$Type").LONG
    names = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 2)
    names[1] = "doc_id"
    rows = r.rows(r.options().searchArgument(sarg.equals("doc_id", kind, doc_id).build(), names))
    batch, n = r.getSchema().createRowBatch(), 0
    while rows.nextBatch(batch):
        n += get_field(batch, "size")
    rows.close()
    return n


def test_stripes_and_indexes(spark, written):
    files = glob.glob(f"{written.removeprefix('file://')}/*.orc")
    assert files
    total = 0
    for f in files:
        _, r = reader(spark, f)
        assert r.getRowIndexStride() == int(token_files.ORC_OPTIONS["orc.row.index.stride"])
        assert r.getStripes().size() >= 1
        total += r.getNumberOfRows()
        # ids of a file are a range of their own and sorted, so a group of rows is a range too
        statistics = r.getStatistics()[1]
        assert statistics.getNumberOfValues() == r.getNumberOfRows()
    assert total == 60_000


def test_an_id_costs_one_group_of_rows_and_an_absent_one_none(spark, written):
    files = glob.glob(f"{written.removeprefix('file://')}/*.orc")
    stride = int(token_files.ORC_OPTIONS["orc.row.index.stride"])
    there = [rows_read(spark, f, FAR + 3 * 1234) for f in files]
    assert 0 < sum(there) <= 2 * stride
    # within the range of ids but not among them: statistics keep a group, the Bloom filter drops it
    absent = sum(rows_read(spark, f, FAR + 3 * k + 1) for f in files for k in range(2000, 2040))
    assert absent <= 4 * stride
    assert token_files.read_token_files(spark, written).where(f"doc_id = {FAR + 3702}").count() == 1


def test_filters_reach_the_stripes(spark, written):
    plan = spark.read.schema(token_files.SCHEMA).orc(written).where(f"doc_id = {FAR + 3702}")._jdf.queryExecution().toString()
    assert f"PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,{FAR + 3702})]" in plan
