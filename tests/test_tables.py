import glob
import gzip
import uuid

import pytest
from py4j.protocol import Py4JJavaError

from lettermark.session import shared_folder
from lettermark.sources.tables import SCHEMAS, read_table, write_table

ROWS = [(1, None, "a"), (2, "", "a"), (3, 'say "x", \\N or\nmore', None), (None, "é", "b"), (5, "NA", "b"), (5, "NA", "b")]
SCHEMA = "id BIGINT, name STRING, venue STRING"


def key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("format", ["csv", "parquet"])
@pytest.mark.parametrize("parts", [(), ("venue",)])
def test_round_trip(spark, folder, format, parts):
    df = spark.createDataFrame(ROWS, SCHEMA)
    write_table(df, folder, parts, ("id",), format)
    back = read_table(spark, folder, SCHEMA, format)
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect()), key=key) == sorted(ROWS, key=key)


def test_overwrites_and_keeps_order(spark, folder):
    write_table(spark.createDataFrame(ROWS, SCHEMA), folder)
    write_table(spark.range(5000).selectExpr("id * 37 % 5000 AS id", "'x' AS name", "'v' AS venue"), folder, ("venue",), ("id",), rows_per_file=300)
    files = sorted(glob.glob(f"{folder}/venue=v/*.csv.gz"))
    assert len(files) > 10
    ids = []
    for f in files:
        with gzip.open(f, "rt") as lines:
            ids += [int(line.split(",")[0]) for line in list(lines)[1:]]
    assert ids == list(range(5000))


def test_rows_that_do_not_fit_stop_the_job(spark, folder):
    write_table(spark.createDataFrame([("x", "y")], "paper_id STRING, paper_reference_id STRING"), folder)
    with pytest.raises(Py4JJavaError, match="MALFORMED_RECORD"):
        read_table(spark, folder, "paper_references").collect()


def test_empty_table(spark, folder):
    write_table(spark.createDataFrame([], SCHEMAS["letter_links"]), folder, order_by=("original_doi",))
    assert read_table(spark, folder, "letter_links").collect() == []
