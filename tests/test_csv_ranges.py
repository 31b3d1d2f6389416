"""CSV files that are read in stretches have the rows that one task finds in the whole file."""

import random

import pytest
from pyspark.sql import functions as F

from opinionloom.sources import csv_ranges, readers

FILES = [
    b'a,b\n1,"x\ny"\n2,"p""q\n\n"\n\n3,z\n',
    b'a,b\r\n1,"x\r\ny"\r\n\r\n2,c\r\n',
    b'a,b\n1,x"y\n2,"q"r\n3,"q"r,"s\n4"\n',
    b'a,b\n1,"open\nmore\n',
    b'a,b\n1,"open\nmore',
    b"a,b\n",
    b"a,b",
    b'a,b\n "x",y\n"x" ,"y" \n"a" b,c\n',
    b'a,b\n1\n1,2,3\n,\n"",""\n',
    b"\xef\xbb\xbfa,b\n1,2\n",
    b"a,b\n\r\n1,2\n",
    b"\n\na,b\n1,2\n",
    b'a,b\n"x""\ny",2\n"x"" z\n",3\n',
    b'a,b\n"x" y"\nz",2\n',
]


def same(spark, path, expected=None):
    want = [tuple(r) for r in spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path).collect()]
    got = sorted(tuple(r) for r in csv_ranges.read_csv_parallel(spark, path, number="_n").collect())
    assert [r[0] for r in got] == list(range(len(want)))
    assert [r[1:] for r in got] == want


@pytest.mark.parametrize("data", FILES)
def test_awkward_files(spark, tmp_path, monkeypatch, data):
    monkeypatch.setattr(csv_ranges, "BYTES", 5)
    (tmp_path / "x.csv").write_bytes(data)
    same(spark, str(tmp_path / "x.csv"))


@pytest.mark.parametrize("seed", range(8))
def test_random_files(spark, tmp_path, monkeypatch, seed):
    """Quotes, commas and line ends at random: most files are broken somewhere."""
    own = random.Random(seed)
    monkeypatch.setattr(csv_ranges, "BYTES", own.choice([7, 40, 200]))
    letters = own.choice(['ab,"\n', 'ab,"\n "', 'a,"\n\n""', 'xy, "\n'])
    (tmp_path / "x.csv").write_text("h1,h2,h3\n" + "".join(own.choice(letters) for _ in range(own.randint(50, 900))))
    same(spark, str(tmp_path / "x.csv"))


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    own, name = random.Random(3), "spark.sql.files.maxPartitionBytes"
    fields = lambda: ['"%s"' % "".join(own.choice('ab\n ,') for _ in range(40)), "plain", '"q""\n"']
    path = tmp_path / "x.csv"
    path.write_text("h1,h2,h3\n" + "\n".join(",".join(fields()) for _ in range(3000)) + "\n")
    old = spark.conf.get(name)
    try:
        spark.conf.set(name, 20_000)
        assert csv_ranges._lines(spark, str(path)).rdd.getNumPartitions() > 8
        found = csv_ranges.read_csv_parallel(spark, str(path), number="_n").orderBy("_n").toPandas()
    finally:
        spark.conf.set(name, old)
    want = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(path)).toPandas()
    assert found["_n"].tolist() == list(range(3000)) and found.drop(columns="_n").equals(want)


def test_several_files_and_loaders(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i, data in enumerate([b'm,r\na,"1\n2"\nb,NA\n', b"m,r\n", b'm,r\r\nc,"3\r\n4"\r\n', b'm,r\n,"open\n']):
        (folder / f"part-{i}.csv").write_bytes(data)
    path = str(folder)
    rows = sorted(map(tuple, readers.load_reviews(spark, path, parallel=True).collect()))
    assert rows == [(0, "a", "1\n2"), (1, "b", None), (2, "c", "3\n4"), (3, None, "open\n")]
    uploaded = readers.load_uploaded(spark, path, "r", parallel=True).orderBy(readers.UPLOAD_ID).collect()
    assert [tuple(r) for r in uploaded] == [(0, "1\n2", "a", "1\n2"), (1, None, "b", "NA"), (2, "3\n4", "c", "3\n4"), (3, "open\n", None, "open\n")]
    same_rows = readers.load_reviews(spark, path).withColumn("review_id", F.col("review_id"))
    assert sorted(map(tuple, same_rows.collect())) == rows


def test_states_of_lines():
    import numpy as np

    own = np.random.default_rng(1)
    for _ in range(200):
        closed, open_ = own.integers(0, 2, (2, int(own.integers(0, 12)))).astype(bool)
        for before in (False, True):
            want = [before]
            for a, b in zip(closed, open_):
                want.append(bool(b if want[-1] else a))
            assert csv_ranges._states(before, closed, open_).tolist() == want
