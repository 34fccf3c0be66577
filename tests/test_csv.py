"""CSV files read by ranges, and the manifest of large files."""

import csv
import hashlib
import random
import resource

import pytest

from axonspark.sources import bulk, catalog, csv_split


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    texts = ["plain", "a\nb", '"q"', "x,y", '\n\n"\n', '5" disk', "", "long\n" * 12, "é\r\nz", ',"\n",', "\n" * 90]
    return [(k, r.choice(texts), round(r.random(), 6), r.choice(["true", "false"]), f"2024-01-{r.randint(10, 28)}") for k in range(120)]


@pytest.fixture(scope="module")
def path(rows, tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "quoted.csv"
    with open(p, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["id", "a\ntext", "v", "ok", "day"])
        w.writerows(rows)
        f.write('400,5" disk,0.5,true,2024-01-10\r\n')  # a quote that isn't at the start of a field is text
    return str(p)


@pytest.fixture
def ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    yield lambda size: spark.conf.set(key, size)
    spark.conf.unset(key)


@pytest.mark.parametrize("size", ["128m", "300", "97"])
def test_quoted_breaks_in_any_split(spark, path, rows, ranges, size):
    ranges(size)
    assert (csv_split.lines(spark, [path]).rdd.getNumPartitions() >= 16) == (size != "128m")
    df = bulk.read(spark, path)
    assert df.dtypes == [("id", "bigint"), ("a\ntext", "string"), ("v", "double"), ("ok", "boolean"), ("day", "date")]
    got = sorted((i, t or "", v, str(ok).lower(), str(d)) for i, t, v, ok, d in df.collect())
    assert got == sorted([*rows, (400, '5" disk', 0.5, "true", "2024-01-10")])


def test_given_schema_and_import(spark, path, rows, ranges):
    ranges("500")
    df = bulk.read(spark, path, "id int, t string, v float, ok string, day string")
    assert df.dtypes == [("id", "int"), ("t", "string"), ("v", "float"), ("ok", "string"), ("day", "string")] and df.count() == 121
    assert bulk.load(spark, path, "quoted_breaks", replace=True) == ("quoted_breaks", 121)
    assert spark.sql("SELECT count(*) FROM quoted_breaks WHERE `a\ntext` LIKE 'a%b'").first()[0] == sum(t == "a\nb" for _, t, *_ in rows)


def test_without_breaks_sparks_reader_is_left_alone(spark, tmp_path, ranges):
    p = tmp_path / "plain.csv"
    p.write_text('a,b\n1,"x, ""y"""\n2,5" disk\n', encoding="utf-8")
    ranges("4")
    assert not csv_split.spans_lines(spark, [str(p)])
    assert [tuple(r) for r in bulk.read(spark, str(p)).orderBy("a").collect()] == [(1, 'x, "y"'), (2, '5" disk')]


def test_awkward_files(spark, tmp_path, ranges):
    ranges("5")
    empty, only, open_ = (tmp_path / f"{n}.csv" for n in "abc")
    empty.write_text("", encoding="utf-8")
    only.write_text('﻿x,"y\nz"', encoding="utf-8")
    open_.write_text('x\n"never closed\n1\n', encoding="utf-8")
    assert csv_split.header(spark, str(empty)) == [] and csv_split.header(spark, str(only)) == ["x", "y\nz"]
    assert bulk.read(spark, str(only)).count() == 0 and bulk.read(spark, str(only)).columns == ["x", "y\nz"]
    assert [r[0].startswith("never closed\n1") for r in bulk.read(spark, str(open_)).collect()] == [True]


def test_line_states():
    inside = csv_split.ends_inside
    assert inside('a,"b', False) and not inside('a,"b"', False) and not inside('a"b', False) and inside('"a""', False) and not inside('"a"""', False)
    assert inside("x", True) and not inside('x"', True) and inside('x",y,"z', True) and inside('x"",', True) and inside('x;"', False, ";") and not inside('x,"', False, ";")


def test_catalog_splits_large_files(spark, path, rows, ranges, tmp_path):
    root = tmp_path / "data"
    for name in ("d/c/one.csv", "d/c/two.csv"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        with open(root / name, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(["id", "t"])
            w.writerows([(i, t) for i, t, *_ in rows[:60] if "\r" not in t])
    catalog.write_manifest(spark, str(root))
    whole = catalog.Catalog(spark, str(root))
    assert [t.rows for t in whole.entries] == [sum("\r" not in t for _, t, *_ in rows[:60])] * 2
    key = lambda df: [(r["_file"], r["id"], r["t"]) for r in df.orderBy("_file", "_ordinal").collect()]
    want = key(whole.open(*whole.entries))
    ranges("400")
    assert key(whole.open(*whole.entries)) == want and len(want) > 90
    assert [r["id"] for r in catalog.open_csv(spark, str(root / "d/c/one.csv")).orderBy("_ordinal").collect()] == [i for _, i, _ in want[: len(want) // 2]]


def test_manifest_streams(spark, tmp_path):
    root = tmp_path / "big"
    (root / "d" / "c").mkdir(parents=True)
    line = b'%d,"some ""text"", with\nbreaks",' + b"x" * 400 + b"\n"
    sha, n = hashlib.sha256(), 150_000
    with open(root / "d/c/large.csv", "wb") as f:
        for part in (b"\xef\xbb\xbfid,t,pad\r\n", *(line % k for k in range(n)), b"\r\n", b"9,last,z"):
            f.write(part)
            sha.update(part)
    (root / "d/c/none.csv").write_bytes(b"a,\"b c\"")
    got = {r["relative_path"]: r for r in catalog.build_manifest(spark, str(root)).collect()}
    one, none = got["d/c/large.csv"], got["d/c/none.csv"]
    assert (one["rows"], one["columns"], one["sha256"], one["collection"]) == (n + 1, "id|t|pad", sha.hexdigest(), "c")
    assert (none["rows"], none["columns"]) == (0, "a|b c")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    import pyarrow as pa

    list(catalog._described(iter([pa.RecordBatch.from_pydict({"uri": [f"file://{root}/d/c/large.csv"]})])))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40_000  # KB, of 63 MB


@pytest.mark.parametrize("sep", [",", "\t", "^", "é"])
def test_lines_of_a_batch_have_the_states_of_single_ones(sep):
    import pyarrow as pa

    r = random.Random(2)
    texts = ["".join(r.choice(['"', '"', sep, "x", "\r", "é"]) for _ in range(r.randint(0, 12))) for _ in range(20_000)]
    zero, one = csv_split._leads(pa.array(texts), sep)
    assert zero.tolist() == [csv_split.ends_inside(x, False, sep) for x in texts] and one.tolist() == [csv_split.ends_inside(x, True, sep) for x in texts]
    for state in (False, True):
        got, want = csv_split._after(zero, one, state).tolist(), []
        for x in texts:
            want.append(csv_split.ends_inside(x, want[-1] if want else state, sep))
        assert got == want


def test_late_values_decide_types_and_states_are_found_once(spark, tmp_path, ranges):
    p = tmp_path / "late.csv"
    n = 1500
    with open(p, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["number", "a\nb", "late", "day", "none"])
        w.writerows([(k, "x\ny", k if k < n - 1 else "text", "" if k < n - 9 else "2024-01-10", "") for k in range(n)])
    ranges("3000")
    df = bulk.read(spark, str(p))
    assert df.dtypes == [("number", "bigint"), ("a\nb", "string"), ("late", "string"), ("day", "date"), ("none", "string")]
    got = sorted((r["number"], r["a\nb"], r["late"], str(r["day"])) for r in df.collect())
    assert got == [(k, "x\ny", str(k) if k < n - 1 else "text", "None" if k < n - 9 else "2024-01-10") for k in range(n)]
    # one scan for records and one for those that cross ranges
    assert df._jdf.queryExecution().optimizedPlan().toString().count("] text\n") == 2
