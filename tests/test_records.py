"""CSV records over lines: files cut into many splits give what one reader of the whole file gives."""

import random

import pytest

from ledger_spark.sources import files


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    conf = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
    old = {k: spark.conf.get(k, None) for k in conf}
    spark.conf.set(conf[0], 100)
    spark.conf.set(conf[1], 1)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cell(rng):
    inner = "".join(rng.choice(["a", "b", " ", ",", "\n", '""', "é", "\r\n", "\n\n"]) for _ in range(rng.randrange(12)))
    return rng.choice(["x", "", "7.5", f'"{inner}"', f'"{inner}"', 'size 5" pipe', '"q"', '""', '""""'])


def csv_text(rng, rows, end="\n"):
    lines = ["one,two,three"]
    for i in range(rows):
        lines.append(",".join([f"r{i}", cell(rng), cell(rng)]))
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + (end if rng.random() < 0.5 else "")


@pytest.mark.parametrize("seed", [0, 2])
def test_records_equal_the_whole_file_reader(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    for name in "abc":
        (tmp_path / f"{name}.csv").write_bytes(csv_text(rng, 45, "\r\n" if name == "c" and seed == 2 else "\n").encode())
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    got = files._read_csv(spark, str(tmp_path), multi_line=True)
    assert files.csv_records(spark, str(tmp_path)).select(files._BLOCK).distinct().count() >= 8
    assert got.columns == whole.columns and rows_of(got) == rows_of(whole)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "multiLine=true" not in plan.replace(" ", "")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_split_is_put_in_order_by_pieces(spark, tmp_path, monkeypatch, end):
    monkeypatch.setattr(files, "PIECE_LINES", 7)
    monkeypatch.setattr(files, "TASK_BYTES", 500)
    for seed in (3, 4):
        (tmp_path / f"{seed}.csv").write_bytes(csv_text(random.Random(seed), 150, end).encode())
    marked = files._marked_lines(spark, str(tmp_path), [], False)
    assert marked.select(files._FILE, files._BLOCK).distinct().count() == 2
    assert marked.groupBy(files._FILE, files._BLOCK, "_piece").count().agg({"count": "max"}).first()[0] <= 7
    assert marked.rdd.getNumPartitions() >= 8
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert rows_of(files._read_csv(spark, str(tmp_path), multi_line=True)) == rows_of(whole)
    numbers = files.scan_csv_na(spark, str(tmp_path), multi_line=True)
    first = [r.one for r in numbers.where("_row_number <= 40").orderBy("_row_number").collect()]
    assert sorted(first) == sorted([f"r{i}" for i in range(40)] * 2) and numbers.count() == 300


def test_row_numbers_over_splits(spark, tmp_path, small_splits):
    lines = ["k,note,none"]
    for i in range(200):
        note = f'"line {i}\n, ""{i}"" end"' if i % 3 else "N/A"
        lines += [f"k{i},{note},NULL"] + ([",,"] if i % 10 == 0 else [])
    (tmp_path / "f.csv").write_text("\n".join(lines))
    got = files.scan_csv_na(spark, str(tmp_path), multi_line=True)
    assert got.columns == ["k", "note", "_row_number"]
    assert rows_of(got) == sorted(((f"k{i}", f'line {i}\n, "{i}" end' if i % 3 else None, i + 1) for i in range(200)), key=repr)
    for name in ("s1", "s2"):
        (tmp_path / "book" / f"sheet={name}").mkdir(parents=True)
        (tmp_path / "book" / f"sheet={name}" / "x.csv").write_text("\n".join(lines[:40]))
    sheets = files.scan_sheets(spark, str(tmp_path / "book"), multi_line=True)
    plain = [x for x in lines[1:40]]
    want = [i + 2 for i, x in enumerate(plain) if x != ",,"]
    for name in ("s1", "s2"):
        assert sorted(r._row_index for r in sheets.where(f"_sheet_name = '{name}'").collect()) == want


def test_files_that_are_not_utf8(spark, tmp_path, small_splits):
    rows = [f'{i},"café {i}\nübung",plain' for i in range(60)]
    (tmp_path / "latin.csv").write_bytes(("id,größe,c\n" + "\n".join(rows)).encode("latin-1"))
    (tmp_path / "wide.csv").write_bytes(("id,größe,c\n" + "\n".join(r + " 日本" for r in rows)).encode())
    got = files.scan_csv(spark, str(tmp_path), multi_line=True, fallback=True)
    assert got.columns == ["id", "größe", "c", "_source_sheet"]
    assert rows_of(got) == sorted([(str(i), f"café {i}\nübung", c, "CSV") for i in range(60) for c in ("plain", "plain 日本")], key=repr)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("id,b\n")
    assert files.scan_csv(spark, str(tmp_path / "empty"), multi_line=True).count() == 0


def test_one_open_quote_takes_the_rest_of_its_file(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text("k,v\n1,a\n2,\"never closed\n" + "3,c\n" * 80)
    (tmp_path / "b.csv").write_text("k,v\n" + "9,z\n" * 5)
    got = files.scan_csv(spark, str(tmp_path), multi_line=True)
    assert got.where("k = '9'").count() == 5 and got.where("k = '1'").count() == 1 and got.where("k = '3'").count() == 0
